"""Mixing sources to target weights (DataFrame functions only).

Tokens are summed per source, each source's target share gives a repetition rate, and every
document is emitted floor(rate) times plus one hash-seeded Bernoulli copy with probability
equal to the fraction.

Edge cases: a null text has size 0; null sources form one source, ordered last; sources without
words get target 0 and rate 0; the draw depends on doc_id, text and a number among the rows that
are equal in both, so rows of a null or repeated doc_id draw each for themselves; an empty table
gives an empty mix.  Further columns are carried along; the names ``size``, ``source_size``,
``target``, ``rate`` and ``copies`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import copy_numbers, positions
from .scratch import materialise

WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the digest that make the draw: 52 bits, exact in a double.
DIGITS = 13


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """Weights 1, 2, ..., ``cycle``, repeating, to sources by code point, null last."""
    order = [F.col("source").isNull().cast("int"), F.col("source")]
    return positions(sources, order, tag="weights").withColumn("weight", F.col("pos") % cycle + 1).drop("pos")


def fill_targets(sources: DataFrame, cap: int = 3) -> DataFrame:
    """Add ``target`` to (source, source_size, weight): shares of the total by weight, at most ``cap`` sizes.

    The excess of capped sources is shared again by weight until no source is above its cap.
    Each round is one aggregate over the sources (two numbers reach the driver); the capped set
    only grows, so the loop ends.  Integers are compared exactly.
    """
    big = lambda c: F.col(c).cast("decimal(38,0)")
    first = sources.agg(F.sum("source_size").alias("t"), F.sum("weight").alias("w")).first()
    total, weights = int(first["t"] or 0), int(first["w"] or 0)
    left, free = total, weights
    while True:
        capped = big("source_size") * cap * F.lit(free).cast("decimal(20,0)") < big("weight") * F.lit(left).cast("decimal(20,0)")
        got = sources.agg(
            F.sum(F.when(capped, F.col("source_size") * cap)).alias("full"), F.sum(F.when(~capped, F.col("weight"))).alias("open")
        ).first()
        now = total - int(got["full"] or 0), int(got["open"] or 0)
        if now == (left, free) or not now[1]:
            break
        left, free = now
    share = (F.col("weight") * F.lit(left)).cast("double") / F.lit(float(max(free, 1)))
    return sources.withColumn("target", F.when(capped, (F.col("source_size") * cap).cast("double")).otherwise(share))


def identity(doc_id: Column, text: Column) -> Column:
    """A row's doc_id and its text's digest; rows that are equal in both share it."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the key and seed alone."""
    digest = F.md5(F.concat(F.lit(seed + ":"), key).cast("binary"))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def mix(docs: DataFrame, weights=cyclic_weights, cap: int = 3, seed: str = "mix", size: Column | None = None) -> DataFrame:
    """Every document with ``size``, ``source_size``, ``target``, ``rate`` and ``copies``.

    ``weights`` turns a frame of (source, source_size) into (source, source_size, weight).
    ``docs`` needs doc_id and source; ``size`` defaults to the words of ``text``.
    The table of sources joins back on the source; a hot source is summed before the shuffle
    and Spark may split its rows in the join, as nothing after it needs them together.
    """
    docs = docs.drop("size", "source_size", "target", "rate", "copies", "_source", "_identity", "_number")
    sized = docs.withColumn("size", word_count(F.col("text")) if size is None else size)
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = fill_targets(materialise(weights(materialise(sums, "sizes")), "sources"), cap)
    targets = targets.select(F.col("source").alias("_source"), "source_size", "target")
    joined = sized.join(targets, sized["source"].eqNullSafe(targets["_source"])).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(F.col("rate"))
    key = identity(F.col("doc_id"), F.col("text") if "text" in docs.columns else F.lit(""))
    rows = copy_numbers(joined.withColumns({"rate": rate, "_identity": key}), F.col("_identity"), "_number")
    extra = (draw(F.concat_ws(":", "_identity", "_number"), seed) < F.col("rate") - whole).cast("long")
    return rows.withColumn("copies", whole + extra).drop("_identity", "_number")


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as many times as ``copies`` says."""
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("_copy")
