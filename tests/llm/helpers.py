"""Small tables with the awkward cases, and brute-force versions of the operators."""

from __future__ import annotations

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, size: int = 400) -> str:
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def documents(spark, rows):
    """Rows of (doc_id, text[, lang[, source]])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOCUMENTS)


def awkward(spark, extra=()):
    """Nulls in every column, empty, blank, very long and repeated texts, repeated rows and ids, odd characters."""
    rng = random.Random(4)
    long = words(rng, 6000, 5000)
    shared = words(rng, 60)
    rows = [
        (1, "The quick brown Fox.\n jumps"), (2, None), (3, ""), (4, " \t\n"), (5, long), (6, long), (7, f"{words(rng, 30)} {shared} {words(rng, 25)}"),
        (8, f"{words(rng, 12)} {shared}é x"), (9, f"{shared} {words(rng, 40)}"), (9, "same id, other text"), (10, "twin"), (10, "twin"), (11, "a" * 5000), (12, "ab " * 700),
        (13, "Über \U0001f600 \x1c\x00 नमस्ते"), (14, "12 34 !!"), (None, "no id"), (None, None), *extra,
    ]
    frame = documents(spark, rows)
    nulls = spark.createDataFrame([(15, "null columns", None, None, None)], DOCUMENTS)
    # columns whose names clash with what operators add
    from pyspark.sql import functions as F

    clash = {c: F.lit(1) for c in ("size", "copies", "target", "score", "lang_pred", "pos", "shard", "fp", "crc", "rate", "source_size")}
    return frame.unionByName(nulls).withColumns(clash)


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


def rows_of(frame, *columns):
    """Rows as tuples, in an order that allows nulls."""
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)
