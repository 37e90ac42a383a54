"""A corpus pipeline: language ID, near-duplicates, repeated passages, mixing, packing.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet and is
the next one's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import langid, lempelziv, mixing, packing, scratch, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A best language with less than this many times an even share of a document's words is no language.
LEAST_SHARE = 1.2
WINDOW = 35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay; without labelled documents nothing is rejected.

    Null, empty and letterless texts go, and texts whose words are shared out over the languages
    almost evenly.  Repeated rows are judged alike; nulls in other columns do not matter.
    """
    model = langid.train(docs, ~langid.held_out(F.col("doc_id")))
    if model is None:
        return docs.select(COLUMNS)
    found = langid.predict(docs.select(COLUMNS), model)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") * len(model.labels) >= min(LEAST_SHARE, len(model.labels)))).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: shingles of five words, similarity of 0.8 or more.

    The smallest doc_id of a group stays, one row of those that repeat it.  Texts without words
    (null ones among them) are one group.
    """
    found = simhash.near_duplicates(docs, shingle=5, similarity=0.8)
    return simhash.representatives(docs, found).select(COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated windows go; so do documents that lose all their words to it.

    Null and empty texts stay as empty texts, as they lose nothing; repeated rows lose the same words.
    """
    keep = [F.col("lang"), F.col("source")]
    schema = "doc_id long, lang string, source string, n_words long, n_removed long, text_kept string"
    cleaned = lempelziv.clean(docs, WINDOW, keep, schema)
    stay = cleaned.where("n_removed = 0 or n_removed < n_words")
    return stay.select("doc_id", F.col("text_kept").alias("text"), "lang", "source", F.length("text_kept").cast("long").alias("n_chars"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says, which may be never.

    A null text has size 0; null sources are one source; equal rows draw each for themselves.
    """
    return mixing.emit(mixing.mix(docs.select(COLUMNS))).select(COLUMNS)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece: its place in a training sequence.

    A null or empty text is its end token alone; a document that the mix repeats is packed as often.
    """
    import public_tokenizers

    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]
#: SQL can't express the stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.materialise(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
