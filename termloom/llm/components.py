"""Connected components by alternating stars; edges never leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the long pairs (a, b); root is the smallest node reachable.

    Each round ties every node's larger neighbours, then its smaller ones, to the smallest
    neighbour; the edges shrink to stars in a logarithmic number of rounds.  Minima are taken
    before the shuffle and written before they are joined, so that a hot centre's edges may be
    split in the joins; every round is written to the shared folder.  The driver sees a count and a checksum per round.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now, last = materialise(now, "edges"), None
    while True:
        before = now
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = materialise(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        discard(least)
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        now = materialise(small.union(least.toDF("u", "v")).distinct(), "stars")
        discard(before, large, least)
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.crc32(F.concat_ws(",", "u", "v")))).first()
        if mark == last:
            break
        last = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
