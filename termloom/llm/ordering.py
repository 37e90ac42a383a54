"""Global positions and running sums without a single-task window (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialise, partitions


def positions(df: DataFrame, order: list[Column], total: str | None = None, tag: str = "order") -> DataFrame:
    """Add ``pos`` (0-based rank in ``order``) and, if ``total`` names a column, ``upto`` (its running sum).

    Rows are range-partitioned and sorted once; the table is written so that the partition
    numbers are facts.  Offsets of the partitions come from one row per partition, which is all
    that is broadcast (bounded by the number of partitions).  ``order`` must be a total order
    (end it with a unique column) so that a hot key is split over partitions as well.
    """
    n = partitions(df.sparkSession)
    cut = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    cut = materialise(cut.withColumn("_at", F.monotonically_increasing_id()), tag)
    cut = cut.withColumn("_part", F.shiftright("_at", 33)).withColumn("_row", F.col("_at").bitwiseAND((1 << 33) - 1))
    sums = [F.count(F.lit(1)).alias("_n")] + ([F.sum(total).alias("_sum")] if total else [])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = cut.groupBy("_part").agg(*sums)
    offsets = per.select(
        "_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows_before"),
        *([F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_sum_before")] if total else []),
    )
    out = cut.join(F.broadcast(offsets), "_part").withColumn("pos", F.col("_rows_before") + F.col("_row"))
    if total:
        inside = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("upto", F.col("_sum_before") + F.sum(total).over(inside))
    return out.drop("_at", "_part", "_row", "_rows_before", "_sum_before")


def copy_numbers(df: DataFrame, key: Column, name: str = "_copy") -> DataFrame:
    """Add ``name``: 0, 1, ... over the rows of an equal key, in any order.

    Keys are counted first; only rows whose key repeats are moved.  They are numbered by rank
    offsets, so a key that a third of all rows share is split like any other.
    """
    keyed = df.withColumn("_key", key)
    repeated = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key")
    repeated = materialise(repeated, "repeated-keys")
    if repeated.isEmpty():
        return df.withColumn(name, F.lit(0).cast("long"))
    alone = keyed.join(repeated, "_key", "left_anti").withColumn(name, F.lit(0).cast("long"))
    several = materialise(keyed.join(repeated, "_key", "left_semi").withColumn("_id", F.monotonically_increasing_id()), "repeated-rows")
    ranked = materialise(positions(several, [F.col("_key"), F.col("_id")], tag="repeated-order"), "repeated-ranks")
    first = materialise(ranked.groupBy("_key").agg(F.min("pos").alias("_first")), "repeated-first")
    ranked = ranked.join(first, "_key").withColumn(name, F.col("pos") - F.col("_first"))
    return alone.select(*df.columns, name).unionByName(ranked.select(*df.columns, name))
