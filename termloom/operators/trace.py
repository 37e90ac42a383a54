"""The decision trace: a bounded record of what was decided, and looks into it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The trace is pruned to this many requests when it holds more than twice as many.
RETENTION, SHOWN, MOST = 200, 40, 200


def newest(decisions: DataFrame, k: int, request: str = "request_id", order: str = "id") -> DataFrame:
    """The ``k`` requests with the latest decisions."""
    return decisions.groupBy(request).agg(F.max(order).alias("_last")).orderBy(F.desc("_last")).limit(k)


def compacted(decisions: DataFrame, keep: int = RETENTION, request: str = "request_id", order: str = "id") -> DataFrame:
    """Prune to the newest ``keep`` requests if more than twice as many are held; whole requests go."""
    held = decisions.select(request).distinct().limit(2 * keep + 1).count()
    if held <= 2 * keep:
        return decisions
    return decisions.join(newest(decisions, keep, request, order), request, "left_semi")


def retained_after(n: int, keep: int = RETENTION) -> int:
    """Requests held after ``n`` were traced one by one, each followed by pruning."""
    return n if n <= 2 * keep else keep + (n - 2 * keep - 1) % (keep + 1)


def retained(decisions: DataFrame, keep: int = RETENTION, request: str = "request_id", order: str = "id") -> DataFrame:
    """What is left if every request was followed by pruning, in the order of its last decision."""
    n = decisions.select(request).distinct().count()
    left = retained_after(n, keep)
    return decisions.join(newest(decisions, left, request, order), request, "left_semi")


def recent(decisions: DataFrame, limit: int = SHOWN, request: str = "request_id", order: str = "id") -> DataFrame:
    """The newest requests, each with its decisions, newest first; ``limit`` is held between 1 and MOST."""
    k = max(1, min(limit, MOST))
    rows = decisions.join(newest(decisions, k, request, order), request)
    rest = [c for c in decisions.columns if c not in (request, order)]
    grouped = rows.groupBy(request, "_last").agg(F.reverse(F.array_sort(F.collect_list(F.struct(order, *rest)))).alias("decisions"))
    return grouped.orderBy(F.desc("_last")).drop("_last")


def table_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) of each table and of all together."""
    counts = [t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows") for name, t in sorted(tables.items())]
    every = counts[0]
    for c in counts[1:]:
        every = every.unionByName(c)
    return every.unionByName(every.agg(F.sum("rows").alias("rows")).select(F.lit("total").alias("table"), "rows"))


def top_per_group(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark prunes groups before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= k).drop("_n")
