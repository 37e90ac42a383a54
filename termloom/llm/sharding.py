"""Minimax contiguous partition into shards (DataFrame functions only).

Rows of equal text form an atomic group.  Groups stand in the order of their smallest doc_id,
and the shards are contiguous runs of groups whose largest sum of sizes is as small as possible:
the smallest feasible capacity is found by binary search, a greedy walk checking each, and the
shards are cut by the greedy walk at that capacity.

The driver never holds the groups.  It holds a summary of the running sums at 2**16 resolution:
the smallest and largest running sum of each bucket.  A greedy step that ends outside of mixed
buckets is known exactly; otherwise it has a lower and an upper end, and the search narrows
the capacity as far as both agree.  The next summary covers only the buckets that the walks of
the remaining capacities can end in, at a finer resolution, until every step is exact.

Edge cases: a null text has no bytes and all null texts are one group; null doc_ids come first;
repeated rows stay separate rows; an empty table gives no shard; fewer groups than shards leave
shards empty.  Other columns do not matter.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import positions
from .scratch import materialise

BUCKETS = 1 << 16
OVERHEAD = 16


class Summary:
    """Running sums known as disjoint buckets (low, high): exact where both are equal."""

    def __init__(self, buckets: list[tuple[int, int]]):
        self.low, self.high = [b[0] for b in buckets], [b[1] for b in buckets]

    def reach(self, y: int) -> tuple[int, int]:
        """Bounds of the largest running sum that is at most y (0 if none)."""
        i = bisect_right(self.low, y) - 1
        if i < 0:
            return 0, 0
        if y >= self.high[i]:
            return self.high[i], self.high[i]
        return self.low[i], y

    def walk(self, capacity: int, shards: int) -> tuple[list[int], list[int]]:
        """Lower and upper bounds of the greedy walk's cuts."""
        low, high = [0], [0]
        for _ in range(shards):
            low.append(self.reach(low[-1] + capacity)[0])
            high.append(self.reach(high[-1] + capacity)[1])
        return low, high


def _summary(groups: DataFrame, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(low, high) of the running sums in buckets of equal width over the disjoint spans (a, b]."""
    length = sum(b - a for a, b in spans)
    width = max(1, -(-length // BUCKETS))
    if len(spans) == 1:
        (a, b), = spans
        rows = groups.where((F.col("upto") > a) & (F.col("upto") <= b)).groupBy(F.floor((F.col("upto") - 1 - a) / width).alias("k"))
    else:
        # the last span that begins before a sum is the only one that can hold it: no row is multiplied
        begun = F.size(F.filter(F.array(*[F.lit(a) for a, _ in spans]), lambda a: a < F.col("upto")))
        bounds = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(spans)])
        inside = groups.select("upto", begun.alias("n")).where("n > 0").select("upto", F.element_at(bounds, F.col("n")).alias("s"))
        inside = inside.where(F.col("upto") <= F.col("s.b"))
        rows = inside.groupBy(F.col("s.i").alias("i"), F.floor((F.col("upto") - 1 - F.col("s.a")) / width).alias("k"))
    got = rows.agg(F.min("upto").alias("low"), F.max("upto").alias("high")).select("low", "high").collect()
    return sorted((int(r[0]), int(r[1])) for r in got)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity and the running sums at which the greedy walk cuts.

    ``groups`` has ``upto``, the running sum of positive group sizes, and ``group_size``.
    """
    first = groups.agg(F.max("upto").alias("t"), F.max("group_size").alias("g")).first()
    total, largest = int(first["t"] or 0), int(first["g"] or 0)
    if not total:
        return 0, [0] * shards
    lo = max(largest, -(-total // shards))  # no capacity below is feasible
    hi = lo + largest  # one above: a greedy shard falls short of it by less than a group
    buckets = _summary(groups, [(0, total)])
    while True:
        known = Summary(buckets)

        def least(end: int, lo: int = lo, hi: int = hi, known: Summary = known) -> int:
            while lo < hi:
                mid = (lo + hi) // 2
                if known.walk(mid, shards)[end][-1] >= total:
                    hi = mid
                else:
                    lo = mid + 1
            return lo

        hi, lo = least(0), least(1)  # surely feasible; not surely infeasible
        mixed = [i for i in range(len(buckets)) if known.low[i] < known.high[i]]
        low, high = known.walk(lo, shards)[0], known.walk(hi, shards)[1]
        needed = [(known.low[i] - 1, known.high[i]) for i in mixed if any(known.low[i] <= b and a <= known.high[i] for a, b in zip(low[1:], high[1:]))]
        if lo == hi and low == high or not needed:
            return hi, known.walk(hi, shards)[0][1:]
        spans = _merged(needed)
        if len(spans) > 256:  # the filter stays short; neighbours are read along
            gaps = sorted(range(1, len(spans)), key=lambda i: spans[i - 1][1] - spans[i][0])[:255]
            cuts = [0, *sorted(gaps), len(spans)]
            spans = [(spans[a][0], spans[b - 1][1]) for a, b in zip(cuts, cuts[1:])]
        covered = lambda x: any(a < x <= b for a, b in spans)
        kept = [b for b in buckets if not covered(b[1])]
        buckets = sorted(kept + _summary(groups, spans))


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Rows of doc_id, size, text_crc32, shard and slot (gapless within a shard).

    The text is read once and never shuffled: its SHA-256 is the group, its CRC-32 the check.
    """
    text = F.col("text").cast("binary")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b"")).alias("group"),
    )
    rows = materialise(rows, "shard-rows")
    groups = rows.groupBy("group").agg(F.sum("size").alias("group_size"), F.min("doc_id").alias("first"))
    groups = positions(groups, [F.col("first"), F.col("group")], "group_size", "shard-groups")
    groups = materialise(groups, "shard-sums")
    _, cuts = minimax_cuts(groups, shards)
    return place(rows, groups, cuts)


def shard_of(upto: Column, cuts: list[int]) -> Column:
    """Number of cuts before the running sum."""
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts[:-1]]), lambda c: c < upto))


def place(rows: DataFrame, groups: DataFrame, cuts: list[int]) -> DataFrame:
    """Shard and slot for each row; rows of a shard stand in the order of group and doc_id."""
    joined = rows.join(groups.select("group", "upto"), "group").drop("group")
    numbered = positions(joined, [F.col("upto"), F.col("doc_id"), F.col("size")], tag="shard-slots")
    numbered = materialise(numbered.withColumn("shard", shard_of(F.col("upto"), cuts).cast("int")), "shard-placed")
    starts = numbered.groupBy("shard").agg(F.min("pos").alias("start"))  # a row per shard
    return numbered.join(F.broadcast(starts), "shard").withColumn("slot", F.col("pos") - F.col("start")).drop("start", "pos", "upto")
