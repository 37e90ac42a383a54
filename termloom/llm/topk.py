"""Exact top-k inner products over vectors sorted by length.

Vectors are rotated so that their leading coordinates carry most of their length (the
eigenvectors of the Gram matrix, dimension squared numbers, are the SVD's right side), packed
into blocks by descending length, and met by blocks of queries.  A partial product over the
leading coordinates plus the product of the residual lengths bounds the score (Cauchy-Schwarz);
what can't reach the query's k-th best so far is pruned, whole blocks first.  Survivors are
scored exactly on the unrotated integers.

Every query block meets every candidate block that its thresholds allow; that is the stated
query set against all rows, in blocks.  Each meeting returns at most k rows a query.

Edge cases: vectors that are null or empty of id, or that hold null or non-finite components,
take no part; shorter vectors count as filled with zeros; rows that repeat a vec_id are rows of
their own; fewer candidates than k give all; ties go to the smaller vec_id; other columns do not
matter.  Products that a double can't hold exactly (lengths whose product reaches 2^53) are
summed in whole numbers of any size; scores beyond a long are held at its ends, and tie there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import positions
from .scratch import materialise, partitions

#: Candidates and queries in a block.
CANDIDATES, QUERIES = 4096, 1024
#: Candidates bounded at once.
STEP = 512
#: Share of the squared length that the leading coordinates keep, at least.
LEAD = 0.5
SLACK = 1e-6
#: Below this product of lengths every partial sum of an inner product is exact in a double.
EXACT = float(1 << 53) * (1 - 1e-9)
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """(row, vec_id, length2, vector): floor(scale * x) as little-endian doubles, a row per valid vector."""
    x = F.col("embedding").cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    valid = vectors.select("vec_id", x.alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole)
    size = valid.agg(F.max(F.size("embedding")).alias("n")).first()["n"] or 1

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            lengths, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
            block = np.zeros((len(lengths), size))
            block[np.arange(size)[None, :] < lengths[:, None]] = np.floor(flat * scale)
            length2 = np.einsum("ij,ij->i", block, block)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(length2), pa.array([r.tobytes() for r in block], pa.binary())], names=["vec_id", "length2", "vector"])

    found = valid.mapInArrow(run, "vec_id long, length2 double, vector binary")
    return materialise(found.withColumn("row", F.monotonically_increasing_id()), "vectors")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def rotation(vectors: DataFrame) -> tuple[np.ndarray, int]:
    """Eigenvectors of the Gram matrix, largest first, and how many keep LEAD of the squared length."""

    def run(batches):
        total = 0
        for batch in batches:
            block = _matrix(batch.column(0))
            total = total + block.T @ block
        if not isinstance(total, int):
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["g"])

    sums = vectors.select("vector").mapInArrow(run, "g array<double>").select(F.posexplode("g")).groupBy("pos").agg(F.sum("col").alias("s"))
    rows = sums.collect()  # dimension squared
    size = int(len(rows) ** 0.5)
    if not size:
        return np.eye(1), 1
    gram = np.zeros(size * size)
    for r in rows:
        gram[r["pos"]] = r["s"]
    values, turn = np.linalg.eigh(gram.reshape(size, size))
    values, turn = np.maximum(values[::-1], 0), np.ascontiguousarray(turn[:, ::-1])
    share = np.cumsum(values) / max(values.sum(), 1e-300)
    return turn, min(size, int(np.searchsorted(share, LEAD)) + 1)


def blocks(vectors: DataFrame, count: int, order: list[Column], tag: str, **more: Column) -> DataFrame:
    """Pack sorted vectors: (block, longest, ids, rows, matrix) and the columns ``more``."""
    n = partitions(vectors.sparkSession)
    cut = vectors.repartitionByRange(n, *order).sortWithinPartitions(*order).select("vec_id", "row", "length2", "vector")

    def run(batches):
        ids, rows, length, data = [], [], [], []

        def flush(k):
            nonlocal ids, rows, length, data
            out = [[max(length[:k]) ** 0.5], [np.array(ids[:k], "<i8").tobytes()], [np.array(rows[:k], "<i8").tobytes()], [b"".join(data[:k])]]
            ids, rows, length, data = ids[k:], rows[k:], length[k:], data[k:]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.float64(), pa.binary(), pa.binary(), pa.binary()))], names=["longest", "ids", "rows", "matrix"])

        for batch in batches:
            for held, column in zip((ids, rows, length, data), batch.columns):
                held.extend(column.to_pylist())
            while len(ids) >= count:
                yield flush(count)
        if ids:
            yield flush(len(ids))

    packed = cut.mapInArrow(run, "longest double, ids binary, rows binary, matrix binary")
    return materialise(packed.withColumns({"block": F.monotonically_increasing_id()} | more), tag)


def products(q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the pairs as longs, exact up to the range of a long."""
    out = np.empty(len(i), np.int64)
    q_length, c_length = (np.sqrt(np.einsum("ij,ij->i", x, x)) for x in (q, c))
    large = q_length[i] * c_length[j] >= EXACT
    small = np.flatnonzero(~large)
    for s in range(0, len(small), 8192):
        at = small[s : s + 8192]
        out[at] = np.einsum("ij,ij->i", q[i[at]], c[j[at]])
    for at in np.flatnonzero(large).tolist():
        out[at] = min(MOST, max(LEAST, sum(int(x) * int(y) for x, y in zip(q[i[at]].tolist(), c[j[at]].tolist()))))
    return out


def meet(q: np.ndarray, q_rows: np.ndarray, c: np.ndarray, c_ids: np.ndarray, c_rows: np.ndarray, floor: np.ndarray, turn: np.ndarray, lead: int, k: int):
    """The k best candidates of each query in one block: (query index, candidate index, score)."""
    qr, cr = q @ turn, c @ turn
    q_rest, c_rest = (np.sqrt(np.maximum(0, np.einsum("ij,ij->i", x[:, lead:], x[:, lead:]))) for x in (qr, cr))
    best = np.repeat(floor[:, None], k, axis=1)
    found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    exact = np.sqrt(np.einsum("ij,ij->i", q, q).max(initial=0) * np.einsum("ij,ij->i", c, c).max(initial=0)) < EXACT
    for at in range(0, len(c), STEP):
        to = min(len(c), at + STEP)
        bound = qr[:, :lead] @ cr[at:to, :lead].T + q_rest[:, None] * c_rest[None, at:to]
        least = best.min(axis=1)
        i, j = np.nonzero((bound >= (least - SLACK * (1 + np.abs(least)))[:, None]) & (q_rows[:, None] != c_rows[None, at:to]))
        if not len(i):
            continue
        j = j + at
        if exact and len(i) > 0.05 * len(q) * (to - at):
            score = (q @ c[at:to].T)[i, j - at].astype(np.int64)
        else:
            score = products(q, c, i, j)
        keep = score >= least[i] - (0 if exact else SLACK * (1 + np.abs(least[i])))
        i, j, score = (np.concatenate([old, new[keep]]) for old, new in zip(found, (i, j, score)))
        order = np.lexsort((c_ids[j], ~score, i))  # of longs: falling without overflow
        i, j, score = i[order], j[order], score[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        found = i, j, score = tuple(x[rank < k] for x in (i, j, score))
        rank = rank[rank < k]
        best[i, rank] = np.maximum(best[i, rank], score)
        best[:, :] = np.maximum(best, floor[:, None])
    return found


def _meetings(pairs: DataFrame, turn: np.ndarray, lead: int, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = [], [], [], []
            for q_ids, q_rows, q_matrix, floor, ids, rows, matrix in zip(*(c.to_pylist() for c in batch.columns)):
                qi, qn, ci, cn = (np.frombuffer(x, "<i8") for x in (q_ids, q_rows, ids, rows))
                q, c = np.frombuffer(q_matrix, "<f8").reshape(len(qi), -1), np.frombuffer(matrix, "<f8").reshape(len(ci), -1)
                low = np.full(len(qi), -np.inf) if floor is None else np.frombuffer(floor, "<f8")
                i, j, score = meet(q, qn, c, ci, cn, low, turn, lead, k)
                for held, values in zip(out, (qn[i], qi[i], ci[j], score)):
                    held.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["query_row", "query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, "query_row long, query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query row's k highest inner products with all other rows."""
    whole = integers(vectors, scale)
    turn, lead = rotation(whole)
    candidates = blocks(whole, CANDIDATES, [F.desc("length2"), F.asc("vec_id"), F.asc("row")], "candidates")
    numbered = candidates.select("block", "longest").orderBy(F.desc("longest"), "block").limit(1).collect()
    top = int(numbered[0]["block"]) if numbered else 0
    queries = blocks(whole.where(is_query), QUERIES, [F.desc("length2"), F.asc("vec_id"), F.asc("row")], "queries", top=F.lit(top).cast("long"))
    asked = queries.select(F.col("block").alias("q"), F.col("longest").alias("q_longest"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("matrix").alias("q_matrix"), "top")
    if not numbered:
        return asked.select(F.lit(0).cast("long").alias("query_id"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("score")).where("false")
    arrays = ["q_ids", "q_rows", "q_matrix", "floor", "ids", "rows", "matrix"]
    # the longest block first: its k-th scores are the floors of all that follow
    longest = F.broadcast(candidates.where(F.col("block") == top))  # one block, of CANDIDATES vectors at most
    first = asked.withColumnRenamed("top", "block").join(longest, "block").withColumn("floor", F.lit(None).cast("binary"))
    seed = materialise(_meetings(first.select(arrays), turn, lead, k), "seed")
    floors = _best(seed, k).where(F.col("rank") == k).select("query_row", F.col("score").alias("low"))
    asked = materialise(_with_floors(asked, floors), "floors")
    # every block of queries meets the other blocks of candidates within its reach, a prefix by length
    ends = asked.select(F.col("q").alias("id"), (F.col("least") / F.greatest("q_longest", F.lit(1e-300)) * (1 - SLACK)).alias("x"), F.lit(0).alias("one"))
    reach = candidates.where(F.col("block") != top).select(F.col("block").alias("id"), F.col("longest").alias("x"), F.lit(1).alias("one"))
    ranked = materialise(positions(reach.union(ends), [F.desc("x"), F.desc("one"), F.asc("id")], "one", "reach"), "reach")
    place = ranked.where("one = 1").select((F.col("upto") - 1).alias("place"), F.col("id").alias("block"))
    meetings = ranked.where("one = 0 and upto > 0").select(F.col("id").alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("upto") - 1)).alias("place"))
    spread = meetings.join(place, "place").select("q", "block").repartition(partitions(vectors.sparkSession), "block", "q")
    pairs = spread.join(asked, "q").join(candidates, "block").select(arrays)
    rest = _meetings(pairs, turn, lead, k)
    return _best(seed.unionByName(rest), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _with_floors(asked: DataFrame, floors: DataFrame) -> DataFrame:
    """Attach to each block of queries the floors of its rows, in order, and their least."""

    def run(batches):
        for batch in batches:
            out = [], [], []
            for q, rows, have in zip(*(c.to_pylist() for c in batch.columns)):
                rows, low = np.frombuffer(rows, "<i8"), {r["query_row"]: float(r["low"]) for r in have or ()}
                floor = np.array([low.get(int(r), -np.inf) for r in rows])
                for held, value in zip(out, (q, floor.astype("<f8").tobytes(), float(floor.min()))):
                    held.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.binary(), pa.float64()))], names=["q", "floor", "least"])

    def members(batches):
        for batch in batches:
            for q, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = np.frombuffer(rows, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), q)), pa.array(rows)], names=["q", "query_row"])

    inside = asked.select("q", "q_rows").mapInArrow(members, "q long, query_row long").join(floors, "query_row")
    per = inside.groupBy("q").agg(F.collect_list(F.struct("query_row", "low")).alias("have"))  # bounded by QUERIES
    got = asked.select("q", "q_rows").join(per, "q", "left").mapInArrow(run, "q long, floor binary, least double")
    return asked.join(got, "q")
