"""SimHash near-duplicates by tiled exact comparison.

Every document gets a 64-bit fingerprint of its word shingles.  Distinct fingerprints are dealt
into tiles by population counts; as counts differ by no more than the number of differing bits,
tile pairs whose counts differ beyond the radius hold no link and are never formed.  The other
pairs are compared exactly with numpy's exclusive-or and bit counts, in blocks; each pair returns
a spanning forest of its links, and connected components join them.  Copies share a fingerprint
and count once; tiles are split by their size, so a hot count is many tiles.

Narrow radii (up to 5 bits) tile by the counts of several parts of the fingerprint, whose
differences add up.  Wide radii, which a similarity of 0.8 needs, tile by the sizes of the shingle
sets, as sets of a similarity s have sizes in a ratio of s or more: strangers in size are never
compared.  They use a second fingerprint of ``EXTRA`` more words of 64 bits; their tiles are files
that the comparing tasks open, so only names are shuffled.  For a similarity both fingerprints only choose candidates: each
is confirmed by the Jaccard similarity of the two shingle sets, read from texts that were packed
into files when the fingerprints were made.  Tiles are compared with themselves first and their
trees written, so that a large group of near copies costs two tiles one confirmation and not one
a member.  The comparisons of a wide radius grow with the square of the distinct fingerprints of
like sizes, at about two nanoseconds each.

Edge cases: a null text or one without words has fingerprint zero and is linked like any other;
repeated rows are rows of their own; an empty table gives an empty result; other columns do not
matter; null doc_ids never name a component unless it has no other.
"""

from __future__ import annotations

import math
import struct
import uuid
from collections import OrderedDict
from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .mixing import identity
from .ordering import copy_numbers, positions
from .scratch import file_path, folder, materialise, open_file, owned, partitions

SEED = 42
#: Fingerprints in a tile, about.
TILE = 1 << 14
#: Fingerprints in a tile that is a file.
FILE = 1 << 14
#: Further 64-bit words of a wide fingerprint, and pairs confirmed at once.
EXTRA, CONFIRM = 8, 1 << 16
#: Candidates whose shingle sets are compared at once, and shingles of such sets held by a task.
EXACT, HELD = 1 << 8, 1 << 20
#: Where a packed text is: file, offset, packed and plain bytes.
PLACE = ">32sqqq"
#: Elements of a comparison held at once.
BLOCK = 1 << 20
#: Byte k of entry b is bit 7 - k of b: eight counters in a word.
SPREAD = np.array([sum(((b >> (7 - k)) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def _octets(text: bytes, shingle: int) -> np.ndarray | None:
    """The shingles' XXH64, as rows of eight octets from the highest."""
    words = text.lower().split()  # of bytes: A-Z alone, and the six ASCII blanks
    if not words:
        return None
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(p, SEED) for p in parts]), np.uint8).reshape(-1, 8)


def _majority(octets: np.ndarray) -> bytes:
    """Bits that are set in over half of the rows."""
    n = len(octets)
    if n <= 255:
        sums = SPREAD[octets].sum(axis=0, dtype=np.uint64).view(np.uint8).astype(np.int64)
    else:
        sums = sum(SPREAD[octets[i : i + 255]].sum(axis=0, dtype=np.uint64).view(np.uint8).astype(np.int64) for i in range(0, n, 255))
    return np.packbits(sums * 2 > n).tobytes()


def fingerprint(text: bytes, shingle: int) -> int:
    """The 64-bit SimHash; a bit is set if it is set in over half of the shingles' hashes."""
    octets = _octets(text, shingle)
    return 0 if octets is None else int.from_bytes(_majority(octets), "big")


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The distinct shingles' XXH64, in order."""
    octets = _octets(text, shingle)
    return np.empty(0, np.uint64) if octets is None else np.unique(octets.view(">u8").astype(np.uint64))


def wide_fingerprint(h: np.ndarray) -> tuple[int, bytes]:
    """The 64-bit SimHash of shingles' hashes and EXTRA further words from hashes of the hashes."""
    if not len(h):
        return 0, bytes(8 * EXTRA)
    wide = []
    for k in range(EXTRA):
        x = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        wide.append(_majority((x ^ (x >> np.uint64(32))).view(np.uint8).reshape(-1, 8)))
    return int.from_bytes(_majority(h.astype(">u8").view(np.uint8).reshape(-1, 8)), "big"), b"".join(wide)


def _texts(column: pa.Array) -> list[bytes]:
    return [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in column]


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fp), fp as a signed long."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t, shingle) for t in _texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def wide_fingerprints(docs: DataFrame, shingle: int, home: str) -> DataFrame:
    """(doc_id, row, fp, wide, node, place, size) of the sets of shingles; a node is a set, a place its packed text in ``home``."""

    def run(batches):
        name, at, out, codec = uuid.uuid4().hex, 0, None, pa.Codec("zstd")
        for batch in batches:
            if out is None:
                fs = open_file(home)
                fs.create_dir(file_path(home))
                out = fs.open_output_stream(file_path(f"{home}/{name}"), compression=None)
            fps, wides, nodes, places, sizes = [], [], [], [], []
            for t in _texts(batch.column(2)):
                h, packed = shingle_set(t, shingle), codec.compress(t, asbytes=True)
                fp, wide = wide_fingerprint(h)
                out.write(packed)
                fps.append(fp)
                wides.append(wide)
                nodes.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
                sizes.append(len(h))
                places.append(struct.pack(PLACE, name.encode(), at, len(packed), len(t)))
                at += len(packed)
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, nodes)]
            columns = [batch.column(0), batch.column(1), signed[0], pa.array(wides, pa.binary()), signed[1], pa.array(places, pa.binary()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "fp", "wide", "node", "place", "size"])
        if out is not None:
            out.close()

    rows = docs.select("doc_id", identity(F.col("doc_id"), F.col("text")).alias("row"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(owned(run), "doc_id long, row string, fp long, wide binary, node long, place binary, size long")


class Held:
    """The last ``most`` values of a function, kept by one task."""

    def __init__(self, make, most: int):
        self.make, self.most, self.values = make, most, OrderedDict()

    def __call__(self, key):
        if key not in self.values:
            while len(self.values) >= self.most:  # before the next is made
                self.values.popitem(last=False)
            self.values[key] = self.make(key)
        self.values.move_to_end(key)
        return self.values[key]


def _packed(path: str):
    return open_file(path).open_input_file(file_path(path))


class Similar:
    """Whether the shingle sets of two places have a Jaccard similarity of at least ``least``; the last sets read are held."""

    def __init__(self, home: str, shingle: int, least: float):
        self.home, self.shingle, self.least = home, shingle, least
        self.held, self.size, self.files = OrderedDict(), 0, Held(_packed, 64)

    def shingles(self, place: bytes) -> np.ndarray:
        if place in self.held:
            self.held.move_to_end(place)
            return self.held[place]
        name, at, packed, size = struct.unpack(PLACE, place)
        raw = self.files(f"{self.home}/{name.decode()}").read_at(packed, at)
        found = shingle_set(pa.decompress(raw, size, codec="zstd", asbytes=True), self.shingle)
        self.held[place], self.size = found, self.size + len(found)
        while self.size > HELD and len(self.held) > 1:
            self.size -= len(self.held.popitem(last=False)[1])
        return found

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.array([self.pair(a.tobytes(), b.tobytes()) for a, b in zip(left, right)], bool)

    def pair(self, left: bytes, right: bytes) -> bool:
        a, b = self.shingles(left), self.shingles(right)
        if min(len(a), len(b)) < self.least * max(len(a), len(b)) - 1:  # the sizes alone say no
            return False
        shared = len(np.intersect1d(a, b, assume_unique=True))
        return shared >= self.least * (len(a) + len(b) - shared) - 1e-9


def _parts(radius: int) -> int:
    """Parts of the fingerprint whose counts make the tile; fewer for larger radii, which have more neighbours."""
    return 4 if radius <= 2 else 2


def _tile_keys(fp: Column, parts: int) -> Column:
    width = 64 // parts
    mask = (1 << width) - 1
    counts = [F.bit_count(F.shiftrightunsigned(fp, width * i).bitwiseAND(mask if width < 64 else -1)) for i in range(parts)]
    key = F.lit(0)
    for c in counts:
        key = key * 100 + c
    return key.cast("long")


def _neighbours(parts: int, radius: int) -> list[int]:
    """Differences of tile keys within the radius, one of each pair of opposites."""
    steps = [d for d in product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, d)) <= radius and d >= (0,) * parts]
    return [sum(x * 100 ** (parts - 1 - i) for i, x in enumerate(d)) for d in steps]


class Forest:
    """Components of the links met so far between the members of a tile pair."""

    def __init__(self, label: np.ndarray):
        self.label = label

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            least = np.minimum(a, b)
            np.minimum.at(label, a, least)
            np.minimum.at(label, b, least)
            while not np.array_equal(label, label[label]):
                label[:] = label[label]


def compare(a: np.ndarray, b: np.ndarray, radius: int, confirm=None, same: bool = False, exact=None, joined: np.ndarray | None = None, window=None) -> tuple[np.ndarray, np.ndarray]:
    """A forest (member, smaller member) of the pairs with at most ``radius`` differing bits.

    Members are numbered through a and then b, or through a alone if ``same``, which compares
    each pair of a once.  ``confirm(i, j)`` may reject pairs, and ``exact(i, j)``, which is dearer,
    those that it leaves; pairs already joined are not asked.  ``joined`` gives every member's
    smallest member as known before; the forest then holds only what is new, from such members.
    ``window(first, end)`` gives the bounds in b outside of which a[first:end] has no links.
    """
    shift = 0 if same else len(a)
    before = np.arange(shift + len(b)) if joined is None else joined
    forest, rows = Forest(before.copy()), max(1, BLOCK // max(1, len(b)))
    for at in range(0, len(a), rows):
        start, end = window(at, min(at + rows, len(a))) if window else (0, len(b))
        start = max(start, at) if same else start
        i, j = np.nonzero(np.bitwise_count(a[at : at + rows, None] ^ b[None, start:end]) <= radius)
        i, j = i + at, j + start
        new = forest.label[i] != forest.label[j + shift]
        i, j = i[new], j[new]
        while len(i):
            if confirm is not None:  # the first pairs may join the rest
                part = slice(0, CONFIRM)
                good = confirm(i[part], j[part])
                u, v = i[part][good], j[part][good]
                while exact is not None and len(u):
                    good = exact(u[:EXACT], v[:EXACT])
                    forest.add(u[:EXACT][good], v[:EXACT][good] + shift)
                    u, v = u[EXACT:], v[EXACT:]
                    new = forest.label[u] != forest.label[v + shift]
                    u, v = u[new], v[new]
                forest.add(u, v + shift)
                i, j = i[CONFIRM:], j[CONFIRM:]
                new = forest.label[i] != forest.label[j + shift]
                i, j = i[new], j[new]
            else:
                forest.add(i, j + shift)
                break
    moved = np.flatnonzero((forest.label != before) & (before == np.arange(len(before))))
    return moved, forest.label[moved]


def links(fps: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) of the distinct long column ``fp`` within a narrow radius: a forest of each tile pair."""
    parts = _parts(radius)
    keyed = fps.select("fp", _tile_keys(F.col("fp"), parts).alias("key"))
    sizes = keyed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("chunks"))
    # a row per combination of counts: at most 17^4 or 33^2 whatever the input
    keyed = keyed.join(F.broadcast(sizes), "key").withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")))
    tiles = materialise(keyed.groupBy("key", "chunk").agg(F.collect_list("fp").alias("fps")), "tiles")
    near = tiles.select("key", "chunk", F.col("fps").alias("left"), F.explode(F.array(*[F.lit(d) for d in _neighbours(parts, radius)])).alias("step"))
    near = near.select((F.col("key") + F.col("step")).alias("key"), "chunk", "left", "step")
    pairs = near.join(tiles.select("key", F.col("chunk").alias("other"), F.col("fps").alias("right")), "key")
    pairs = pairs.where("step <> 0 or chunk <= other").select("left", "right")

    def run(batches):
        for batch in batches:
            found = []
            for left, right in zip(batch.column(0), batch.column(1)):
                a, b = (x.values.to_numpy().view(np.uint64) for x in (left, right))
                u, v = compare(a, b, radius)
                if len(u):
                    both = np.concatenate([a, b]).view(np.int64)
                    found.append((both[u], both[v]))
            if found:
                u, v = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


RECORD = np.dtype([("fp", "<u8"), ("node", "<i8"), ("size", "<i8"), ("wide", "<u8", (EXTRA,)), ("place", f"V{struct.calcsize(PLACE)}")])


def _tile(path: str) -> np.ndarray:
    with open_file(path).open_input_stream(file_path(path), compression=None) as file:
        return np.frombuffer(file.read(), RECORD)


def _trees(path: str) -> np.ndarray:
    with open_file(path).open_input_stream(file_path(path), compression=None) as file:
        return np.frombuffer(file.read(), "<i4").astype(np.int64)


NAMES = ["path", "low", "high", "step", "reach", "fewest", "most"]


def most(size, similarity: float):
    """The most shingles that a set can have beside one of ``size``; one more is for rounding."""
    return (size + 1) / similarity


def _step(size: float, similarity: float) -> int:
    """Sizes by steps of the ratio that a similarity allows."""
    return int(math.log(max(size, 1)) / math.log(1 / min(similarity, 0.9)) + 1e-9)


def wide_links(classes: DataFrame, radius: int, wide_radius: int, similarity: float, similar=None) -> DataFrame:
    """Links (a, b) of the column ``node`` of (fp, wide, node, place, size), confirmed by the further words and by what ``similar()`` makes for a task.

    Tiles hold neighbours in size; pairs of rows whose sizes allow no ``similarity`` are not compared.
    """
    spark, home = classes.sparkSession, folder(classes.sparkSession, "tiles")
    order = [F.col("size"), F.bit_count("fp"), F.col("fp"), F.col("node")]
    n = max(1, min(partitions(spark), -(-classes.count() // FILE)))
    cut = classes.select("fp", "node", "wide", "place", "size").repartitionByRange(n, *order).sortWithinPartitions(*order)

    def write(batches):
        held, fs = [], open_file(home)
        fs.create_dir(file_path(home))

        def flush(rows):
            path = f"{home}/{uuid.uuid4().hex}.tile"
            with fs.open_output_stream(file_path(path), compression=None) as out:
                out.write(rows.tobytes())
            low, high = int(rows["size"][0]), int(rows["size"][-1])
            counts = np.bitwise_count(rows["fp"])  # tell tiles of one size apart
            columns = [[path], [low], [high], [_step(low, similarity)], [_step(most(high, similarity), similarity)], [int(counts.min())], [int(counts.max())]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k else pa.string()) for k, c in enumerate(columns)], names=NAMES)

        for batch in batches:
            rows = np.empty(batch.num_rows, RECORD)
            rows["fp"], rows["node"] = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            rows["wide"] = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u8").reshape(-1, EXTRA)
            rows["size"] = batch.column(4).to_numpy()
            rows["place"] = np.frombuffer(b"".join(batch.column(3).to_pylist()), RECORD["place"])
            held.append(rows)
            while sum(map(len, held)) >= FILE:
                rows = np.concatenate(held)
                yield flush(rows[:FILE])
                held = [rows[FILE:]]
        if sum(map(len, held)):
            yield flush(np.concatenate(held))

    tiles = materialise(cut.mapInArrow(write, "path string, " + ", ".join(f"{c} long" for c in NAMES[1:])), "tile-names")
    tiles = materialise(positions(tiles, [F.col("low"), F.col("high"), F.col("path")], tag="tile-order"), "tile-places")
    counts = {r["step"]: r["n"] for r in tiles.groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per step of sizes: some hundreds at most
    last = sum(counts.values()) - 1
    furthest = max(counts, default=0)
    ends = [sum(n for step, n in counts.items() if step <= k) - 1 for k in range(furthest + 1)]  # the last tile in reach
    reach = F.array(*[F.lit(x).cast("long") for x in ends])[F.least(F.col("reach"), F.lit(furthest)).cast("int")]

    def forest(left, right, exactly, same=False, joined=None):
        own, other = (np.ascontiguousarray(x["size"]) for x in (left, right))  # in order

        def window(first, end):
            return np.searchsorted(most(other, similarity), own[first]), np.searchsorted(other, most(own[end - 1], similarity), "right")

        near = lambda i, j: np.bitwise_count(left["wide"][i] ^ right["wide"][j]).sum(axis=1, dtype=np.int64) <= wide_radius
        exact = exactly and (lambda i, j: exactly(left["place"][i], right["place"][j]))
        return compare(np.ascontiguousarray(left["fp"]), np.ascontiguousarray(right["fp"]), radius, near, same, exact, joined, window)

    def within(batches):
        exactly, fs = similar and similar(), open_file(home)
        for batch in batches:
            for path in batch.column(1).to_pylist():
                rows, trees = _tile(path), f"{home}/{uuid.uuid4().hex}.trees"
                label = np.arange(len(rows))
                u, v = forest(rows, rows, exactly, True)
                label[u] = v
                with fs.open_output_stream(file_path(trees), compression=None) as out:
                    out.write(label.astype("<i4").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([trees])], names=["path", "trees"])

    # a tile's own links first: other tiles then ask once for each tree and not for each of its members
    own = tiles.select("pos", "path").repartition(max(1, min(4 * partitions(spark), last + 1)))
    known = materialise(own.mapInArrow(owned(within), "path string, trees string"), "tile-trees")
    tiles = tiles.join(known, "path")
    bounds = ["low", "high", "fewest", "most"]
    pairs = tiles.select(F.col("path").alias("left"), F.col("trees").alias("left_trees"), *[F.col(c).alias(f"left_{c}") for c in bounds], F.explode(F.sequence("pos", reach)).alias("pos"))
    pairs = pairs.join(tiles.select("pos", F.col("path").alias("right"), F.col("trees").alias("right_trees"), *bounds), "pos")
    pairs = pairs.where(most(F.col("left_high"), similarity) >= F.col("low")).where(F.greatest(F.col("fewest") - F.col("left_most"), F.col("left_fewest") - F.col("most")) <= radius)
    spread = pairs.select("left", "left_trees", "right", "right_trees").repartition(max(1, min(4 * partitions(spark), (last + 1) * (last + 2) // 2)))

    def run(batches):
        tile, tree, exactly = Held(_tile, 3), Held(_trees, 6), similar and similar()
        for batch in batches:
            for left, left_trees, right, right_trees in zip(*(c.to_pylist() for c in batch.columns)):
                a, below = tile(left), tree(left_trees)
                if left == right:
                    u = np.flatnonzero(below != np.arange(len(below)))
                    v, nodes = below[u], a["node"]
                else:
                    b = tile(right)
                    u, v = forest(a, b, exactly, joined=np.concatenate([below, tree(right_trees) + len(a)]))
                    nodes = np.concatenate([a["node"], b["node"]]) if len(u) else None
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[u]), pa.array(nodes[v])], names=["a", "b"])

    return spread.sortWithinPartitions("left", "right").mapInArrow(owned(run), "a long, b long")


def radii(similarity: float) -> tuple[int, int]:
    """Differing bits allowed of 64 and of 64 * EXTRA for a Jaccard similarity of the shingles.

    Equal weights make a cosine of 2s / (1 + s), and a bit differs with probability angle / pi.
    Both only choose candidates, so they allow for many standard deviations: four of the first,
    and seven of the second, which costs nothing as strangers are further still, and which ties in
    sets of four and five shingles need.
    """
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    reach = lambda bits, deviations: round(bits * p + deviations * math.sqrt(bits * p * (1 - p)))
    return reach(64, 4.0), reach(64 * EXTRA, 7.0)


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest doc_id reachable by links.

    With ``radius`` links are fingerprints that differ in that many bits or fewer;
    else they are texts whose sets of shingles have a Jaccard similarity of ``similarity`` or more,
    and fp is of the set.
    """
    if radius is None:
        home = folder(docs.sparkSession, "texts")
        prints = materialise(wide_fingerprints(docs, shingle, home), "fingerprints")
        firsts = [F.min(c).alias(c) for c in ("fp", "wide", "place", "size")]
        classes = materialise(prints.groupBy("node").agg(F.min("doc_id").alias("first"), *firsts), "classes")
        found = wide_links(classes, *radii(similarity), similarity, partial(Similar, home, shingle, similarity))
    else:
        prints = materialise(fingerprints(docs, shingle), "fingerprints").withColumn("node", F.col("fp"))
        classes = materialise(prints.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("fp").alias("fp")), "classes")
        found = links(classes, radius)
    roots = components(found).withColumnRenamed("node", "linked")
    grouped = classes.join(roots, classes["node"] == roots["linked"], "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    grouped = materialise(grouped, "roots")
    named = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    # written, so that the joins may split a large component and a hot fingerprint
    named = materialise(named, "components")
    named = materialise(grouped.join(named, "root").select("node", "component_id", "root"), "names")
    rest = ["row", "root"] if radius is None else []
    return prints.join(named, "node").select("doc_id", "fp", "component_id", *rest)


def representatives(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group of ``near_duplicates`` by similarity.

    It is the row of the smallest doc_id; where that repeats, of the least digest, and one of rows
    that are equal in doc_id and text.  A group of null doc_ids alone keeps one row as well.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    keep = found.groupBy("root").agg(F.min(rank)["row"].alias("_kept")).select("_kept")
    kept = docs.withColumn("_identity", identity(F.col("doc_id"), F.col("text"))).join(keep, F.col("_identity") == F.col("_kept"), "left_semi")
    return copy_numbers(kept, F.col("_identity"), "_copy").where("_copy = 0").drop("_identity", "_copy")


def as_hex(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
