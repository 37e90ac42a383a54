"""Windows that occur twice anywhere in a table: what the substring operators share.

A window is ``window`` consecutive units (bytes, words) of one text.  Windows are found through
anchors: each window's anchor is its leftmost gram of least hash, so equal windows have equal
anchors at equal places, and consecutive windows share one.  An anchor's windows make a context,
a stretch of text, and its content is named by 128 bits of XXH3.  Then

1. anchors are counted, and contexts of anchors that occur once are gone;
2. one place of each content of an anchor that has several is fetched into the anchor's block, and
   the operator's own index says which of a block's windows occur elsewhere in it;
3. of a content that occurs more often two places are fetched, contexts that follow on each other
   in both as one stretch, and the same index has to find all of its windows; then the content is
   marked at all of its places, so copies are never expanded into the index.

An anchor with more than ``HOT`` different contents would make an unbounded block.  Its contexts
are cut into their windows, each a content of its own, and go by step 3; the key is finer, the
index and its answer are the same.  Hashes only choose what the index compares: unequal contents
may meet there, equal ones always do.

Windows are judged on the whole input.  Texts longer than ``PIECE`` units are hashed in pieces
that overlap by a window, which changes no window's anchor.  Rows are told apart by 128 bits of
the SHA-256 of doc_id and text: rows that repeat a doc_id, or have none, are documents of their
own, and rows that are equal in both are copies of each other, which lose the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialise, owned, partitions

#: Units hashed at once.
PIECE = 1 << 18
#: Different contents of an anchor that are still compared in one block.
HOT = 256
#: Units of a block, about; an anchor adds at most HOT contexts, a pair of texts two stretches of 2^15 units and a context.
BLOCK = 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1
#: Where a context is: its row, its first unit and its number of windows; ordered as bytes.
PLACE = np.dtype([("a", ">u8"), ("b", ">u8"), ("start", ">i8"), ("windows", ">u4")])

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0, 1, ..., modulo 2^64."""
    if not len(_powers) or len(_powers["up"]) < n:
        size = max(n, PIECE * 5 // 4)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def grams(values: np.ndarray, length: int) -> np.ndarray:
    """A rolling hash of every stretch of ``length``; it only chooses anchors, so collisions do no harm."""
    up, down = _power(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    h = sums[length:] - sums[:-length]
    h *= down[: len(h)]
    return mixed(h)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, in turn."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def anchors(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, window: int, gram: int):
    """(piece, first window, windows, anchor) of each context; the first window's place is absolute."""
    whole = np.flatnonzero(lengths >= window)
    if not len(whole):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty
    hashes = grams(values, gram)
    key = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    width, have, least = window - gram + 1, 1, key
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(key) - width + 1], least[width - have :])
    counts = lengths[whole] - window + 1
    at = ranges(starts[whole], counts)
    place = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    piece = np.repeat(whole, counts)
    head = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (piece[1:] != piece[:-1])]))
    last = np.concatenate([head[1:], [len(at)]]) - 1
    return piece[head], at[head], last - head + 1, hashes[place[head]].view(np.int64)


def contents(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128 bits of each stretch, as rows of two longs."""
    data, size, digest = memoryview(np.ascontiguousarray(units)).cast("B"), units.itemsize, xxhash.xxh3_128_digest
    found = b"".join([digest(data[a:b]) for a, b in zip((starts * size).tolist(), (ends * size).tolist())])
    return np.frombuffer(found, "<i8").reshape(-1, 2)


@dataclass(frozen=True)
class Units:
    """What a unit is, and how contexts are compared."""

    window: int
    gram: int
    #: list of texts -> (their units, of type ``kind``, the number of units of each text)
    units: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
    kind: str
    #: units -> 64-bit values, for the anchors
    values: Callable[[np.ndarray], np.ndarray]
    #: block of contexts -> for each its repeated window starts
    matcher: Callable[[list[np.ndarray], int], list[np.ndarray]]


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column("text")]


def _pieces(texts: list[bytes], units: Units) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(units, text, offset, start, length) of pieces, about PIECE units at a time."""
    at = 0
    while at < len(texts):
        to, held = at, 0
        while to < len(texts) and (to == at or held + len(texts[to]) <= PIECE):
            held += len(texts[to])
            to += 1
        found, lengths = units.units(texts[at:to])
        if to == at + 1 and len(found) > PIECE:
            for a in range(0, max(1, len(found) - units.window + 1), PIECE):
                part = found[a : a + PIECE + units.window - 1]
                yield part, np.array([at]), np.array([a]), np.array([0]), np.array([len(part)])
        else:
            n = to - at
            yield found, np.arange(at, to), np.zeros(n, np.int64), np.cumsum(lengths) - lengths, lengths
        at = to


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits that name a row: of the SHA-256 of its doc_id and its text."""
    named = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary"), F.lit(b":"), F.coalesce(text.cast("binary"), F.lit(b"")))
    return F.substring(F.unhex(F.sha2(named, 256)), 1, 16)


def _sources(docs: DataFrame) -> DataFrame:
    return docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), F.col("text").cast("binary").alias("text"))


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("key").to_pylist()), ">u8").reshape(-1, 2)


CONTEXTS = "anchor long, c1 long, c2 long, n long, places binary"


def _context_rows(anchor: np.ndarray, content: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Equal contexts of the batch as one row, its places packed; of several the lesser of first and last comes first."""
    order = np.lexsort((content[:, 1], content[:, 0]))
    anchor, content, place = anchor[order], content[order], place[order].astype(PLACE)  # concatenating made it native
    new = (content[1:] != content[:-1]).any(axis=1)
    head = np.flatnonzero(np.concatenate([[True], new])) if len(order) else np.zeros(0, np.int64)
    times = np.diff(np.append(head, len(order)))
    several = np.flatnonzero(times > 1)
    first, last = head[several], head[several] + times[several] - 1
    swap = (place["a"][first] > place["a"][last]) | ((place["a"][first] == place["a"][last]) & (place["start"][first] > place["start"][last]))
    first, last = first[swap], last[swap]
    place[first], place[last] = place[last], place[first]
    bounds = np.concatenate([head, [len(order)]]) * PLACE.itemsize
    places = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(place.tobytes())])
    columns = [anchor[head], content[head, 0], content[head, 1], times]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), places], names=["anchor", "c1", "c2", "n", "places"])


def _placed(keys: np.ndarray, start: np.ndarray, windows: np.ndarray) -> np.ndarray:
    place = np.empty(len(start), PLACE)
    place["a"], place["b"], place["start"], place["windows"] = keys[:, 0], keys[:, 1], start, windows
    return place


def contexts(sources: DataFrame, units: Units) -> DataFrame:
    """CONTEXTS of all texts; ``places`` packs PLACE records."""

    def run(batches):
        for batch in batches:
            keys, found = _keys(batch), []
            for part, text, offset, start, length in _pieces(_texts(batch), units):
                piece, first, windows, anchor = anchors(units.values(part), start, length, units.window, units.gram)
                content = contents(part, first, first + windows + units.window - 1)
                found.append((anchor, content, _placed(keys[text[piece]], first - start[piece] + offset[piece], windows)))
            if found:
                yield _context_rows(*(np.concatenate(x) for x in zip(*found)))

    return sources.mapInArrow(owned(run), CONTEXTS)


def busy_anchors(docs: DataFrame, units: Units) -> DataFrame:
    """Anchors of more than one context: summed a batch and a partition at a time before the shuffle."""

    def run(batches):
        for batch in batches:
            found = [anchors(units.values(part), start, length, units.window, units.gram)[3] for part, _, _, start, length in _pieces(_texts(batch), units)]
            if found:
                anchor, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(n)], names=["anchor", "n"])

    counted = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(owned(run), "anchor long, n long")
    return counted.groupBy("anchor").agg(F.sum("n").alias("_n")).where("_n > 1").select("anchor")


def _contents(rows: DataFrame) -> DataFrame:
    """A row per content: (anchor, c1, c2, n, low, high), two different places if it has them."""
    low, high = F.substring("places", 1, PLACE.itemsize), F.substring("places", -PLACE.itemsize, PLACE.itemsize)
    return rows.groupBy("c1", "c2").agg(F.min("anchor").alias("anchor"), F.sum("n").alias("n"), F.min(low).alias("low"), F.max(high).alias("high"))


#: What a member of a block is for: to be marked itself, to prove that its content is repeated, or to be matched by others.
ALONE, PROOF, OTHER = 0, 1, 2


def _number(part: Column) -> Column:
    return F.conv(F.hex(part), 16, 10).cast("long")


def _start(place: Column) -> Column:
    return _number(F.substring(place, 17, 8))


def _of_anchors(rows: DataFrame) -> DataFrame:
    """A member per content of an anchor, in the anchor's block."""
    return rows.select(F.col("anchor").alias("block"), "c1", "c2", F.when(F.col("n") == 1, ALONE).otherwise(OTHER).alias("use"), F.col("low").alias("place"))


def _proofs(rows: DataFrame, level: int) -> DataFrame:
    """Two members per content that occurs twice: copies of one stretch share a block, and are fetched as one stretch."""
    pair = F.xxhash64(F.lit(level), F.substring("low", 1, 16), F.substring("high", 1, 16), F.shiftright(_start(F.col("low")), 15))
    both = F.explode(F.array_distinct(F.array("low", "high"))).alias("place")
    return rows.where("n > 1").select(pair.alias("block"), "c1", "c2", F.lit(PROOF).alias("use"), both)


def _wanted(members: DataFrame) -> DataFrame:
    """The places wanted of each row of the sources, gathered: bounded by the row's own text."""
    at = F.struct("block", "c1", "c2", F.col("use").cast("long").alias("use"), _start(F.col("place")).alias("start"), _number(F.substring("place", 25, 4)).alias("windows"))
    return members.select(F.substring("place", 1, 16).alias("key"), at.alias("at")).groupBy("key").agg(F.collect_set("at").alias("wanted"))


#: The contexts of a fetched stretch.
ITEM = np.dtype([(c, "<i8") for c in ("c1", "c2", "use", "start", "windows")])
FETCHED = pa.schema([("block", pa.int64()), ("key", pa.binary()), ("start", pa.int64()), ("units", pa.binary()), ("items", pa.binary())])


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    lists = batch.column("wanted")
    bounds, inner = lists.offsets.to_numpy(), lists.flatten()
    return bounds - bounds[0], [inner.field(i).to_numpy(zero_copy_only=False) for i in range(inner.type.num_fields)]


def _fetch(sources: DataFrame, members: DataFrame, units: Units) -> DataFrame:
    """FETCHED rows: the units of the wanted contexts, those of a block that follow on each other as one stretch."""
    joined = sources.join(_wanted(members).hint("shuffle_hash"), "key")

    def run(batches):
        for batch in batches:
            keys, (bounds, columns) = batch.column("key").to_pylist(), _lists(batch)
            rows, held = [], 0
            for i, text in enumerate(_texts(batch)):
                own = [c[bounds[i] : bounds[i + 1]] for c in columns]
                order = np.lexsort((own[4], own[0]))
                block, items = own[0][order], np.empty(len(order), ITEM)
                for name, values in zip(ITEM.names, own[1:]):
                    items[name] = values[order]
                follow = (block[1:] == block[:-1]) & (items["start"][1:] == items["start"][:-1] + items["windows"][:-1])
                head = np.concatenate([[0], np.flatnonzero(~follow) + 1, [len(order)]])
                found = units.units([text])[0]
                for a, b in zip(head[:-1].tolist(), head[1:].tolist()):
                    s, e = int(items["start"][a]), int(items["start"][b - 1] + items["windows"][b - 1]) + units.window - 1
                    rows.append((block[a], keys[i], s, found[s:e].tobytes(), items[a:b].tobytes()))
                    held += len(rows[-1][3])
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), FETCHED.types)], schema=FETCHED)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), FETCHED.types)], schema=FETCHED)

    return joined.mapInArrow(owned(run), "block long, key binary, start long, units binary, items binary")


def _cut(sources: DataFrame, rows: DataFrame, units: Units) -> DataFrame:
    """CONTEXTS of the single windows of hot contents."""
    joined = sources.join(_wanted(_of_anchors(rows)).hint("shuffle_hash"), "key")

    def run(batches):
        for batch in batches:
            keys, (bounds, (_, _, _, _, start, windows)) = _keys(batch), _lists(batch)
            held = []
            for i, text in enumerate(_texts(batch)):
                found, own = units.units([text])[0], slice(bounds[i], bounds[i + 1])
                at = np.unique(ranges(start[own].astype(np.int64), windows[own].astype(np.int64)))
                content = contents(found, at, at + units.window)
                held.append((np.zeros(len(at), np.int64), content, _placed(np.repeat(keys[i : i + 1], len(at), axis=0), at, np.ones(len(at), np.int64))))
                if sum(len(x[0]) for x in held) > 200_000:
                    yield _context_rows(*(np.concatenate(x) for x in zip(*held)))
                    held = []
            if held:
                yield _context_rows(*(np.concatenate(x) for x in zip(*held)))

    return joined.mapInArrow(owned(run), CONTEXTS)


FOUND = pa.schema([("c1", pa.int64()), ("c2", pa.int64()), ("whole", pa.bool_()), ("key", pa.binary()), ("start", pa.int64()), ("end", pa.int64())])


def _compared(fetched: DataFrame, units: Units) -> DataFrame:
    """FOUND rows, from the operator's index over whole blocks.

    Stretches (key, start, end) that repeated windows cover, of contents that occur once; and the
    contents (c1, c2) that occur more often, if the index found all of their windows (``whole``).
    """
    gathered = fetched.repartition(partitions(fetched.sparkSession), "block").sortWithinPartitions("block")
    window, kind = units.window, np.dtype(units.kind)

    def indexed(rows: list[tuple]) -> pa.RecordBatch | None:
        starts, out = units.matcher([np.frombuffer(r[3], kind) for r in rows], window), []
        for (_, key, start, _, packed), own in zip(rows, starts):
            if not len(own):
                continue
            items = np.frombuffer(packed, ITEM)
            first = np.searchsorted(own, items["start"] - start)
            last = np.searchsorted(own, items["start"] - start + items["windows"])
            for k in np.flatnonzero((items["use"] == PROOF) & (last - first == items["windows"])).tolist():
                out.append((int(items["c1"][k]), int(items["c2"][k]), True, None, None, None))
            for k in np.flatnonzero((items["use"] == ALONE) & (last > first)).tolist():
                part = own[first[k] : last[k]]
                cut = np.flatnonzero(part[1:] > part[:-1] + window)
                for a, b in zip(part[np.concatenate([[0], cut + 1])].tolist(), part[np.append(cut, len(part) - 1)].tolist()):
                    out.append((None, None, False, key, start + a, start + b + window))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), FOUND.types)], schema=FOUND) if out else None

    def run(batches):
        rows, held, times = [], 0, {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and row[0] != rows[-1][0]:
                    times = {}
                    if held > BLOCK:
                        if (got := indexed(rows)) is not None:
                            yield got
                        rows, held = [], 0
                same = times.get(row[1:3], 0)
                if same < 2:  # a third equal row adds nothing to the block
                    times[row[1:3]] = same + 1
                    rows.append(row)
                    held += len(row[3]) // kind.itemsize
        if rows and (got := indexed(rows)) is not None:
            yield got

    return gathered.mapInArrow(owned(run), "c1 long, c2 long, whole boolean, key binary, start long, end long")


MARKS = "key binary, start long, end long"


def merged(row: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Overlapping or adjoining marks of a row as one; rows are numbers."""
    order = np.lexsort((start, row))
    row, start, end = (np.asarray(x)[order].astype(np.int64) for x in (row, start, end))
    new = np.concatenate([[True], row[1:] != row[:-1]])
    # ends rise within a row: lift each row above the ones before
    lift = np.cumsum(new) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift) - lift
    head = np.flatnonzero(new | np.concatenate([[True], start[1:] > reach[:-1]]))
    last = np.append(head[1:], len(row)) - 1
    return row[head], start[head], reach[last]


def _unpacked(rows: DataFrame, window: int) -> DataFrame:
    """MARKS of all places, neighbours of a batch merged."""

    def run(batches):
        for batch in batches:
            place = np.frombuffer(b"".join(batch.column(0).to_pylist()), PLACE)
            if len(place):
                names = np.frombuffer(place.tobytes(), np.uint8).reshape(-1, PLACE.itemsize)[:, :16]
                keys, row = np.unique(np.ascontiguousarray(names).view("V16").ravel(), return_inverse=True)
                row, start, end = merged(row, place["start"], place["start"] + place["windows"] + (window - 1))
                yield pa.RecordBatch.from_arrays([pa.array([keys[r].tobytes() for r in row], pa.binary()), pa.array(start), pa.array(end)], names=["key", "start", "end"])

    return rows.select("places").mapInArrow(run, MARKS)


def repeated(docs: DataFrame, units: Units) -> DataFrame:
    """(key, start, end): stretches of units that repeated windows cover, not merged over batches."""
    sources = _sources(docs)
    busy = materialise(busy_anchors(docs, units), "anchors")
    kept = materialise(contexts(sources, units).join(busy, "anchor"), "contexts")  # a hot anchor may be split here
    known = materialise(_contents(kept), "contents")
    # anchors with different contents; the others' contents have copies and need proof alone
    mixed_ = known.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("anchor", (F.col("_n") > HOT).alias("hot"))
    mixed_ = materialise(mixed_, "mixed-anchors")
    met = known.join(mixed_, "anchor")
    members = _proofs(known, 1).unionByName(_of_anchors(met.where("not hot")))
    several = kept.select("c1", "c2", "places")
    if not mixed_.where("hot").isEmpty():
        cut = materialise(_cut(sources, met.where("hot"), units), "windows")
        members = members.unionByName(_proofs(_contents(cut), 2))
        several = several.unionByName(cut.select("c1", "c2", "places"))
    found = materialise(_compared(_fetch(sources, members, units), units), "found")
    whole = materialise(found.where("whole").select("c1", "c2").distinct(), "whole")
    everywhere = several.join(whole, ["c1", "c2"])  # so may a hot content
    return _unpacked(everywhere, units.window).unionByName(found.where("not whole").select("key", "start", "end"))


def marked(docs: DataFrame, marks: DataFrame, apply: Callable[[bytes, np.ndarray, np.ndarray], tuple], schema: str, fields: list[tuple[str, pa.DataType]], keep: list[Column] = ()) -> DataFrame:
    """Apply merged marks to each document: ``apply(text, starts, ends)`` gives the values of ``fields``."""
    per = marks.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("marks"))  # bounded by the text
    rows = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), F.col("doc_id").alias("shown"), F.col("text").cast("binary").alias("text"), *keep)
    joined = rows.join(per.hint("shuffle_hash"), "key", "left").drop("key")
    rest = [c for c in joined.columns if c not in ("shown", "text", "marks")]
    names = ["doc_id", *rest, *(f for f, _ in fields)]

    def run(batches):
        for batch in batches:
            texts, lists = _texts(batch), batch.column("marks")
            inner, bounds, valid = lists.values, lists.offsets.to_numpy(), lists.is_valid().to_numpy(zero_copy_only=False)
            start, end = (inner.field(i).to_numpy() for i in range(2))
            out = []
            for i, content in enumerate(texts):
                own = slice(bounds[i], bounds[i + 1]) if valid[i] else slice(0, 0)
                s, e = start[own], end[own]
                if len(s):
                    _, s, e = merged(np.zeros(len(s), np.int64), s, e)
                out.append(apply(content, s, e))
            columns = [pa.array(c, t) for c, (_, t) in zip(zip(*out), fields)] if out else [pa.array([], t) for _, t in fields]
            yield pa.RecordBatch.from_arrays([batch.column("shown"), *(batch.column(c) for c in rest), *columns], names=names)

    return joined.mapInArrow(owned(run), schema)
