"""Best-fit packing of token sequences by exact-complement hashing.

Documents are tokenized and cut into pieces of at most ``capacity`` tokens.  The packing is
planned on the histogram of piece lengths, at most ``capacity`` counters whatever the input:
for each length, longest first, indexes of single lengths, of pair sums and of triple sums name
combinations that fill the remaining gap exactly, consumed under the available counts; what is
left is packed best-fit decreasing.  The plan has a bounded number of lines (each step uses up
a length or a group of open sequences), so it travels with the code; the pieces are numbered
within their length by a distributed rank and look their place up in the plan.

Edge cases: a null or empty text is the end token alone; rows that repeat a doc_id are packed
as rows of their own; an empty table gives no pieces; other columns do not matter.
"""

from __future__ import annotations

import re
import sys
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import positions
from .scratch import materialise, owned

assert sys.byteorder == "little"
CAPACITY = 4096
END = 1
#: Bytes of words and ids that a worker keeps, over its tasks: half of its work is in words met before.
CACHE = 24 << 20
#: Bytes of text whose new words are tokenized together.
GROUP = 2 << 20
#: Lower-case letters of one code point, and a mark that stands alone after them.
PLAIN = re.compile("([a-zß-öø-ÿ]+)([.,]?)")
#: Longer words, in bytes, are tokenized each time.
LONG = 200


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _parts(path: str):
    """The tokenizer, the ids of the marks that PLAIN allows, and its spelling of letters as bytes."""
    from tokenizers.pre_tokenizers import ByteLevel

    tokenizer, spell = _tokenizer(path), ByteLevel(add_prefix_space=False, use_regex=False)
    ids = lambda x: np.asarray(tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes()
    letters = [chr(c) for c in range(0xDF, 0x100) if c != 0xF7]
    return tokenizer, {x: ids(x) if x else b"" for x in ("", ".", ",")}, str.maketrans({c: spell.pre_tokenize_str(c)[0][0] for c in letters})


class _Known(dict):
    """Ids of words met by this worker, and for a while those of rarer ones."""

    def __init__(self):
        super().__init__()
        self.rare: dict[bytes, bytes] = {}
        self.size = 0

    def __missing__(self, word: bytes) -> bytes:
        return self.rare[word]


@lru_cache(maxsize=2)
def _known(path: str) -> _Known:
    """Kept over a worker's tasks, CACHE bytes of them."""
    return _Known()


class WordIds:
    """Ids of texts, as little-endian 32-bit bytes, from the ids of their blank-separated words.

    The tokenizer's own pre-tokenization never joins characters across white space, so a text's
    ids are its words' ids in order; A-Z are lower-cased before, as the tokenizer does.
    """

    def __init__(self, path: str):
        self.path, self.known = path, _known(path)

    def learn(self, words: set[bytes]) -> None:
        """Tokenize words; the first ones met are the frequent ones and stay.

        Words of plain letters, with or without a mark at their end, are pieces that the tokenizer
        would neither normalize nor split further: they go to its model at once.
        """
        known, (tokenizer, marks, spelt) = self.known, _parts(self.path)
        model, found, odd = tokenizer.model.tokenize, {}, []
        for word in words:
            plain = PLAIN.fullmatch(word.decode())
            if plain and len(word) <= LONG:
                letters, mark = plain.groups()
                found[word] = array("I", [t.id for t in model(letters.translate(spelt))]).tobytes() + marks[mark]
            else:
                odd.append(word)
        got = tokenizer.encode_batch_fast([w.decode() for w in odd], add_special_tokens=False)
        found.update((w, np.asarray(e.ids, "<u4").tobytes()) for w, e in zip(odd, got))
        known.rare = found
        if known.size < CACHE:
            short = {w: ids for w, ids in found.items() if len(w) <= LONG}
            known.update(short)
            known.size += sum(map(len, short)) + sum(map(len, short.values())) + 200 * len(short)

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids of each text; pass texts of about GROUP bytes together."""
        split = [t.lower().split() for t in texts]  # of bytes: A-Z and the six ASCII blanks
        missing = set().union(*split).difference(self.known)
        if missing:
            self.learn(missing)
        end, of = END.to_bytes(4, "little"), self.known.__getitem__
        for words in split:
            yield b"".join(map(of, words)) + end
        self.known.rare = {}


def grouped(values: pa.Array, size: int) -> Iterator[tuple[int, list[bytes]]]:
    """Binary values, null as empty, by about ``size`` bytes: (place of the first, values)."""
    first, held, total = 0, [], 0
    for i, value in enumerate(values):
        held.append(value.as_buffer().to_pybytes() if value.is_valid else b"")
        total += len(held[-1])
        if total >= size:
            yield first, held
            first, held, total = i + 1, [], 0
    if held:
        yield first, held


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's pieces."""

    def run(batches):
        ids = WordIds(tokenizer)
        for batch in batches:
            out, names = ([], [], [], [], []), batch.column(0).to_pylist()
            for first, texts in grouped(batch.column(1), GROUP):
                for doc, data in zip(names[first:], ids.encode(texts)):
                    for k, at in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[at : at + 4 * capacity]
                        for column, value in zip(out, (doc, k, at // 4, len(part) // 4, crc32(part))):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, PIECES.types)], schema=PIECES)

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(owned(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Gaps:
    """Open sequences by gap: (pattern, count) lists, and the gaps in order."""

    def __init__(self):
        self.by: dict[int, list[tuple[tuple[int, ...], int]]] = {}
        self.order: list[int] = []

    def add(self, gap: int, pattern: tuple[int, ...], count: int) -> None:
        if gap not in self.by:
            self.by[gap] = []
            insort(self.order, gap)
        self.by[gap].append((pattern, count))

    def take(self, least: int, count: int) -> tuple[int, tuple[int, ...], int] | None:
        at = bisect_left(self.order, least)
        if at == len(self.order):
            return None
        gap = self.order[at]
        pattern, have = self.by[gap].pop()
        used = min(have, count)
        if used < have:
            self.by[gap].append((pattern, have - used))
        elif not self.by[gap]:
            del self.by[gap], self.order[at]
        return gap, pattern, used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence in order, number of such sequences), covering every piece once."""
    have = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        have[length] = count
    out: list[tuple[tuple[int, ...], int]] = []

    def consume(parts: tuple[int, ...]) -> bool:
        need = {x: parts.count(x) for x in parts}
        times = min(int(have[x]) // k for x, k in need.items())
        if times <= 0:
            return False
        for x, k in need.items():
            have[x] -= k * times
        out.append((parts, times))
        return True

    def pairs(total: int, first: int):
        """Available (a, b), a + b = total and a, b <= first, the most even last."""
        a = np.arange(max(1, total - first), total // 2 + 1)
        return [(int(total - x), int(x)) for x in a[(have[a] > 0) & (have[total - a] > 0)]]

    if have[capacity]:
        consume((capacity,))
    for length in range(capacity - 1, 0, -1):
        gap = capacity - length
        if have[length] and gap <= length:
            consume((length, gap))
        if have[length]:
            for b, a in pairs(gap, length) if gap > 1 else ():
                consume((length, b, a))
                if not have[length]:
                    break
        if have[length]:
            for a in np.flatnonzero(have[1 : min(length, gap) + 1])[::-1] + 1:
                if not have[length]:
                    break
                for c, b in pairs(gap - int(a), int(a)) if gap - a > 1 else ():
                    consume((length, int(a), c, b))
                    if not have[length] or not have[a]:
                        break
    gaps = _Gaps()
    for length in range(capacity, 0, -1):
        left = int(have[length])
        while left:
            got = gaps.take(length, left)
            if got is None:
                fit = capacity // length
                full, rest = divmod(left, fit)
                if full:
                    gaps.add(capacity - fit * length, (length,) * fit, full)
                if rest:
                    gaps.add(capacity - rest * length, (length,) * rest, 1)
                break
            gap, pattern, used = got
            fit = min(gap // length, max(1, left // used))
            gaps.add(gap - fit * length, pattern + (length,) * fit, used)
            left -= fit * used
    out += [line for lines in gaps.by.values() for line in lines]
    return out


def places(lines: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """The plan by (length, first rank): sequence of that rank and offset in it."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, count in lines:
        at = 0
        for length in pattern:
            rank = used.get(length, 0)
            rows.append((length, rank, sequence, at))
            used[length] = rank + count
            at += length
        sequence += count
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return {"key": (table[:, 0] << 48) | table[:, 1], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces of (doc_id, piece, length, ...)."""
    cut = materialise(cut, "pieces")
    order = [F.col("length"), F.col("doc_id"), F.col("piece"), F.col("ids_crc32")]
    ranked = positions(cut, order, tag="piece-ranks")
    histogram = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = places(plan(histogram, capacity))
    before, total = np.zeros(capacity + 2, np.int64), 0
    for length in sorted(histogram):
        before[length] = total
        total += histogram[length]
    names = cut.columns
    schema = cut.select(*names).schema.add("sequence_id", "long").add("offset", "long")

    def run(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("pos").to_numpy() - before[length]
            line = np.searchsorted(table["key"], (length << 48) | rank, side="right") - 1
            sequence = table["sequence"][line] + rank - table["rank"][line]
            arrays = [batch.column(c) for c in names] + [pa.array(sequence), pa.array(table["offset"][line])]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "pos").mapInArrow(run, schema)
