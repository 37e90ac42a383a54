"""Substring deduplication by relative Lempel-Ziv parsing.

Blocks of candidate contexts (see ``repeats``) are reference and document at once: a suffix
array indexes the block, and every context is factored greedily into the longest matches that
the reference has at another position.  The factors decide: a window inside one is a duplicate;
a window that has a whole factor inside it, neither at its start nor at its end, is none, as that
factor would have reached further; windows that cross one boundary are checked there.  Blocks
hold whole anchors, so a window meets every block that can hold a match for it.

Removes every word covered by a window of words that also starts anywhere else, same document
included; windows are judged on the input and never cross documents.  A word is its XXH64 in
the blocks; contexts that the blocks compare have equal anchors as well.

Edge cases: null texts have no words; texts of fewer words than the window keep all; repeated
rows are copies of each other; very long texts are hashed in pieces; an empty table gives an
empty result; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame

from .repeats import Units, marked, mixed, ranges, repeated
from .suffixes import Block


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The XXH64 of each word, and the number of words of each text."""
    split = [t.split() for t in texts]  # of bytes: the six ASCII blanks
    lengths = np.array([len(words) for words in split], np.int64)
    every = chain.from_iterable(split)
    return np.fromiter(map(xxhash.xxh64_intdigest, every), np.uint64, int(lengths.sum())), lengths


class Reference:
    """An indexed block, asked for the longest match of a position at any other."""

    def __init__(self, parts: list[np.ndarray]):
        self.block = Block(parts)
        self.rank = np.empty(len(self.block.order), np.int64)
        self.rank[self.block.order] = np.arange(len(self.rank))

    def longest(self, at: np.ndarray) -> np.ndarray:
        """The neighbours in suffix order have it."""
        order, rank = self.block.order, self.rank[at]
        above = np.where(rank > 0, self.block.common(at, order[rank - 1]), 0)
        last = len(order) - 1
        return np.maximum(above, np.where(rank < last, self.block.common(at, order[np.minimum(rank + 1, last)]), 0))

    def factors(self) -> tuple[np.ndarray, np.ndarray]:
        """Greedy factors (position, length) of all contexts, in step; a word without a match is one of length 0."""
        at, ends, found = self.block.starts, self.block.ends, []
        while len(at):
            length = self.longest(at)
            found.append((at, length))
            follow = at + np.maximum(length, 1)
            at, ends = follow[follow < ends], ends[follow < ends]
        at, length = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(at)
        return at[order], length[order]


def repeated_starts(parts: list[np.ndarray], window: int) -> list[np.ndarray]:
    """For each context the starts of windows that occur elsewhere in the block."""
    reference = Reference(parts)
    block, (at, length) = reference.block, reference.factors()
    mark = np.zeros(len(block.order), bool)
    inside = np.maximum(length - window + 1, 0)  # windows within the factor
    mark[ranges(at, inside)] = True
    # the others start behind them and end in the next factor, not beyond it
    end = at + np.maximum(length, 1)
    reach = np.minimum(np.append(end[1:], end[-1:]), end + window)  # of the next factor
    own_end = block.ends[np.searchsorted(block.ends, at)]
    reach = np.where(end < own_end, reach, end)
    first, stop = np.maximum(at + inside, at), np.minimum(end, np.minimum(reach, own_end) - window + 1)
    crossing = ranges(first, np.maximum(stop - first, 0))
    mark[crossing[reference.longest(crossing) >= window]] = True
    return [np.flatnonzero(mark[a:b]) for a, b in zip(block.starts, block.ends)]


def _units(window: int) -> Units:
    return Units(window, max(1, (window + 1) // 2), word_hashes, "<u8", mixed, repeated_starts)


def _kept(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, list[bytes]]:
    words = text.split()  # of bytes: the six ASCII blanks
    at, kept = 0, []
    for s, e in zip(starts.tolist(), ends.tolist()):
        kept += words[at:s]
        at = e
    return len(words), kept + words[at:] if len(starts) else words


def _digest(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, str]:
    n, kept = _kept(text, starts, ends)
    return n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def deduplicate(docs: DataFrame, window: int = 35) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    marks = repeated(docs.select("doc_id", "text"), _units(window))
    fields = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    return marked(docs, marks, _digest, "doc_id long, n_words long, n_removed long, kept_sha256 string", fields)


def clean(docs: DataFrame, window: int, keep: list[Column], schema: str) -> DataFrame:
    """Every row with n_words, n_removed and the text without its repeated words.

    A text that loses nothing stays as it is; else its kept words are joined by one space.
    ``keep`` are further columns; ``schema`` is the result's: doc_id, those, and the three.
    """

    def apply(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, str]:
        n, kept = _kept(text, starts, ends)
        return n, n - len(kept), (b" ".join(kept) if len(starts) else text).decode()

    marks = repeated(docs.select("doc_id", "text"), _units(window))
    return marked(docs, marks, apply, schema, [("n_words", pa.int64()), ("n_removed", pa.int64()), ("text_kept", pa.string())], keep)
