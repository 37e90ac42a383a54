"""Suffix-array deduplication with a run-length index.

Blocks of candidate contexts (see ``repeats``) are indexed by a run-compressed Burrows-Wheeler
transform that samples the text positions at both ends of its runs.  Only at a run's first row is
the match with the row before compared, and at its last row that with the row after, which is the
next run's first.  Elsewhere the match of a text's next position is one shorter, so matching
statistics stream along the text from the samples; the suffix array is dropped once the runs are
made.  A position whose match with either neighbour is as long as the window starts a repeated
window.

Removes every byte covered by a window of bytes that also starts anywhere else, same document
included; windows are judged on the input and never cross documents.

Edge cases: null texts are empty; texts shorter than the window keep all; repeated rows are
copies of each other; very long texts are hashed in pieces; an empty table gives an empty
result; other columns do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import Units, marked, mixed, repeated
from .suffixes import Block

#: A number for each byte value, from the mixing rule.
BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class RunLengthIndex:
    """The transform's runs of a block: (unit, first row) and, for each, the sampled ends."""

    def __init__(self, parts: list[np.ndarray]):
        block = Block(parts)
        order, units = block.order, block.units
        before = units[order - 1]  # of the first text position: the last mark
        head = np.ones(len(order), bool)
        head[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)  # marks are all different
        heads = np.flatnonzero(head)
        self.size, self.starts, self.ends = len(order), block.starts, block.ends
        self.symbols, self.heads = before[heads], heads
        self.first = order[heads]  # text position of each run's first row
        self.last = order[np.append(heads[1:], len(order)) - 1]  # and of its last
        self.up = np.zeros(len(heads), np.int64)  # match of a run's first row with the row before
        self.up[1:] = block.common(self.first[1:], self.last[:-1])
        self.down = np.append(self.up[1:], 0)  # of its last row with the row after

    def __len__(self) -> int:
        return len(self.heads)

    def _streamed(self, at: np.ndarray, matches: np.ndarray) -> np.ndarray:
        sample, value = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        sample[at], value[at] = at, matches
        since = np.maximum.accumulate(sample)
        return value[since] - (np.arange(self.size) - since)

    def statistics(self) -> np.ndarray:
        """At each text position the longest match with any other position, streamed from the samples."""
        return np.maximum(np.maximum(self._streamed(self.first, self.up), self._streamed(self.last, self.down)), 0)


def repeated_starts(parts: list[np.ndarray], window: int) -> list[np.ndarray]:
    """For each context the starts of windows that occur elsewhere in the block."""
    index = RunLengthIndex(parts)
    long = index.statistics() >= window
    return [np.flatnonzero(long[a:b]) for a, b in zip(index.starts, index.ends)]


def _bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64)


def _units(window: int) -> Units:
    return Units(window, max(1, window * 2 // 5), _bytes, "u1", lambda units: BYTES[units], repeated_starts)


def _cut(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, int, str]:
    kept, at = hashlib.sha256(), 0
    for s, e in zip(starts.tolist(), ends.tolist()):
        kept.update(text[at:s])
        at = e
    kept.update(text[at:])
    return len(text), int((ends - starts).sum()), len(starts), kept.hexdigest()


FIELDS = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]


def deduplicate(docs: DataFrame, window: int = 200) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    marks = repeated(docs.select("doc_id", "text"), _units(window))
    return marked(docs, marks, _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", FIELDS)
