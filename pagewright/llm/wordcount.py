"""Counts of words in Arrow arrays, added up within a task; words are compared by their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: distinct words that a task holds before it hands them on
MOST_WORDS = 1 << 20


def words_at(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of true values that crosses no offset."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    return np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes between starts and ends, which ascend and don't overlap, as a binary array."""
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    step = np.zeros(len(data) + 1, np.int8)
    step[starts] += 1
    step[ends] -= 1
    kept = data[np.cumsum(step[:-1], dtype=np.int8).astype(bool)]
    if offsets[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(kept)])
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])


class Counts:
    """Sums of counts by word."""

    def __init__(self, name: str):
        self.name, self.parts, self.held = name, [], 0

    def add(self, words: pa.Array) -> None:
        if len(words):
            found = pc.value_counts(words)
            self.parts.append(pa.table([found.field(0).cast(pa.binary()), found.field(1)], [self.name, "n"]))
            self.held += len(found)

    def add_spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        self.add(spans(data, starts, ends))

    def _summed(self) -> pa.Table:
        return pa.concat_tables(self.parts).group_by(self.name).aggregate([("n", "sum")]).select([self.name, "n_sum"]).rename_columns([self.name, "n"])

    def full(self) -> Iterator[pa.RecordBatch]:
        """What has become too much to hold."""
        if self.held > 2 * MOST_WORDS:
            table = self._summed()
            self.parts, self.held = [table], len(table)
            if self.held > MOST_WORDS:
                self.parts, self.held = [], 0
                yield from table.to_batches(1 << 16)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            yield from self._summed().to_batches(1 << 16)
