"""Counts of hashed values over all rows in a table of fixed size.

A value's counter is never below its true count, so a counter of one proves that a value is unique. Each task sends
its counters, compressed, in parts; a part is added up as a stream. What reaches the driver and the executors is one
byte a counter, whatever the input: 2**bits bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PARTS = 64
#: flags are an eighth of a byte each, so they go in fewer parts
FLAG_PARTS = 8


def counter(values: np.ndarray, bits: int) -> np.ndarray:
    return values >> np.uint64(64 - bits)


def level_of(counts: np.ndarray) -> np.ndarray:
    """Eight steps for each doubling; 0 and 8 are counts of none and one."""
    return np.minimum(255, np.round(8 * np.log2(1.0 + counts))).astype(np.uint8)


def levels(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int) -> np.ndarray:
    """The counters' levels over all of ``df``; ``hashes`` gives the 64-bit values of a batch of its rows."""
    size = 1 << bits
    width = size // PARTS

    def count(batches):
        total, some = np.zeros(size, np.uint32), False
        for batch in batches:
            for values in hashes(batch):
                np.add.at(total, counter(values, bits).astype(np.int64), np.uint32(1))
                some = True
        if some:
            packed = [zlib.compress(total[i * width : (i + 1) * width].tobytes(), 1) for i in range(PARTS)]
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(PARTS), pa.int32()), "counts": pa.array(packed, pa.binary())})

    def merge(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch["part"].to_pylist(), batch["counts"]):
                values = np.frombuffer(zlib.decompress(counts.as_py()), np.uint32)
                totals[part] = totals[part] + values if part in totals else values.astype(np.uint64)
        if totals:
            yield pa.RecordBatch.from_pydict({"part": pa.array(list(totals), pa.int32()), "levels": pa.array([level_of(x).tobytes() for x in totals.values()], pa.binary())})

    merged = df.mapInArrow(count, "part int, counts binary").repartition(PARTS, "part").mapInArrow(merge, "part int, levels binary")
    out = np.zeros(size, np.uint8)
    for row in merged.collect():  # PARTS rows
        out[row.part * width : (row.part + 1) * width] = np.frombuffer(row.levels, np.uint8)
    return out


def flags(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int) -> np.ndarray:
    """Which of the counters are not 0 over all of ``df``, eight to a byte: ``levels`` above 0 in a thirty-second of the space."""

    def found(batches):
        out = None
        for batch in batches:
            for values in hashes(batch):
                out = np.zeros(1 << bits, bool) if out is None else out
                out[counter(values, bits).astype(np.int64)] = True
        if out is not None:
            packed = [zlib.compress(x.tobytes(), 1) for x in np.packbits(out).reshape(FLAG_PARTS, -1)]
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(FLAG_PARTS), pa.int32()), "flags": pa.array(packed, pa.binary())})

    def merge(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, packed in zip(batch["part"].to_pylist(), batch["flags"]):
                values = np.frombuffer(zlib.decompress(packed.as_py()), np.uint8)
                totals[part] = totals[part] | values if part in totals else values
        if totals:
            yield pa.RecordBatch.from_pydict({"part": pa.array(list(totals), pa.int32()), "flags": pa.array([x.tobytes() for x in totals.values()], pa.binary())})

    merged = df.mapInArrow(found, "part int, flags binary").repartition(FLAG_PARTS, "part").mapInArrow(merge, "part int, flags binary")
    out = np.zeros((FLAG_PARTS, (1 << bits) // 8 // FLAG_PARTS), np.uint8)
    for row in merged.collect():  # FLAG_PARTS rows
        out[row.part] = np.frombuffer(row.flags, np.uint8)
    return out.ravel()
