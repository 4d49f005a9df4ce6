"""Sets of row keys as flags of a fixed size, to pass over rows that a join cannot concern.

A marked row may still be in no set, so what is marked goes through a real join. Null keys hash like any other value.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sketch import flags as sketch_flags
from .textnum import mix

#: flags for each key, and the bounds of a table of flags: of 2**24 two megabytes are broadcast
SPARE, LEAST_BITS, MOST_BITS = 8, 16, 24


class Marks:
    """One flag for each counter that a 64-bit key of a set falls on, eight to a byte."""

    def __init__(self, packed: np.ndarray):
        self.packed = packed
        self.shift = np.uint64(64 - (8 * len(packed) - 1).bit_length())

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """True for every key of the set, and for few others."""
        at = mix(keys.view(np.uint64)) >> self.shift
        return (self.packed[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & np.uint8(1) == 1


def marks_of(rows: DataFrame, *keys: str) -> Marks:
    """The keys of ``rows``, a written table; one long is its own key, others are hashed."""

    def hashes(batch):
        yield mix(batch["key"].to_numpy(zero_copy_only=False).view(np.uint64))

    bits = min(MOST_BITS, max(LEAST_BITS, (SPARE * rows.count()).bit_length()))
    return Marks(sketch_flags(rows.select(_key(keys).alias("key")), hashes, bits))


def _key(keys):
    return F.col(keys[0]) if len(keys) == 1 else F.xxhash64(*keys)


def with_marks(docs: DataFrame, marks: Marks, *keys: str) -> DataFrame:
    """``docs`` with a column ``marked``: true for every row whose keys were marked, and for few others. A plan that filters
    by it and keeps it too evaluates it twice, in two workers a task."""
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    @F.arrow_udf("boolean")
    def found(key: pa.Array) -> pa.Array:
        return pa.array(shared.value.holds(key.to_numpy(zero_copy_only=False)))

    return docs.withColumn("marked", found(_key(keys)))
