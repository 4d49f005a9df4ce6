"""Words and word hashes of Arrow text columns, computed on the UTF-8 bytes with numpy.

Every separator is an ASCII byte, so working on bytes equals working on code points. A null text counts as empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def _separators(spans: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(256, bool)
    for low, high in spans:
        out[low : high + 1] = True
    return out


#: words are runs of anything but white space
SPACE = _separators([(0x20, 0x20), (0x09, 0x0D)])
#: words are runs of ASCII letters and digits and of everything beyond ASCII (applied after folding case)
SYMBOL = _separators([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])

_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
_STEP = 0x9E3779B97F4A7C15
_Q = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for step in (_STEP, pow(_STEP, -1, 1 << 64)):
        p = np.full(n + 1, np.uint64(step))
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with about ``limit`` bytes; one long text stays whole."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        high = min(high, len(column), low + 20_000)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of the lines that are not empty (split at line feeds, which stay at their ends), and each line's text and number."""
    cuts = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1]))
    text = np.searchsorted(offsets, cuts[:-1], "right") - 1
    return cuts, text, np.arange(len(text)) - np.searchsorted(cuts, offsets[text])


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of each segment (one entry more than segments)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    word = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    after = np.empty_like(word)
    after[-1], after[:-1] = False, word[1:]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: sums modulo a power of two meet for long words with a pattern (from some 1,024 letters of two kinds), so these are hashed alone
LONG_WORD = 128


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words; ``data`` has been folded."""
    power, inverse = _powers(max(BLOCK_BYTES, 1 << max(len(data) - 1, 1).bit_length()))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
    out = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _Q)
    for k in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def hashed_words(column: pa.Array, separator: np.ndarray, by_line: bool = False):
    """For each block: its first row, each segment's first word, the word hashes, and each segment's text and line number."""
    for low, _, data, offsets in blocks(column):
        data = FOLD[data]
        cuts, text, line = lines_of(data, offsets) if by_line else (offsets, np.arange(len(offsets) - 1), None)
        starts, ends, first = word_spans(data, cuts, separator)
        yield low, first, word_hashes(data, starts, ends), text, line


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on."""
    m = len(words) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = words[:m].copy()
    for t in range(1, k):
        out *= _Q
        out += words[t : t + m]
    return mix(out + np.uint64(k))


def fold_hashes(words: np.ndarray) -> np.ndarray:
    """One hash of a whole short sequence."""
    return shingle_hashes(words, len(words)) if len(words) else np.zeros(0, np.uint64)


def set_hash(values: np.ndarray) -> int:
    """Signed 64-bit hash of a sorted set of 64-bit values."""
    with np.errstate(over="ignore"):
        n = np.uint64(len(values))
        total = np.add.reduce(mix(values + np.uint64(0x51ED2701)), dtype=np.uint64) if len(values) else np.uint64(0)
        both = np.array([total + n * _Q, np.bitwise_xor.reduce(mix(values * _Q)) if len(values) else n], np.uint64)
    return int(mix(both[:1] ^ mix(both[1:]))[0].astype(np.int64))


def distinct_in_segments(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of every segment in ascending order, and where each segment starts (one entry more than
    segments); ``first`` has the same of ``values``."""
    segment = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.argsort(values)
    values = values[order]
    # two sorts of single numbers cost less than one by two keys
    key = (segment[order] << 32) | np.arange(len(order))
    key.sort()
    values, segment = values[key & 0xFFFFFFFF], key >> 32
    kept = np.ones(len(values), bool)
    kept[1:] = (segment[1:] != segment[:-1]) | (values[1:] != values[:-1])
    return values[kept], np.concatenate([[0], np.cumsum(np.bincount(segment[kept], minlength=len(first) - 1))])


def set_hashes(values: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``set_hash`` of many sets that are not empty and follow each other in ``values``."""
    if not len(start):
        return np.zeros(0, np.int64)
    total = np.add.reduceat(mix(values + np.uint64(0x51ED2701)), start) + n.astype(np.uint64) * _Q
    return mix(total ^ mix(np.bitwise_xor.reduceat(mix(values * _Q), start))).view(np.int64)
