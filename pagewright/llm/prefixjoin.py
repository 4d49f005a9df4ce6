"""Exact set-similarity candidates from prefixes: shared by the joins on documents and on lines.

Sets x and y link when 100 * |x & y| >= 80 * |x | y|, which is 9 * |x & y| >= 4 * (|x| + |y|). Tokens are ordered by
rarity; linked sets share a token among the first n - ceil(4n / 5) + 1 of each. Rows of one token form a bucket. A
small bucket is compared whole; in a large one each row meets the first ``LEAD`` rows only, so that it costs n
comparisons and not n * n, and its rows come back for the pairs that the links found so far leave open.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAD = 8
STEP = 1 << 15
#: pairs that a task holds before it hands them on
MOST_PAIRS = 1 << 18
NAMES = ["x", "y", "lead", "key", "info", "more"]
LEVEL_SHIFT = np.uint64(56)
#: a key is the lowest 40 bits of a token with the row's rank below; tokens that share a bucket only cost comparisons
RANK_BITS = 24
MOST_RANK = (1 << RANK_BITS) - 1
#: what the filters need, in one number: parity bits, size and position; sizes from ``MOST_SIZE`` on are not filtered
PARITY_BITS, SIZE_BITS, POS_BITS = 40, 14, 10
MOST_SIZE, MOST_POS = (1 << SIZE_BITS) - 1, (1 << POS_BITS) - 1
#: sets above this size have 64 parity bits more; smaller ones have 0 there
WIDE = 48


def ordered_tokens(values: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Tokens that sort by rarity: the counter's level in the top byte, the hash below."""
    bits = np.uint64(64 - (len(levels) - 1).bit_length())
    return (levels[values >> bits].astype(np.uint64) << LEVEL_SHIFT) | (values >> np.uint64(8))


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def parities(values: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each set ``PARITY_BITS`` bits and 64 more, each the parity of the values that fall on it: two sets that differ in
    d values differ in at most d bits."""
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    place = values % np.uint64(PARITY_BITS + 64)
    bit = np.uint64(1) << (place & np.uint64(63))
    low = place >= np.uint64(64)
    few, more = np.where(low, bit, np.uint64(0)), np.where(low, np.uint64(0), bit)
    return np.bitwise_xor.reduceat(few, start), np.bitwise_xor.reduceat(more, start)


def packed(size: np.ndarray, pos: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """``info`` of rows; a position that is too large counts as an earlier one, which only weakens its filter."""
    size, pos = np.minimum(size, MOST_SIZE), np.minimum(pos, MOST_POS)
    return ((bits.astype(np.uint64) << np.uint64(SIZE_BITS + POS_BITS)) | (size.astype(np.uint64) << np.uint64(POS_BITS)) | pos.astype(np.uint64)).view(np.int64)


def may_link(a: str, b: str) -> Column:
    """The length, positional and parity filters for two rows of a bucket, given their ``info``, and their ``more`` as a_more and b_more."""
    size, pos = (lambda x: f"(shiftright({x}, {POS_BITS}) & {MOST_SIZE})"), (lambda x: f"({x} & {MOST_POS})")
    large = f"greatest({size(a)}, {size(b)}) = {MOST_SIZE}"
    wide = f"if(least({size(a)}, {size(b)}) > {WIDE}, bit_count({a}_more ^ {b}_more), 0)"
    near = f"9 * least({size(a)} - {pos(a)}, {size(b)} - {pos(b)}) >= 4 * ({size(a)} + {size(b)})"
    apart = f"bit_count(shiftrightunsigned({a} ^ {b}, {SIZE_BITS + POS_BITS}))"
    return F.expr(f"{large} or ({near} and 9 * ({apart} + {wide}) <= {size(a)} + {size(b)})")


def bucket(key: str = "key") -> Column:
    return F.shiftrightunsigned(F.col(key), RANK_BITS)


def key_of(token: Column, rank: Column) -> Column:
    """The key of a row: buckets by the token's lowest bits, rows in them by ``rank``, from 0 to ``MOST_RANK``."""
    return F.shiftleft(token, RANK_BITS).bitwiseOR(rank.cast("long"))


def info_of(size: Column, pos: Column, bits: int) -> Column:
    """``packed`` as an expression, for a fixed number in the place of the parity bits."""
    size, pos = F.least(size, F.lit(MOST_SIZE)).cast("long"), F.least(pos, F.lit(MOST_POS)).cast("long")
    return F.lit(bits << (SIZE_BITS + POS_BITS)).cast("long").bitwiseOR(F.shiftleft(size, POS_BITS)).bitwiseOR(pos)


def bits_of(info: Column) -> Column:
    return F.shiftrightunsigned(info, SIZE_BITS + POS_BITS)


def _joined(batches, names):
    """The columns of ``STEP`` rows or more at a time, as every step has a fixed cost for the longest bucket in it."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= STEP:
            yield {k: np.concatenate([b[k].to_numpy(zero_copy_only=False) for b in held]) for k in names}
            held, n = [], 0
    if n:
        yield {k: np.concatenate([b[k].to_numpy(zero_copy_only=False) for b in held]) for k in names}


def compare(rows: DataFrame, whole: int) -> DataFrame:
    """Candidate pairs and the rows of large buckets from ``rows(key, node, info, more)``.

    Rows are dealt by bucket and sorted by key. A bucket of at most ``whole`` rows gives all its pairs that pass the
    filters. In a larger one each row is compared with the first ``LEAD`` only, and all its rows come back too. Result:
    pairs have ``lead`` null and the nodes x < y; a row of a large bucket has its own node as x, its key, info and more,
    and as ``lead`` the bucket's first node.
    """
    kept = ("key", "node", "info", "more")
    schema = pa.schema([(n, pa.int64()) for n in NAMES])

    def once(xs, ys):
        """The pairs, each once and the lesser node first."""
        x, y = np.concatenate(xs), np.concatenate(ys)
        x, y = np.minimum(x, y), np.maximum(x, y)
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        none = pa.nulls(int(new.sum()), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x[new]), pa.array(y[new]), none, none, none, none], schema=schema)

    def pairs_of(rows, first, limit):
        """Pairs of each row with the first ``limit`` rows of its bucket, which starts at ``first``."""
        node, more = rows["node"], rows["more"]
        info = rows["info"].view(np.uint64)
        size = ((info >> np.uint64(POS_BITS)) & np.uint64(MOST_SIZE)).astype(np.int32)
        open_ = size == MOST_SIZE
        # most comparisons end at the length and positional filters, so these come first and on small numbers
        room = np.where(open_, np.int32(2**30), 9 * (size - (info & np.uint64(MOST_POS)).astype(np.int32)))
        need = np.where(open_, np.int32(0), 4 * size)
        xs, ys, held, left, t = [], [], 0, np.flatnonzero(limit > 0), 0
        while len(left):
            at = first[left] + t
            ok = np.minimum(room[left], room[at]) >= need[left] + need[at]
            x, y = left[ok], at[ok]
            apart = np.bitwise_count((info[x] ^ info[y]) >> np.uint64(SIZE_BITS + POS_BITS)).astype(np.int32)
            apart += np.where(np.minimum(size[x], size[y]) > WIDE, np.bitwise_count((more[x] ^ more[y]).view(np.uint64)), 0)
            ok = ((9 * apart <= size[x] + size[y]) | open_[x] | open_[y]) & (node[x] != node[y])
            xs.append(node[x[ok]])
            ys.append(node[y[ok]])
            held += len(xs[-1])
            if held >= MOST_PAIRS:
                yield once(xs, ys)
                xs, ys, held = [], [], 0
            t += 1
            left = left[limit[left] > t]
        if held:
            yield once(xs, ys)

    def run(batches):
        carry = {k: np.zeros(0, np.int64) for k in kept}
        large = False  # the open bucket has been found large; else carry has all its rows, none of them compared
        for columns in _joined(batches, kept):
            old = len(carry["key"])
            rows = {k: np.concatenate([carry[k], columns[k]]) for k in kept}
            token = rows["key"] >> RANK_BITS
            start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            length = np.diff(np.append(start, len(token)))
            first, rank = np.repeat(start, length), np.arange(len(token)) - np.repeat(start, length)
            kind = np.where(length > whole, 1, 0)  # 0 compared whole, 1 large, 2 waits for more rows
            if large and old:
                kind[0] = 1
            if kind[-1] == 0:
                kind[-1] = 2
            by_row = np.repeat(kind, length)
            limit = np.where(by_row == 0, rank, np.where(by_row == 1, np.minimum(rank, LEAD), 0))
            if large:
                limit[:old] = 0
            yield from pairs_of(rows, first, limit)
            rest = by_row == 1
            if large:
                rest[:old] = False
            if rest.any():
                rest = np.flatnonzero(rest)
                yield pa.RecordBatch.from_arrays([pa.array(rows["node"][rest]), pa.nulls(len(rest), pa.int64()), pa.array(rows["node"][first[rest]]), pa.array(rows["key"][rest]), pa.array(rows["info"][rest]), pa.array(rows["more"][rest])], schema=schema)
            large = kind[-1] == 1
            last = int(start[-1])
            carry = {k: v[last : last + LEAD if large else None].copy() for k, v in rows.items()}
        if not large and len(carry["key"]):
            yield from pairs_of(carry, np.zeros(len(carry["key"]), int), np.arange(len(carry["key"])))

    dealt = rows.select(*kept).repartition(bucket()).sortWithinPartitions("key")
    return dealt.mapInArrow(run, "x long, y long, lead long, key long, info long, more long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (x, y) whose token sets, from ``sets(node, tokens)``, link."""
    a = sets.select(F.col("node").alias("x"), F.col("tokens").alias("tx"))
    b = sets.select(F.col("node").alias("y"), F.col("tokens").alias("ty"))
    both = pairs.join(a, "x").join(b, "y")
    shared = F.size(F.array_intersect("tx", "ty"))
    return both.where(9 * shared >= 4 * (F.size("tx") + F.size("ty"))).select("x", "y")
