"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

A piece of length n belongs to class k = capacity // n, and a sequence of class k holds exactly k of its pieces. Whole
sequences are cut off a document first; the rest stays whole where k such pieces fill a sequence well, and is else cut
once, at a reciprocal of the capacity, so that both parts fall just under the top of their classes. Tasks fill their
sequences on their own. The pieces that are left of unfilled ones (fewer than k a class and task) meet in blocks of
``FAN_IN`` tasks, level by level, and what the last block leaves is filled by best fit. No step holds more than the
pieces of one block.

Defined cases: a null text counts as empty and has the end token only; repeated rows are packed each; a null doc_id
stays null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Workspace

CAPACITY = 2048
END = 1
FAN_IN = 64
#: a cut is worth so many tokens of padding
CUT_COST = 12
LEAST_CUT = 32

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, task long"
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "task"]
#: fixed value: how a byte-level vocabulary of this kind splits a text
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LONG_BLANK = re.compile(r"\s{1000}")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids as little-endian 32-bit bytes.

    The vocabulary of the file is also read as merge ranks, with which the same ids are found several times faster. That
    needs ids in the order of the merges and the usual split of a byte-level vocabulary; any other file, texts that hold
    a special token's string, and texts with very long blanks are left to the file's own tokenizer.
    """

    def __init__(self, path: str):
        self.path, self.own = path, None
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.special = [t["content"] for t in file["added_tokens"]]
        self.ranks = _as_ranks(file)

    def tokenizer(self):
        """The file's own tokenizer; it takes more memory than the ranks, so only texts that need it load it."""
        if self.own is None:
            from tokenizers import Tokenizer

            self.own = Tokenizer.from_file(self.path)
        return self.own

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if self.ranks is None or any(s in text for s in self.special) or _LONG_BLANK.search(text):
            return np.array(self.tokenizer().encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


def _as_ranks(file: dict):
    """The byte-level vocabulary as merge ranks; None where these would not give the same ids."""
    import tiktoken

    model, split = file["model"], file["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or file["normalizer"] or split.get("type") != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
        return None
    # each byte is written as one visible character: itself, or the next one from 256 on
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t["content"] for t in file["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    if [model["vocab"].get(m) for m in merged] != list(range(256, 256 + len(merged))) or len(ranks) != 256 + len(merged):
        return None
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(4)
def cuts(capacity: int) -> list[list[int]]:
    """For each length below the capacity, the lengths of its pieces."""
    waste = [0.0] + [capacity / (capacity // n) - n for n in range(1, capacity + 1)]
    out: list[list[int]] = [[]]
    tops = sorted({capacity // k for k in range(2, capacity // LEAST_CUT + 1)})
    for n in range(1, capacity):
        best, parts = waste[n], [n]
        for top in tops:
            if LEAST_CUT <= n - top and (cost := waste[top] + waste[n - top] + CUT_COST) < best:
                best, parts = cost, [top, n - top]
        out.append(parts)
    return out


class _Filler:
    """Open sequences by class; a row is (doc_id, start, length, crc, doc_tokens)."""

    def __init__(self, capacity: int, base: int):
        self.capacity, self.next, self.open, self.done = capacity, base, {}, []

    def add(self, row: tuple) -> None:
        k = self.capacity // row[2]
        if k == 1:
            return self.close([row])
        waiting = self.open.setdefault(k, [])
        waiting.append(row)
        if len(waiting) == k:
            self.close(self.open.pop(k))

    def close(self, rows: list[tuple]) -> None:
        offset = 0
        for row in rows:
            self.done.append((*row, self.next, offset))
            offset += row[2]
        self.next += 1

    def rest(self) -> list[tuple]:
        return [row for rows in self.open.values() for row in rows]

    def best_fit(self, rows: list[tuple]) -> None:
        """Longest first, each into the fullest sequence that takes it."""
        room: list[tuple[int, int]] = []
        bins: list[list[tuple]] = []
        for row in sorted(rows, key=lambda r: -r[2]):
            i = bisect_left(room, (row[2], -1))
            left, at = room.pop(i) if i < len(room) else (self.capacity, len(bins))
            if at == len(bins):
                bins.append([])
            bins[at].append(row)
            insort(room, (left - row[2], at))
        for rows in bins:
            self.close(rows)


def _batch(done: list[tuple], rest: list[tuple], task: int) -> pa.RecordBatch:
    columns = list(zip(*done, *[(*r, None, None) for r in rest])) if done or rest else [[]] * 7
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array([None] * len(done) + [task] * len(rest), pa.int64())], _NAMES)


def _first(docs: DataFrame, capacity: int, path: str) -> DataFrame:
    def run(batches):
        task = TaskContext.get().partitionId()
        fill, parts = _Filler(capacity, task << 32), cuts(capacity)
        encode = encoder(path).ids
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                ids = memoryview(encode(text.as_py() or "") + end)
                n, start = len(ids) // 4, 0
                for length in [capacity] * (n // capacity) + parts[n % capacity]:
                    fill.add((doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n))
                    start += length
            if fill.done:
                yield _batch(fill.done, [], task)
                fill.done = []
        yield _batch([], fill.rest(), task)

    return docs.mapInArrow(run, PIECES)


def _again(rest: DataFrame, capacity: int, level: int, last: bool) -> DataFrame:
    def run(key, table):
        block = key[0].as_py()
        fill = _Filler(capacity, (level << 58) | (block << 32))
        rows = sorted(zip(*(table[c].to_pylist() for c in _NAMES[:5])), key=lambda r: (-r[2], str(r[0]), r[1]))
        for row in rows:
            fill.add(row)
        left = fill.rest()
        if last:
            fill.best_fit(left)
            left = []
        return pa.Table.from_batches([_batch(fill.done, left, block)])

    blocks = rest.withColumn("block", F.expr(f"task div {FAN_IN}"))
    return blocks.groupBy("block").applyInArrow(run, PIECES)


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a byte-level vocabulary that every worker can open.
    """
    path = tokenizer or default_tokenizer()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    work = Workspace(docs.sparkSession, "packing")
    now = work.keep(_first(docs, capacity, path), "level0")
    out, level = now.where("task is null"), 0
    while True:
        rest = now.where("task is not null")
        top = rest.agg(F.max("task")).first()[0]
        if top is None:
            break
        level, last = level + 1, top < FAN_IN
        now = work.keep(_again(rest, capacity, level, last), f"level{level}")
        out = out.unionByName(now.where("task is null"))
        if last:
            break
    return out.drop("task")
