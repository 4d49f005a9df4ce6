"""Benchmark decontamination: one Aho-Corasick automaton over normalised items, run once over each text.

Texts and items are normalised alike: A-Z lower-cased, words are runs of ASCII letters, digits and anything beyond
ASCII, joined by one space. The automaton's patterns are all windows of ``WINDOW`` consecutive item words (a shorter
item is one window). Matches are word ranges of the text and map back to code point offsets of the original.

Only the benchmark is broadcast, and its size is checked: beyond ``BLOCK_BYTES`` it is scanned in blocks of items,
whose findings are merged per document, so no automaton grows with the benchmark.

Defined cases: a null or empty text has no words; a null item id or an item without words finds nothing; repeated
rows are scanned each; repeated items with one id count once; extra columns are ignored.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 10
#: an automaton of so many bytes of items takes some 420 MB in each worker
BLOCK_BYTES = 1 << 20

_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

SCHEMA = "doc_id long, n_words long, item_ids array<long>, ranges array<struct<start:int,stop:int>>, spans array<struct<start:int,stop:int>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def windows_of(items, window: int = WINDOW) -> dict[str, tuple[int, list[int]]]:
    """Pattern (spaces at both ends) to its number of words and item ids."""
    found: dict[str, tuple[int, list[int]]] = {}
    for item, text in items:
        words = words_of((text or "").encode())
        for i in range(max(1, len(words) - window + 1) if words else 0):
            part = words[i : i + window]
            ids = found.setdefault(f" {b' '.join(part).decode()} ", (len(part), []))[1]
            if item not in ids:
                ids.append(item)
    return found


def _scanner(windows):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for pattern, value in windows.items():
        automaton.add_word(pattern, value)
    automaton.make_automaton()

    def scan(text: bytes) -> tuple[int, list[int], list[tuple[int, int]]]:
        """Number of words, item ids, and the merged word ranges inside matches."""
        words = words_of(text)
        if not words or not windows:
            return len(words), [], []
        normal = f" {b' '.join(words).decode()} "
        items, ranges, at, spaces = set(), [], 0, 0
        for end, (n, ids) in automaton.iter(normal):
            spaces += normal.count(" ", at, end + 1)
            at = end + 1
            items.update(ids)
            start, stop = spaces - 1 - n, spaces - 1
            while ranges and ranges[-1][1] >= start:
                start = min(start, ranges.pop()[0])
            ranges.append((start, stop))
        return len(words), sorted(items), ranges

    return scan


def spans_of(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point offsets, in the text as it is, of ranges of its words."""
    if not ranges:
        return []
    wanted = {i for a, b in ranges for i in (a, b - 1)}
    at = {i: m.span() for i, m in enumerate(_WORD.finditer(text)) if i in wanted}
    return [(at[a][0], at[b - 1][1]) for a, b in ranges]


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The items, in so many blocks that each is small enough to broadcast."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    held = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n = max(1, math.ceil(held / block_bytes))
    return [items] if n == 1 else [items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == block) for block in range(n)]


def without_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, in whose text no window of the benchmark occurs."""
    for items in _blocks(benchmark, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in items.collect()])

        def run(batches, shared=shared):
            find = _scanner(windows_of(shared.value, window))
            for batch in batches:
                clean = [not find(text.as_py() or b"")[1] for text in batch["text"].cast(pa.large_binary())]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, the items found, the word ranges that are hit and their spans in the text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = _blocks(benchmark, block_bytes)
    for k, items in enumerate(blocks):
        docs = _scan_block(docs, items, window, k > 0, k == len(blocks) - 1)
    return docs


def _union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges with those that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(ranges):
        if out and out[-1][1] >= start:
            start, stop = out[-1][0], max(stop, out.pop()[1])
        out.append((start, stop))
    return out


def _scan_block(docs: DataFrame, items: DataFrame, window: int, later: bool, last: bool) -> DataFrame:
    """Looks for one block of items; a ``later`` block adds to what the rows have, and all but the ``last`` keep the text."""
    shared = docs.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in items.collect()])
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches):
        find = _scanner(windows_of(shared.value, window))
        for batch in batches:
            n_words, ids, ranges, spans = [], [], [], []
            before = zip(batch["item_ids"].to_pylist(), batch["ranges"].to_pylist()) if later else iter(lambda: ([], []), None)
            for text, (old, were) in zip(batch["text"].cast(pa.large_binary()), before):
                text = text.as_py() or b""
                n, found, where = find(text)
                where = _union([*where, *((r["start"], r["stop"]) for r in were)]) if were else where
                n_words.append(n)
                ids.append(sorted({*old, *found}))
                ranges.append([{"start": a, "stop": b} for a, b in where])
                spans.append([{"start": a, "stop": b} for a, b in spans_of(text.decode(), where)] if last and where else [])
            columns = [batch["doc_id"], pa.array(n_words, pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array(ranges, span), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays(columns + ([] if last else [batch["text"]]), ["doc_id", "n_words", "item_ids", "ranges", "spans"] + ([] if last else ["text"]))

    return docs.mapInArrow(run, SCHEMA + ("" if last else ", text string"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the report: counts, and the hash of the item ids sorted as strings."""
    hit = F.expr("aggregate(ranges, 0L, (n, r) -> n + r.stop - r.start)")
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
