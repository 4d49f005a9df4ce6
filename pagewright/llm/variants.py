"""Spelling variants: words one edit apart, found by the one-edit neighbourhoods of their reduced spellings.

Every letter is hashed to one of ``SYMBOLS`` symbols. Two words that differ by one inserted, deleted or replaced letter
have reduced spellings that are equal or differ by one edit too, so all neighbours of a word are among the words whose
reduced spelling lies in the full neighbourhood of its own. That neighbourhood has some 15 spellings a letter, of which
only those that the vocabulary may have leave the task; what meets in the join is verified on the words as they are.

Defined cases: a null or empty text has no words; with a null id nothing is deleted from a run; repeated rows count each;
an empty table gives no rows; extra columns are ignored. A text is processed whole, in one task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .marks import Marks, marks_of
from .storage import Workspace
from .textnum import FOLD, blocks
from .wordcount import Counts, words_at

LEAST_LETTERS, LEAST_COUNT, RATIO = 6, 5, 5
#: one run in so many loses a letter
DELETE_EVERY = 199
BITS = 3
SYMBOLS = 1 << BITS
#: longer words have codes modulo 2**64, which cost comparisons where they collide and lose nothing
EXACT_LETTERS = 20
#: codes made at once
STEP_CODES = 1 << 20
LONG_RUN = 64
#: Spark sizes both sides of these joins by the files of the vocabulary, packed and before a word becomes its neighbourhood,
#: so it would collect either side on the driver
JOIN = "merge"

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[0xC3] = True
#: a letter's symbol by its place: a-z by the byte, the letters from U+00C0 on by their second byte
_SYMBOL = np.array([zlib.crc32(bytes([b])) >> 7 & (SYMBOLS - 1) for b in range(256)], np.uint64)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def runs_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every run of letters a-z and U+00C0 to U+00FF in folded UTF-8; no run crosses an offset."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # 0xC3 leads exactly the code points from U+00C0 to U+00FF
    letter = _LETTER[data]
    letter[1:] |= data[:-1] == 0xC3
    return words_at(letter, offsets)


def run_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each run after what ``before`` is the CRC-32 of."""
    lengths = ends - starts
    order = np.argsort(-np.minimum(lengths, LONG_RUN + 1), kind="stable")
    lengths, at = lengths[order], starts[order]
    crc = before[order] ^ np.uint32(0xFFFFFFFF)
    n_long = int(np.searchsorted(-lengths.clip(max=LONG_RUN + 1), -LONG_RUN, "left"))
    for j in range(int(lengths[n_long]) if n_long < len(lengths) else 0):
        stop = int(np.searchsorted(-lengths[n_long:], -j, "left")) + n_long
        some = slice(n_long, stop)
        crc[some] = _CRC[(crc[some] ^ data[at[some] + j]) & np.uint32(255)] ^ (crc[some] >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for k in range(n_long):
        crc[k] = zlib.crc32(data[at[k] : at[k] + lengths[k]].tobytes(), int(before[order[k]]))
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _counted(batches):
    """(word, n) of the texts in ``batches``, summed up by task."""
    counts = Counts("word")
    for batch in batches:
        ids = batch["doc_id"].to_pylist()
        for low, high, data, offsets in blocks(batch["text"], 1 << 22):
            data = FOLD[data]
            starts, ends = runs_of(data, offsets)
            doc = np.searchsorted(offsets, starts, "right") - 1
            has_id = np.array([i is not None for i in ids[low:high]], bool)
            before = np.array([zlib.crc32(f"{i}:".encode()) for i in ids[low:high]], np.uint32)
            crc = run_crcs(data, starts, ends, before[doc])
            cut = (crc % np.uint32(DELETE_EVERY) == 0) & has_id[doc]
            shorter = []
            for start, end, h in zip(starts[cut].tolist(), ends[cut].tolist(), crc[cut].tolist()):
                run = data[start:end].tobytes().decode()
                at = h % len(run)
                shorter.append((run[:at] + run[at + 1 :]).encode())
            letters = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])
            whole = ~cut & (letters[ends] - letters[starts] >= LEAST_LETTERS)
            counts.add_spans(data, starts[whole], ends[whole])
            counts.add(pa.array([w for w in shorter if len(w.decode()) >= LEAST_LETTERS], pa.binary()))
            yield from counts.full()
    yield from counts.rest()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): words of ``LEAST_LETTERS`` code points and ``LEAST_COUNT`` occurrences, after runs have lost letters."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = docs.mapInArrow(_counted, "word binary, n long").groupBy(F.col("word").cast("string").alias("word")).agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= LEAST_COUNT)


def symbols_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all letters, and where each word starts (one entry more than words)."""
    words = words.cast(pa.large_binary())
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if len(words) else np.zeros(0, np.uint8)
    kept = data != 0xC3
    return _SYMBOL[data[kept]], np.concatenate([[0], np.cumsum(kept)])[offsets - offsets[0]]


def _code(symbols: np.ndarray) -> np.ndarray:
    """The code of each row: its symbols as digits after a leading one."""
    out = np.ones(len(symbols), np.uint64)
    for j in range(symbols.shape[1]):
        out = out * np.uint64(SYMBOLS) + symbols[:, j]
    return out if symbols.shape[1] <= EXACT_LETTERS else _long_code(symbols)


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _long_code(symbols: np.ndarray) -> np.ndarray:
    out = np.ones(len(symbols), np.uint64)
    for j in range(symbols.shape[1]):
        out = out * _STEP + symbols[:, j] + np.uint64(1)
    return out


def neighbourhood(symbols: np.ndarray) -> np.ndarray:
    """Codes of every spelling at most one edit from each row: itself, all deletions, replacements and insertions."""
    n, length = symbols.shape
    letters = np.arange(SYMBOLS, dtype=np.uint64)[None, :]

    def edited(size: int) -> list[np.ndarray]:
        """Codes of the edited spellings of ``size`` letters."""
        if size <= EXACT_LETTERS:
            step, digit = np.uint64(SYMBOLS), symbols
            of = letters
        else:
            step, digit, of = _STEP, symbols + np.uint64(1), letters + np.uint64(1)
        power = np.array([pow(int(step), j, 1 << 64) for j in range(size + 1)], np.uint64)
        # code of what stands before each place, and value of what stands from it on
        head, tail = np.ones((n, length + 1), np.uint64), np.zeros((n, length + 1), np.uint64)
        for j in range(length):
            head[:, j + 1] = head[:, j] * step + digit[:, j]
        for j in range(length - 1, -1, -1):
            tail[:, j] = digit[:, j] * power[length - 1 - j] + tail[:, j + 1]
        if size == length - 1:
            return [head[:, j] * power[length - 1 - j] + tail[:, j + 1] for j in range(length)]
        if size == length:
            return [(head[:, j, None] * step + of) * power[length - 1 - j] + tail[:, j + 1, None] for j in range(length)]
        return [(head[:, j, None] * step + of) * power[length - j] + tail[:, j, None] for j in range(length + 1)]

    return np.concatenate([np.stack(edited(length - 1), 1), *edited(length), *edited(length + 1)], 1)


def _by_length(words: pa.Array):
    """(rows, symbols) of words of one length, in steps."""
    symbols, first = symbols_of(words)
    lengths = np.diff(first)
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        step = max(1, STEP_CODES // (2 * (length + 1) * SYMBOLS))
        for k in range(0, len(rows), step):
            some = rows[k : k + step]
            yield some, symbols[first[some][:, None] + np.arange(length)]


def _with_codes(batches):
    for batch in batches:
        codes = np.zeros(len(batch), np.uint64)
        for rows, symbols in _by_length(batch["word"]):
            codes[rows] = _code(symbols)
        yield pa.RecordBatch.from_arrays([batch["word"], batch["n"], pa.array(codes.view(np.int64))], ["word", "n", "code"])


def near_pairs(coded: DataFrame, marks: Marks) -> DataFrame:
    """(word, n, near, near_n) for every two words of ``coded(word, n, code)`` that are one edit apart, both ways."""
    shared = coded.sparkSession.sparkContext.broadcast(marks)

    def neighbours(batches):
        for batch in batches:
            for rows, symbols in _by_length(batch["word"]):
                codes = neighbourhood(symbols)
                found = np.nonzero(shared.value.holds(codes.ravel()).reshape(codes.shape))
                row, code = found[0], codes[found]
                order = np.lexsort((code, row))
                row, code = row[order], code[order]
                once = np.ones(len(row), bool)
                once[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
                row, code = pa.array(rows[row[once]]), code[once]
                yield pa.RecordBatch.from_arrays([batch["word"].take(row), batch["n"].take(row), pa.array(code.view(np.int64))], ["word", "n", "code"])

    left = coded.select("word", "n").mapInArrow(neighbours, "word string, n long, code long")
    right = coded.select(F.col("word").alias("near"), F.col("n").alias("near_n"), "code")
    return left.join(right.hint(JOIN), "code").where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")


def roots(forms: DataFrame, work: Workspace) -> DataFrame:
    """(word, root) of ``forms(word, form)``: the last word that the forms lead to.

    A form is at least five times as frequent as its word, so a way has few steps; each round halves what is left of it.
    """
    now = work.keep(forms.select("word", F.col("form").alias("root"), F.lit(False).alias("ended")), "roots0")
    step = 0
    while now.where("not ended").limit(1).count():
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step += 1
        then = now.join(ahead.hint(JOIN), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNull().alias("ended"))
        now = work.keep(then, f"roots{step}")
        work.drop(f"roots{step - 1}")
    return now.select("word", "root")


def group_variants(docs: DataFrame) -> DataFrame:
    """Each word with its form (the most frequent near word, where it is ``RATIO`` times as frequent) and root."""
    work = Workspace(docs.sparkSession, "variants")
    coded = work.keep(vocabulary(docs).mapInArrow(_with_codes, "word string, n long, code long"), "words")
    pairs = near_pairs(coded, marks_of(coded, "code"))
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = coded.select("word", "n").join(near.hint(JOIN), "word", "left")
    fits = -F.col("best.minus") >= RATIO * F.col("n")
    words = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.minus")).alias("form_n"))
    words = work.keep(words, "forms")
    out = words.join(roots(words.where("form is not null"), work).hint(JOIN), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
