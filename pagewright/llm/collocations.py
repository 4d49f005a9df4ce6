"""Collocations: frequent phrases by language, counted with broadcast double-array tries and scored at their weakest cut.

Texts are written once as rows of word numbers, in which only words frequent enough for a phrase have one. Phrases then
grow a word a level. A phrase can only be frequent if the two phrases a word shorter in it are, and if the counter that
its occurrences share with others passes the threshold; what is left are the candidates. They go into tries of at most
``MOST_PHRASES``; each is broadcast, all positions of a text step through it together, and the tasks' counts are added.

Nothing grows on the driver or in a broadcast but by number of tries: candidates are collected a trie at a time, and a
task holds one trie at a time. Counters are spread over the tasks of a shuffle.

Defined cases: a null or empty text has no words; a null lang is ``und``, and an empty one is its own; a null id and
repeated rows count as any other row; an empty table gives no rows; extra columns are ignored. A text is processed whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import Workspace
from .textnum import FOLD, blocks, mix
from .trie import Trie
from .wordcount import Counts, spans, words_at

LEAST, LONGEST, MOST_RANKS = 100, 5, 2000
#: phrases in a trie, and words in a broadcast part of the vocabulary
MOST_PHRASES, MOST_WORDS = 500_000, 2_000_000
TEXT_BYTES = 4 << 20
#: distinct keys that a task holds before it hands them on
HELD_KEYS = 1 << 22
#: keys of a shuffled part, about
PART_KEYS = 1 << 22
SALTS = 64

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?"]] = True
_BREAK[10:14] = True
_INSIDE = ~_BREAK
_INSIDE[[0x20, 0x09]] = False


def _by_lang(batch):
    """(lang, texts) of a batch's rows."""
    for lang in pc.unique(batch["lang"]).to_pylist():
        yield lang, batch["text"].filter(pc.equal(batch["lang"], lang))


def _pieces(texts, limit: int = TEXT_BYTES):
    """For blocks of texts: folded bytes, the words' starts and ends, and whether each starts a piece."""
    for _, _, data, offsets in blocks(texts, limit):
        data = FOLD[data]
        starts, ends = words_at(_INSIDE[data], offsets)
        breaks = np.concatenate([[0], np.cumsum(_BREAK[data])])
        first = np.ones(len(starts), bool)
        doc = np.searchsorted(offsets, starts, "right")
        first[1:] = (breaks[starts[1:]] > breaks[ends[:-1]]) | (doc[1:] != doc[:-1])
        yield data, starts, ends, first


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of all words."""

    def run(batches):
        counts: dict[str, Counts] = {}
        for batch in batches:
            for lang, texts in _by_lang(batch):
                own = counts.setdefault(lang, Counts("word"))
                for data, starts, ends, _ in _pieces(texts):
                    own.add_spans(data, starts, ends)
                    yield from (_with_lang(b, lang) for b in own.full())
        for lang, own in counts.items():
            yield from (_with_lang(b, lang) for b in own.rest())

    counted = docs.mapInArrow(run, "lang string, word binary, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).select("lang", F.col("word").cast("string").alias("word"), "n")


def _with_lang(batch, lang):
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(batch), pa.string()), batch["word"], batch["n"]], ["lang", "word", "n"])


class Shards:
    """Broadcast parts, of which a task holds one at a time."""

    def __init__(self, spark, parts):
        self.parts = [spark.sparkContext.broadcast(p) for p in parts]

    def __iter__(self):
        for part in self.parts:
            yield part.value
            if len(self.parts) > 1:
                vars(part).pop("_value", None)


def numbered(words: DataFrame, work: Workspace) -> tuple[DataFrame, int]:
    """``words`` with numbers from 1 in ``id``, and the largest; numbers of one language in one shard follow each other."""
    n = words.count()
    shards, tables, last = max(1, math.ceil(n / MOST_WORDS)), [], 0
    for s in range(shards):
        part = words.where(F.pmod(F.xxhash64("word"), F.lit(shards)) == s).orderBy("lang", "word").toArrow()
        part = part.append_column("id", pa.array(np.arange(last + 1, last + 1 + len(part), dtype=np.int32)))
        part = part.append_column("shard", pa.array(np.full(len(part), s, np.int32)))
        last += len(part)
        tables.append(work.keep(words.sparkSession.createDataFrame(part), f"words{s}"))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out, last


def _vocabularies(vocabulary: DataFrame):
    """For each shard: lang to its words, as a sorted array, and the first one's number."""
    for s in sorted(r.shard for r in vocabulary.select("shard").distinct().collect()):
        part = vocabulary.where(F.col("shard") == s).orderBy("id").select("lang", F.col("word").cast("binary").alias("word"), "id").toArrow()
        own = {}
        for lang in pc.unique(part["lang"]).to_pylist():
            rows = part.filter(pc.equal(part["lang"], lang))
            own[lang] = (rows["word"].combine_chunks(), rows["id"][0].as_py())
        yield own


def encode(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(n, ids): texts as numbers of 32 bits, with 0 at both ends and wherever a phrase can't go on."""
    shards = Shards(docs.sparkSession, _vocabularies(vocabulary))

    def run(batches):
        for batch in batches:
            for lang, texts in _by_lang(batch):
                for data, starts, ends, first in _pieces(texts):
                    words = spans(data, starts, ends)
                    ids = np.zeros(len(words), np.int32)
                    for shard in shards:
                        if lang in shard:
                            values, number = shard[lang]
                            at = pc.index_in(words, value_set=values.cast(words.type))
                            ids += at.fill_null(-number).to_numpy(zero_copy_only=False).astype(np.int32) + np.int32(number)
                    text = np.zeros(2 * len(ids) + 1, np.int32)
                    text[1::2] = ids
                    kept = np.ones(len(text), bool)
                    kept[:-1:2] = first
                    text = text[kept]
                    # a word between two breaks is in no phrase; of several breaks one is left
                    alone = np.zeros(len(text), bool)
                    alone[1:-1] = (text[:-2] == 0) & (text[2:] == 0)
                    text[alone] = 0
                    kept = np.ones(len(text), bool)
                    kept[1:] = (text[1:] != 0) | (text[:-1] != 0)
                    text = text[kept]
                    if len(text) > 1:
                        yield pa.RecordBatch.from_pydict({"n": pa.array([len(text)], pa.int64()), "ids": pa.array([text.tobytes()], pa.binary())})

    return docs.mapInArrow(run, "n long, ids binary")


class Sums:
    """Counts by key that a task adds up, and hands on in parts."""

    def __init__(self, parts: int):
        self.parts, self.keys, self.counts, self.held = parts, [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        if len(keys):
            self.keys.append(keys)
            self.counts.append(counts)
            self.held += len(keys)

    def _merge(self) -> None:
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.keys, self.counts = [keys[start]], [np.add.reduceat(counts, start)]
        self.held = len(start)

    def full(self):
        if self.held > 2 * HELD_KEYS:
            self._merge()
            if self.held > HELD_KEYS:
                yield from self.rest()

    def rest(self):
        if self.held:
            self._merge()
            keys, counts = self.keys[0], self.counts[0].astype(np.uint32)
            # keys are spread by their low bits, so each part has its share
            part = (keys % np.uint64(self.parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(self.parts + 1))
            for p in range(self.parts):
                some = order[cuts[p] : cuts[p + 1]]
                if len(some):
                    yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "keys": pa.array([keys[some].tobytes()], pa.binary()), "counts": pa.array([counts[some].tobytes()], pa.binary())})
            self.keys, self.counts, self.held = [], [], 0


PACKED = "part int, keys binary, counts binary"


def _added(packed: DataFrame, parts: int, least: int) -> DataFrame:
    """(key, n) of the keys that come to ``least`` in all."""

    def run(batches):
        totals: dict[int, Sums] = {}
        for batch in batches:
            for part, keys, counts in zip(batch["part"].to_pylist(), batch["keys"], batch["counts"]):
                own = totals.setdefault(part, Sums(1))
                own.add(np.frombuffer(keys.as_py(), np.uint64), np.frombuffer(counts.as_py(), np.uint32).astype(np.int64))
                if own.held > 2 * HELD_KEYS:
                    own._merge()
        for own in totals.values():
            own._merge()
            enough = own.counts[0] >= least
            if enough.any():
                yield pa.RecordBatch.from_pydict({"key": pa.array(own.keys[0][enough].view(np.int64)), "n": pa.array(own.counts[0][enough])})

    return packed.repartition(parts, "part").mapInArrow(run, "key long, n long")


def _texts(batches):
    for batch in batches:
        for ids in batch["ids"]:
            yield np.frombuffer(ids.as_buffer(), np.int32)


def _pairs(text: np.ndarray, tries: Shards | None) -> np.ndarray:
    """For every position where a frequent phrase starts and one at the next, both numbers in one key."""
    state = text
    if tries is not None:
        state = np.zeros(len(text), np.int64)
        for trie in tries:
            at, row = trie.ends_at(text)
            state[at] = trie.numbers[row]
    now, then = state[:-1].astype(np.uint64), state[1:].astype(np.uint64)
    both = (now > 0) & (then > 0)
    return now[both] << np.uint64(32) | then[both]


def _counters(keys: np.ndarray, bits: int) -> np.ndarray:
    return mix(keys) >> np.uint64(64 - bits)


def _candidates(texts: DataFrame, tries: Shards | None, positions: int, work: Workspace, name: str) -> DataFrame:
    """(u, v): phrases that overlap in all but a word and may be ``LEAST`` times frequent together."""
    spark, parts = texts.sparkSession, max(32, math.ceil(positions / PART_KEYS))
    bits = min(60, max(32, positions.bit_length() + 5))

    def count(batches):
        sums = Sums(parts)
        for text in _texts(batches):
            sums.add(_counters(_pairs(text, tries), bits))
            yield from sums.full()
        yield from sums.rest()

    passed = work.keep(_added(texts.mapInArrow(count, PACKED), parts, LEAST).select("key"), f"{name}-counters")
    n = max(1, math.ceil(passed.count() / MOST_PHRASES))
    keys = (np.sort(passed.where(F.pmod("key", F.lit(n)) == s).toArrow()["key"].to_numpy().view(np.uint64)) for s in range(n))
    shards = Shards(spark, keys)

    def seen(batches):
        sums = Sums(parts)
        for text in _texts(batches):
            pairs = _pairs(text, tries)
            counters = _counters(pairs, bits)
            for keys in shards:
                flags = np.zeros(1 << 22, bool)
                flags[keys >> np.uint64(bits - 22)] = True
                may = np.flatnonzero(flags[counters >> np.uint64(bits - 22)])
                at = np.minimum(np.searchsorted(keys, counters[may]), max(0, len(keys) - 1))
                sums.add(pairs[may[keys[at] == counters[may]]] if len(keys) else pairs[:0])
            yield from sums.full()
        yield from sums.rest()

    pairs = _added(texts.mapInArrow(seen, PACKED), parts, 1)
    out = work.keep(pairs.select(F.shiftrightunsigned("key", 32).alias("u"), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("v")), f"{name}-candidates")
    work.drop(f"{name}-counters")
    return out


def count_phrases(texts: DataFrame, trie: Trie, least: int, parts: int = 32) -> np.ndarray:
    """Occurrences of each phrase of one trie in all texts; what stays below ``least`` is 0."""
    shared, n = texts.sparkSession.sparkContext.broadcast(trie), int(trie.ends.max(initial=0))

    def run(batches):
        total = np.zeros(n + 1, np.int64)
        for text in _texts(batches):
            total += np.bincount(shared.value.ends_at(text)[1], minlength=n + 1)
        found = np.flatnonzero(total)
        sums = Sums(parts)
        sums.add(found.astype(np.uint64), total[found])
        yield from sums.rest()

    found = _added(texts.mapInArrow(run, PACKED), parts, least).toArrow()
    out = np.zeros(n, np.int64)
    out[found["key"].to_numpy() - 1] = found["n"].to_numpy()
    return out


def _grown(texts: DataFrame, level: DataFrame, candidates: DataFrame, n_words: int, last: bool, work: Workspace, name: str):
    """The frequent ones among the candidates: a table like ``level``, and the tries that find them."""
    spark = texts.sparkSession
    ahead = candidates.join(level.select(F.col("id").alias("u"), "lang", "phrase", "words"), "u")
    behind = level.select(F.col("id").alias("v"), F.element_at("words", -1).alias("word"), F.element_at(F.split("phrase", " "), -1).alias("last"))
    every = ahead.join(behind, "v").select("lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), F.concat("words", F.array("word")).alias("words"))
    every = work.keep(every, f"{name}-joined")
    n, tables, tries, given = max(1, math.ceil(every.count() / MOST_PHRASES)), [], [], 0
    for s in range(n):
        part = every.where(F.pmod(F.xxhash64("words"), F.lit(n)) == s).toArrow()
        words = part["words"].combine_chunks()
        trie = Trie(words.flatten().to_numpy().reshape(len(part), -1), n_words) if len(part) else None
        if trie is None:
            continue
        counts = count_phrases(texts, trie, LEAST)
        kept = np.flatnonzero(counts)
        numbers = np.arange(given + 1, given + 1 + len(kept), dtype=np.int64)
        given += len(kept)
        trie.numbers = np.zeros(len(counts) + 1, np.int64)
        trie.numbers[kept + 1] = numbers
        part = part.take(pa.array(kept)).append_column("a", pa.array(counts[kept])).append_column("id", pa.array(numbers))
        tables.append(work.keep(spark.createDataFrame(part, "lang string, phrase string, words array<int>, a long, id long"), f"{name}-{s}"))
        if not last and len(kept):
            tries.append(trie)
    work.drop(f"{name}-joined")
    out = tables[0] if tables else None
    for t in tables[1:]:
        out = out.unionByName(t)
    return out, Shards(spark, tries) if tries else None


def frequent_phrases(docs: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, length, a) of all phrases of one to ``LONGEST`` words that are ``LEAST`` times there, and (lang, n)."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = work.keep(word_counts(docs), "counts")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    vocabulary, n_words = numbered(words.where(F.col("n") >= LEAST), work)
    phrases = vocabulary.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("length"), F.col("n").alias("a"))
    texts = work.keep(encode(docs, vocabulary), "texts")
    positions = texts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    level = vocabulary.select("id", "lang", F.col("word").alias("phrase"), F.array("id").alias("words"))
    tries = None
    for length in range(2, LONGEST + 1):
        found = _candidates(texts, tries, positions, work, f"level{length}")
        level, tries = _grown(texts, level, found, n_words, length == LONGEST, work, f"level{length}")
        work.drop(f"level{length}-candidates")
        if level is None:
            break
        phrases = phrases.unionByName(level.select("lang", "phrase", F.lit(length).alias("length"), "a"))
        if tries is None:
            break
    work.drop("texts")
    return phrases, totals


def _part(start, n):
    return F.array_join(F.slice("w", start, n), " ")


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n and score of every phrase of several words, at its weakest cut."""
    known = lambda name, of: phrases.select("lang", F.col("phrase").alias(of), F.col("a").alias(name))
    cuts = phrases.where("length > 1").withColumn("w", F.split("phrase", " ")).select("*", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "length", "a", "k", _part(F.lit(1), F.col("k")).alias("first"), _part(F.col("k") + 1, F.col("length") - F.col("k")).alias("rest"))
    cuts = cuts.join(known("l", "first"), ["lang", "first"]).join(known("r", "rest"), ["lang", "rest"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    over = (F.lit(1000).cast("decimal(38,0)") * wide("a")).cast("decimal(38,0)") * wide("n")
    cuts = cuts.withColumns({"over": over.cast("decimal(38,0)"), "under": (wide("l") * wide("r")).cast("decimal(38,0)")}).withColumn("score", F.expr("over div under"))
    return cuts.groupBy("lang", "phrase", "length", "a").agg(F.min(F.struct("score", "k", "l", "r", "n")).alias("c")).select("lang", "phrase", "length", "a", "c.l", "c.r", "c.n", "c.score")


def without_parts(found: DataFrame, phrases: DataFrame) -> DataFrame:
    """``found`` without phrases that lie inside a longer one as frequent as they are."""
    longer = phrases.where("length > 2").withColumn("w", F.split("phrase", " "))
    sizes = F.flatten(F.transform(F.sequence(F.lit(2), F.col("length") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("length") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))
    inside = longer.select("lang", F.explode(F.array_distinct(sizes)).alias("phrase"), F.col("a").alias("most")).groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    return found.join(inside, ["lang", "phrase"], "left").where("most is null or 100 * most < 100 * a").drop("most")


def collocations(docs: DataFrame, most: int = MOST_RANKS) -> DataFrame:
    """The first ``most`` of each lang by score, count and phrase."""
    work = Workspace(docs.sparkSession, "collocations")
    phrases, totals = frequent_phrases(docs, work)
    phrases = work.keep(phrases, "phrases")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    found = without_parts(scored(phrases, totals), phrases).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= most)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
