"""Line dedup: an exact set-similarity join of lines, of which later matches are removed.

A line is the set of its distinct words (white-space words, A-Z lower-cased). Two lines match when their Jaccard
similarity is 0.8 or more. A line is removed when an earlier line matches it, earlier by (doc_id, line number); the
rest of its text stays as it is. Lines of fewer than ``least`` distinct words stay: with 1 every line that has a word
takes part, as in the query; the pipeline leaves lines of fewer than ``LEAST_WORDS`` alone.

Words are ordered by rarity (counted over all lines); lines that share a word in their prefixes are compared under
the length, positional and parity filters, and verified on their sets. Equal lines are one node first. A line that has
an earlier match needs no other, so each is verified with its first candidate before the others, large buckets meet
their first lines only, and just lines without an earlier match are taken on to the rest.

Defined cases: a null text stays null, and a text without words stays as it is; a null doc_id comes after all others;
rows equal in doc_id and text are one document, kept alike; a text whose lines are all removed is empty; an empty table
gives no rows; ``docs`` may have any further columns, whatever their names, which are kept.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import prefixjoin as P
from .marks import marks_of, with_marks
from .sketch import levels as sketch_levels
from .storage import Workspace
from .textnum import FOLD, SPACE, blocks, distinct_in_segments, hashed_words, lines_of, set_hashes, word_hashes, word_spans

LEAST_WORDS = 5
#: smaller sets only link with their equals, which are one node: 3 of 4 words are no 80 %
LEAST_NEAR = 4
#: counters for word frequencies: 4 MB of levels, whatever the input
BITS = 22
WHOLE = 512
#: the rows of prefixes are dealt in so many passes, each with buckets of its own, so that only a part of them is on disk at a time
PASSES = 2
#: places in a task's table of nodes that it has met
MET_BITS = 17
LAST = 2**63 - 1


def _distinct(words, first, rarity, least: int):
    """The sets of the lines with enough words: tokens by rarity, each set's start and size, and which lines these are."""
    tokens, start = distinct_in_segments(P.ordered_tokens(words, rarity), first)
    n = np.diff(start)
    kept = np.flatnonzero(n >= max(least, 1))
    if len(kept) < len(n):
        inside = np.repeat(n >= max(least, 1), n)
        tokens, n = tokens[inside], n[kept]
        start = np.concatenate([[0], np.cumsum(n)])
    return tokens, start[:-1], n, kept


def _line_sets(column, rarity, least: int):
    """Blocks of line sets with enough words: each line's row and number, and the tokens by rarity with each set's start and size."""
    for low, first, words, text, line in hashed_words(column, SPACE, by_line=True):
        tokens, start, n, kept = _distinct(words, first, rarity, least)
        if len(n):
            yield low + text[kept], line[kept], tokens, start, n


class _Met:
    """The nodes that a task has met of late: a table of fixed size, so some come up again."""

    def __init__(self):
        self.table = np.zeros(1 << MET_BITS, np.int64)

    def new(self, nodes: np.ndarray) -> np.ndarray:
        """True where a node was not met before; of equal ones for the first only."""
        place = nodes & ((1 << MET_BITS) - 1)
        fresh = np.zeros(len(nodes), bool)
        fresh[np.unique(nodes, return_index=True)[1]] = True
        fresh &= self.table[place] != nodes
        self.table[place] = nodes
        return fresh


def _rank(ids: np.ndarray) -> np.ndarray:
    """Ids in their order as 24-bit numbers, which distinguish the smaller ones best."""
    return np.maximum(ids, 0).astype(np.float32).view(np.uint32).astype(np.uint64) >> np.uint64(31 - P.RANK_BITS)


def _described(docs: DataFrame, rarity, least: int) -> DataFrame:
    """Per line its node and, where a task meets a new node, the keys of its prefix and what the filters need."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity)
    schema = pa.schema([("doc", pa.int64()), ("text_hash", pa.int64()), ("line", pa.int32()), ("node", pa.int64()), ("info", pa.int64()), ("more", pa.int64()), ("skip", pa.int32()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        levels, met = shared.value, _Met()
        for batch in batches:
            ids, hashes = (batch[c].to_numpy(zero_copy_only=False) for c in ("doc", "text_hash"))
            for row, line, tokens, start, n in _line_sets(batch["text"], levels, least):
                node = set_hashes(tokens, start, n)
                # a counter of one proves a word unique: it is on no other line
                alone = np.add.reduceat((tokens >> P.LEVEL_SHIFT) < 9, start, dtype=np.int64)
                last = np.where((n >= LEAST_NEAR) & met.new(node), n - (4 * n + 4) // 5 + 1, 0)
                at = np.arange(len(tokens)) - np.repeat(start, n)
                inside = (at >= np.repeat(alone, n)) & (at < np.repeat(last, n))
                keys = (tokens << np.uint64(P.RANK_BITS)) | np.repeat(_rank(ids[row]), n)
                offsets = np.concatenate([[0], np.cumsum(np.maximum(last - alone, 0))]).astype(np.int32)
                few, more = P.parities(tokens, start)
                info, more = np.where(last > 0, P.packed(n, np.zeros_like(n), few), 0), np.where((last > 0) & (n > P.WIDE), more.view(np.int64), 0)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[inside].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(hashes[row]), pa.array(line, pa.int32()), pa.array(node), pa.array(info), pa.array(more), pa.array(alone, pa.int32()), lists], schema=schema)

    return docs.mapInArrow(run, "doc long, text_hash long, line int, node long, info long, more long, skip int, keys array<long>")


def _line_key(text: str, line: str):
    """One long for a line, from its text's key and its number."""
    return F.col(text).bitwiseXOR(F.col(line).cast("long"))


def _node_sets(docs: DataFrame, nodes: DataFrame, firsts: DataFrame, rarity, least: int) -> DataFrame:
    """(node, tokens) of the given nodes, from the lines that come first with them."""
    where = firsts.join(nodes, "node").select(F.xxhash64("first.doc", "first.text_hash").alias("text"), "first.line").select(_line_key("text", "line").alias("line"))
    # lines are passed over in the task that reads them: a column function before it would take a second worker and hold texts twice
    texts = docs.select(F.xxhash64("doc", "text_hash").alias("key"), "text")
    marked = docs.sparkSession.sparkContext.broadcast(marks_of(where, "line"))
    shared = docs.sparkSession.sparkContext.broadcast(rarity)
    wanted = docs.sparkSession.sparkContext.broadcast(marks_of(nodes, "node"))
    schema = pa.schema([("node", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def run(batches):
        met = _Met()
        for batch in batches:
            keys = batch["key"].to_numpy()
            for low, _, data, offsets in blocks(batch["text"]):
                cuts, text, line = lines_of(data, offsets)
                kept, size = marked.value.holds(keys[low + text] ^ line), np.diff(cuts)
                if not kept.any():
                    continue
                data, cuts = FOLD[data[np.repeat(kept, size)]], np.concatenate([[0], np.cumsum(size[kept])])
                starts, ends, first = word_spans(data, cuts, SPACE)
                tokens, start, n, _ = _distinct(word_hashes(data, starts, ends), first, shared.value, max(least, LEAST_NEAR))
                if not len(n):
                    continue
                node = set_hashes(tokens, start, n)
                new = wanted.value.holds(node) & met.new(node)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n[new])]).astype(np.int32)), pa.array(tokens[np.repeat(new, n)].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(node[new]), lists], schema=schema)

    return texts.mapInArrow(run, "node long, tokens array<long>").join(nodes, "node", "left_semi").dropDuplicates(["node"])


def removed_lines(docs: DataFrame, work: Workspace, least: int = LEAST_WORDS) -> DataFrame:
    """(doc, text_hash, line) of the lines to remove; ``docs`` has doc (doc_id, last if null), text_hash and text."""
    rarity = sketch_levels(docs.select("text"), lambda b: (w for _, _, w, _, _ in hashed_words(b["text"], SPACE)), BITS)
    table = work.keep(_described(docs, rarity, least), "lines")
    place = F.struct("doc", "line", "text_hash")
    rows = table.where("size(keys) > 0").select(F.posexplode("keys").alias("at", "key"), "node", "skip", "info", "more")
    rows = rows.select("key", "node", F.col("info").bitwiseOR(F.least(F.col("at") + F.col("skip"), F.lit(P.MOST_POS)).cast("long")).alias("info"), "more")
    parts = [f"candidates_{k}" for k in range(PASSES)]
    found = reduce(DataFrame.unionByName, [work.keep(P.compare(rows.where(P.bucket() % PASSES == k), WHOLE), name) for k, name in enumerate(parts)])
    # only nodes with a candidate go on
    nodes = work.keep(found.select(F.explode(F.array("x", "y")).alias("node")).where("node is not null").distinct(), "nodes")
    # what the passes need is freed; of the nodes only those of several lines or with a candidate are kept
    table = work.keep(table.select("doc", "text_hash", "line", "node"), "places")
    work.drop("lines")
    firsts = table.groupBy("node").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    firsts = work.keep(with_marks(firsts, marks_of(nodes, "node"), "node").where("marked or n > 1").drop("marked"), "firsts")
    known = work.keep(firsts.select("node", "first").join(nodes, "node"), "known")
    a, b = (known.select(F.col("node").alias(k), F.col("first").alias(f"first_{k}")) for k in "xy")
    earlier = F.col("first_x") < F.col("first_y")
    pairs = found.where("lead is null").select("x", "y").distinct().join(a, "x").join(b, "y")
    pairs = work.keep(pairs.select(F.when(earlier, F.col("x")).otherwise(F.col("y")).alias("x"), F.when(earlier, F.col("y")).otherwise(F.col("x")).alias("y"), F.least("first_x", "first_y").alias("first")), "pairs")

    # texts are read for their sets once; all verifications take them from that table
    sets = work.keep(_node_sets(docs, nodes, known, rarity, least), "sets")

    def shadowed(open_: DataFrame, name: str, some: bool = True) -> DataFrame:
        """The later nodes y of linked pairs, x being the earlier. With ``some`` the pairs concern few of the nodes."""
        own = sets
        if some:
            asked = work.keep(open_.select(F.explode(F.array("x", "y")).alias("node")).distinct(), f"{name}_nodes")
            own = with_marks(sets, marks_of(asked, "node"), "node").where("marked").drop("marked")
        out = work.keep(P.verified(open_, own).select(F.col("y").alias("node")).distinct(), name)
        work.drop(f"{name}_nodes")
        return out

    # most nodes with an earlier match have it in their first partner; only the others meet all their partners
    best = work.keep(pairs.groupBy("y").agg(F.min(F.struct("first", "x")).alias("best")).select("best.x", "y"), "best")
    gone = shadowed(best, "shadowed", some=False)
    left = work.keep(pairs.select("x", "y").join(gone.withColumnRenamed("node", "y"), "y", "left_anti").join(best, ["x", "y"], "left_anti"), "left")
    if not left.isEmpty():
        gone = work.keep(gone.unionByName(shadowed(left, "shadowed_left")), "shadowed_both")
    # rows of large buckets without an earlier match so far meet all earlier rows of their buckets
    rest = found.where("lead is not null").select(P.bucket().alias("token"), F.col("x").alias("node"), "info", "more")
    if not rest.isEmpty():
        placed = work.keep(rest.join(known, "node"), "rest")
        a = placed.join(gone, "node", "left_anti").select("token", F.col("node").alias("y"), F.col("info").alias("a"), F.col("more").alias("a_more"), F.col("first").alias("fy"))
        b = placed.select("token", F.col("node").alias("x"), F.col("info").alias("b"), F.col("more").alias("b_more"), F.col("first").alias("fx"))
        more = a.join(b, "token").where("fx < fy").where(P.may_link("a", "b")).select("x", "y").distinct()
        more = work.keep(more.join(pairs.select("x", "y"), ["x", "y"], "left_anti"), "open")
        if not more.isEmpty():
            gone = gone.unionByName(shadowed(more, "shadowed_more")).distinct()
    work.drop(*parts, "rest", "pairs", "best", "left", "open", "nodes", "known", "sets")
    # lines of a node with an earlier match go, and of any other node all but the first
    judged = gone.select("node", F.lit(None).cast("struct<doc:bigint,line:int,text_hash:bigint>").alias("first")).unionByName(firsts.where("n > 1").select("node", "first"))
    judged = work.keep(judged, "judged")
    lines = with_marks(table.select("doc", "text_hash", "line", "node"), marks_of(judged, "node"), "node").where("marked").join(judged, "node")
    return lines.where(F.col("first").isNull() | (F.struct("doc", "line", "text_hash") > F.col("first"))).select("doc", "text_hash", "line")


def _without(text: str, gone: str):
    """Texts without the lines whose numbers are in ``gone``. Both are columns; the lines are split once, as a variable."""

    def kept(lines):
        numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
        return F.array_join(F.transform(numbers, lambda k: F.get(lines, k)), "\n")

    return F.transform(F.array(F.split(text, "\n", -1)), kept)[0]


def dedup(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the text of each row without its removed lines, and two columns: n_lines, n_removed (columns of these
    names in ``docs`` are replaced)."""
    work = Workspace(docs.sparkSession, "lines")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_lines", "n_removed"))).alias("row")
    text = F.col("text").cast("string")
    keyed = docs.select(row, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), text.alias("text"))
    gone = removed_lines(keyed.select("doc", "text_hash", "text"), work, least)
    gone = work.keep(gone.groupBy("doc", "text_hash").agg(F.collect_set("line").alias("gone")), "removed")
    work.drop("places", "firsts", "judged", "shadowed", "shadowed_left", "shadowed_both", "shadowed_more")
    both = with_marks(keyed, marks_of(gone, "doc", "text_hash"), "doc", "text_hash")
    n_lines = F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines")
    n_removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(_without("text", "gone")).alias("text")
    # one branch for all marked rows, so that their texts are read once after the join
    # the lists are hashed, as a sort would move the texts
    hit = both.where("marked").join(gone.hint("shuffle_hash"), ["doc", "text_hash"], "left").select("row", text, n_lines, n_removed)
    clean = both.where("not marked").select("row", "text", n_lines, F.lit(0).cast("long").alias("n_removed"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    columns = [F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names]
    return hit.unionByName(clean).select(*columns, "n_lines", "n_removed")
