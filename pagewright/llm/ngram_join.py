"""N-gram Jaccard join of documents: a grouped prefix join on distinct word shingles, reduced to components.

Documents with the same shingle set are one node. Nodes with equal prefixes and sizes are one group. Buckets of prefix
tokens give group pairs, which the length and positional filters thin out; what is left is expanded to nodes and
verified on the exact sets. Two documents of a component need not be compared, so a large bucket is first compared
with its most common members (a near copy's original), and only nodes that stay in another component meet the rest.

Defined cases: a text that is null, empty or without words has an empty set and links with nothing; with fewer words
than a shingle has, the whole sequence is its one shingle. Rows that repeat (same doc_id or not) are equal documents,
one result row each; a component's id is the least doc_id in it that isn't null, so a row whose doc_id is null keeps a
null id only where its component has no other. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import prefixjoin as P
from .components import connected
from .marks import marks_of, with_marks
from .sketch import levels as sketch_levels
from .storage import Workspace
from .textnum import SPACE, fold_hashes, hashed_words, set_hash, shingle_hashes

SHINGLE = 5
#: counters for token frequencies: 4 MB of levels, whatever the input
BITS = 22
WHOLE = 64
#: the rows of prefixes are dealt in so many passes, each with buckets of its own, so that only a part of them is on disk at a time
PASSES = 3
LAST = 2**63 - 1
#: tokens that a task gathers before it hands rows on, and rows that it takes at a time
MOST_TOKENS, MOST_ROWS = 1 << 18, 1 << 10


def _sets(column, k: int):
    """(row, sorted distinct shingle hashes) of every text."""
    for low, first, words, text, _ in hashed_words(column, SPACE):
        every = shingle_hashes(words, k)
        for i in range(len(text)):
            a, b = first[i], first[i + 1]
            n = b - a
            yield low + i, np.unique(every[a : b - k + 1]) if n >= k else fold_hashes(words[a:b])


def _bulk(column, k: int):
    """All shingle hashes, block by block (those across two texts are left out)."""
    for _, first, words, _, _ in hashed_words(column, SPACE):
        every = shingle_hashes(words, k)
        inside = np.ones(len(every), bool)
        for t in range(1, k):
            cut = first[1:-1] - t
            inside[cut[(cut >= 0) & (cut < len(every))]] = False
        yield every[inside]


def _parts(batches):
    """Batches of at most ``MOST_ROWS`` rows."""
    for batch in batches:
        for low in range(0, batch.num_rows, MOST_ROWS):
            yield batch.slice(low, MOST_ROWS)


def _described(docs: DataFrame, levels, k: int) -> DataFrame:
    """Per document its set's size, node and group, and, where a task first meets a group, the group's prefix."""
    bits = np.uint64(64 - P.np.uint64(len(levels) - 1).item().bit_length())
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches):
        rarity, seen = shared.value, set()
        for batch in _parts(batches):
            size, node, group, pop, skip, prefix = [], [], [], [], [], []
            for _, values in _sets(batch["text"], k):
                n = len(values)
                size.append(n)
                node.append(set_hash(values) if n else None)
                if not n:
                    group.append(None)
                    pop.append(0)
                    skip.append(0)
                    prefix.append(None)
                    continue
                level = rarity[values >> bits]
                tokens = np.sort(P.ordered_tokens(values, rarity))[: P.prefix_length(n)]
                g = set_hash(np.append(tokens, np.uint64(n)))
                pop.append(int(level.mean() * 1000))
                group.append(g)
                # a counter of one proves a token unique: it is in no other set
                alone = int(np.searchsorted(tokens >> P.LEVEL_SHIFT, 9))
                skip.append(alone)
                # a copy, as a view would hold the whole set
                prefix.append(None if g in seen else tokens[alone:].view(np.int64).copy())
                seen.add(g)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], pa.array(size, pa.int32()), pa.array(node, pa.int64()), pa.array(group, pa.int64()), pa.array(pop, pa.int32()), pa.array(skip, pa.int32()), pa.array(prefix, pa.list_(pa.int64()))], ["doc_id", "text_hash", "size", "node", "grp", "pop", "skip", "prefix"])

    return docs.mapInArrow(run, "doc_id long, text_hash long, size int, node long, grp long, pop int, skip int, prefix array<long>")


def _node_sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, tokens) of the given nodes, from the texts of the documents that may have them."""
    wanted = docs.sparkSession.sparkContext.broadcast(marks_of(nodes, "node"))

    def rows_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array(list(rows.values()), pa.list_(pa.int64()))], ["node", "tokens"])

    def run(batches):
        for batch in batches:
            rows, held = {}, 0
            for _, values in _sets(batch["text"], k):
                if len(values):
                    node = set_hash(values)
                    if node not in rows and wanted.value.holds(np.array([node]))[0]:
                        rows[node] = values.view(np.int64)
                        held += len(values)
                        if held >= MOST_TOKENS:
                            yield rows_of(rows)
                            rows, held = {}, 0
            yield rows_of(rows)

    found = docs.mapInArrow(run, "node long, tokens array<long>")
    return found.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def join_components(docs: DataFrame, k: int = SHINGLE, work: Workspace | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_hash, n_shingles, component_id. Its tables are in ``work``."""
    work = work or Workspace(docs.sparkSession, "ngram")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash"))
    texts = docs.select("text")
    rarity = sketch_levels(texts, lambda batch: _bulk(batch["text"], k), BITS)
    table = work.keep(_described(docs, rarity, k), "documents")
    full = table.where("node is not null")

    # one row for each prefix token of a group, and one for each node of a group (its token is the group's own, its bits tell it apart)
    rank = F.lit(P.MOST_RANK) - F.col("pop")
    rows = full.where("prefix is not null").select(F.posexplode("prefix").alias("at", "token"), "node", "size", "pop", "skip")
    rows = rows.select(P.key_of(F.col("token"), rank).alias("key"), "node", P.info_of(F.col("size"), F.col("at") + F.col("skip"), 0).alias("info"), F.lit(0).cast("long").alias("more"))
    # groups of several nodes are few, and only their rows are dealt
    large = work.keep(full.groupBy("grp").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("grp"), "groups")
    held = with_marks(full.select("grp", "node", "size", "pop"), marks_of(large, "grp"), "grp").where("marked")
    members = held.groupBy("grp", "node").agg(F.min("size").alias("size"), F.max("pop").alias("pop"))
    several = work.keep(members.join(large, "grp", "left_semi"), "members")
    inner = several.select(P.key_of(F.xxhash64("grp", F.lit(1)), rank).alias("key"), "node", P.info_of(F.col("size"), F.lit(0), 1).alias("info"), F.lit(0).cast("long").alias("more"))
    rows = rows.unionByName(inner)
    parts = [f"candidates_{k}" for k in range(PASSES)]
    found = reduce(DataFrame.unionByName, [work.keep(P.compare(rows.where(P.bucket() % PASSES == k), WHOLE), name) for k, name in enumerate(parts)])
    # what the passes need is freed
    table = work.keep(table.drop("prefix"), "sizes")
    work.drop("documents")
    full = table.where("node is not null")
    pairs = found.where("lead is null").select("x", "y").distinct()
    pairs = work.keep(pairs, "pairs")
    nodes = work.keep(pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct(), "nodes")
    sets = work.keep(_node_sets(texts, nodes, k), "sets")
    links = work.keep(P.verified(pairs, sets), "links")
    work.drop("sets")
    now = work.keep(connected(links, work, "a"), "first")

    # what is left: rows of large buckets that stand for a node outside the component of their bucket's first node, and members of
    # paired groups. A row of a prefix token stands for all nodes of its group, so for the components from the least to the greatest.
    placed = lambda df, node, out: df.join(now.select(F.col("node").alias(node), F.col("component").alias(out)), node, "left").withColumn(out, F.coalesce(out, node))
    of = several.select("grp", "node")
    spans = placed(of, "node", "c").groupBy("grp").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    rows = placed(placed(found.where("lead is not null"), "x", "cx"), "lead", "clead").join(of.withColumnRenamed("node", "x"), "x", "left").join(spans, "grp", "left")
    rows = rows.withColumn("token", P.bucket())
    alone = F.col("low").isNull() | (P.bits_of(F.col("info")) == 1)
    rest = work.keep(rows.withColumns({k: F.when(alone, F.col("cx")).otherwise(F.col(k)) for k in ("low", "high")}), "rest")
    a = rest.where("low <> clead or high <> clead").select("token", "x", F.col("low").alias("la"), F.col("high").alias("ha"), F.col("info").alias("a"), F.col("more").alias("a_more"))
    b = rest.select("token", F.col("x").alias("y"), F.col("low").alias("lb"), F.col("high").alias("hb"), F.col("info").alias("b"), F.col("more").alias("b_more"))
    more = a.join(b, "token").where("x <> y and least(la, lb) <> greatest(ha, hb)").where(P.may_link("a", "b")).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    both = pairs.unionByName(more).join(of.select(F.col("node").alias("x"), F.col("grp").alias("gx")), "x", "left").join(of.select(F.col("node").alias("y"), F.col("grp").alias("gy")), "y", "left")
    # two nodes of one group meet in the group's own bucket
    both = work.keep(both.distinct(), "grouped")
    apart = both.where("not gx <=> gy or gx is null")
    grown = apart.join(of.select(F.col("grp").alias("gx"), F.col("node").alias("mx")), "gx", "left").join(of.select(F.col("grp").alias("gy"), F.col("node").alias("my")), "gy", "left")
    grown = grown.select(F.coalesce("mx", "x").alias("x"), F.coalesce("my", "y").alias("y")).unionByName(both.where("gx = gy").select("x", "y"))
    grown = placed(placed(grown, "x", "cx"), "y", "cy").where("cx <> cy").select("x", "y")
    open_ = grown.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct().join(pairs, ["x", "y"], "left_anti")
    open_ = work.keep(open_, "open")
    if open_.isEmpty():
        component = now
    else:
        nodes = work.keep(open_.select(F.explode(F.array("x", "y")).alias("node")).distinct(), "more_nodes")
        sets = _node_sets(texts, nodes, k)
        links = links.unionByName(P.verified(open_, work.keep(sets, "more_sets")))
        component = work.keep(connected(links, work, "b"), "second")
    work.drop("rest", *parts, "grouped", "more_sets")

    least = full.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n"))
    named = least.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = named.groupBy("component").agg(F.min("least_id").alias("component_id"), F.sum("n").alias("n")).where("n > 1")
    labels = work.keep(named.select("node", "component").join(ids.select("component", "component_id"), "component").select("node", "component_id"), "labels")
    out = table.select("doc_id", "text_hash", F.col("size").cast("long").alias("n_shingles"), "node").join(labels, "node", "left")
    return out.select("doc_id", "text_hash", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """``docs`` without the documents that have an earlier one in their component; of equal rows one stays.

    Only rows that may go are joined; all others pass by.
    """
    work = Workspace(docs.sparkSession, "keep")
    keys = ("key_id", "text_hash")
    inner = Workspace(docs.sparkSession, "ngram")
    found = join_components(docs, k, inner).select(F.coalesce("doc_id", F.lit(LAST)).alias("key_id"), "text_hash", "component_id")
    found = found.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.coalesce(F.col("component_id") != F.col("key_id"), F.lit(False))).alias("gone"))
    found = work.keep(found.where("gone or n > 1"), "found")
    inner.clear()
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("key_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash"))
    marked = with_marks(keyed, marks_of(found, *keys), *keys)
    left = marked.where("marked").join(found.where("gone"), list(keys), "left_anti").dropDuplicates(list(keys))
    return left.select("row.*").unionByName(marked.where("not marked").select("row.*"))

