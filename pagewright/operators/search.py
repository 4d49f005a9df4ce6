"""Index and search: postings, statistics, BM25, tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import tokens, without_images

K1, B = 1.2, 0.75
TITLE_WEIGHT = 3
#: order of the kinds in a result
KINDS = ("exact_title", "partial_title", "phrase", "content", "tag")


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf, body_length), one row for each term of a body."""
    body = docs.select("doc_id", tokens(F.col("text")).alias("body"))
    every = body.select("doc_id", F.size("body").alias("body_length"), F.explode("body").alias("term"))
    return every.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.first("body_length").alias("body_length"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: the number of documents, and the mean length of those with a body."""
    n = F.size(tokens(F.col("text")))
    return docs.agg(F.count("*").alias("n_docs"), F.avg(F.when(n > 0, n)).alias("avgdl"))


def idf(n_docs, df):
    return F.log1p((n_docs - df + 0.5) / (df + 0.5))


def bm25(docs: DataFrame, queries: DataFrame, top: int = 50, idf_mode: str = "corpus") -> DataFrame:
    """The ``top`` documents of each query (qid, terms): qid, doc_id, score, rk.

    Only terms that some query has are counted, so the shuffle carries the queries' postings and not the corpus's.
    With ``idf_mode='constant'`` every term counts as held by one document.
    """
    terms = queries.select("qid", F.explode("terms").alias("term")).distinct()
    body = docs.select("doc_id", tokens(F.col("text")).alias("body"))
    every = body.select("doc_id", F.size("body").alias("body_length"), F.explode("body").alias("term"))
    wanted = every.join(terms.select("term").distinct(), "term", "left_semi")
    held = wanted.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.first("body_length").alias("body_length"))
    df = held.groupBy("term").agg(F.count("*").alias("df")) if idf_mode == "corpus" else terms.select("term", F.lit(1).alias("df")).distinct()
    stats = corpus_stats(docs)
    norm = 1 - B + B * F.col("body_length") / F.col("avgdl")
    part = idf(F.col("n_docs"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * norm)
    scored = terms.join(held.join(df, "term"), "term").crossJoin(F.broadcast(stats))  # stats is one row
    total = scored.groupBy("qid", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return total.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= top)


def title_and_tag_hits(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits by title or tag: qid, doc_id, kind, score; the first kind that fits a document holds."""
    terms = queries.select("qid", F.size("terms").alias("n"), F.array_join("terms", " ").alias("whole"), F.explode("terms").alias("term"))
    title = docs.select("doc_id", tokens(F.col("title")).alias("t")).select("doc_id", F.size("t").alias("n_title"), F.array_join("t", " ").alias("title"), F.explode(F.array_distinct("t")).alias("term"))
    by_title = terms.join(title, "term").groupBy("qid", "doc_id").agg(F.count("*").alias("matched"), F.first("n").alias("n"), F.first("n_title").alias("n_title"), F.max(F.col("whole") == F.col("title")).alias("exact"))
    whole = F.col("matched") == F.col("n")
    by_title = by_title.select(
        "qid",
        "doc_id",
        F.when(F.col("exact"), 0).when(whole, 1).otherwise(5).alias("check"),
        F.when(F.col("exact"), F.lit("exact_title")).otherwise("partial_title").alias("kind"),
        F.when(F.col("exact"), 1.0 / (1 + F.col("n_title"))).when(whole, F.col("matched") / F.col("n_title")).otherwise(F.col("matched") / F.col("n_title") * 0.5).alias("score"),
    )
    tag = docs.select("doc_id", F.explode(F.array_distinct(F.flatten(F.transform("tags", tokens)))).alias("term"))
    by_tag = terms.join(tag, "term").groupBy("qid", "doc_id").agg((F.count("*") / F.first("n")).alias("score"))
    by_tag = by_tag.select("qid", "doc_id", F.lit(4).alias("check"), F.lit("tag").alias("kind"), "score")
    every = by_title.unionByName(by_tag)
    return every.groupBy("qid", "doc_id").agg(F.min_by("kind", "check").alias("kind"), F.round(F.min_by("score", "check"), 6).alias("score"))


def entries(docs: DataFrame) -> DataFrame:
    """doc_id, field (body, title or tag), term, tf: all that the index knows of each document."""
    body = docs.select("doc_id", F.explode(tokens(without_images(F.col("text")))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    once = lambda words, field: docs.select("doc_id", F.lit(field).alias("field"), F.explode(F.array_distinct(words)).alias("term"), F.lit(1).cast("long").alias("tf"))
    title, tags = once(tokens(F.col("title")), "title"), once(F.flatten(F.transform("tags", tokens)), "tag")
    return body.select("doc_id", F.lit("body").alias("field"), "term", "tf").unionByName(title).unionByName(tags)
