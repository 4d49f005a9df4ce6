"""Conversations folded from messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import first_question_title, trimmed
from pagewright.sources import shared

KEPT = 200


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, title (of the first question that isn't blank), n_messages, last_turn."""
    asked = (F.col("role") == "user") & (trimmed(F.col("text")) != "")
    by = messages.groupBy("conv_id").agg(F.min_by(F.when(asked, F.col("text")), F.when(asked, F.col("turn"))).alias("first"), F.count("*").alias("n_messages"), F.max("turn").alias("last_turn"))
    return by.select("conv_id", F.coalesce(first_question_title(F.col("first")), F.lit("Conversation")).alias("title"), "n_messages", "last_turn")


def newest(messages: DataFrame, kept: int = KEPT) -> DataFrame:
    """The last ``kept`` messages of each conversation."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= kept)


def recent_questions(messages: DataFrame, kept: int = 5) -> DataFrame:
    """The last distinct questions of each conversation, letter case aside: conv_id, rk, question."""
    q = messages.where("role = 'user'").withColumn("key", F.lower(trimmed(F.col("text")))).where("key <> ''")
    last = q.groupBy("conv_id", "key").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("question"))
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return last.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= kept).select("conv_id", "rk", "question")


def recent_searches(messages: DataFrame, kept: int = 5) -> DataFrame:
    """The last different queries of each conversation, letter case aside and of two characters at least: conv_id, rk, query."""
    text = trimmed(F.col("text"))
    return recent_questions(messages.withColumn("text", text).where(F.length("text") >= 2), kept).withColumnRenamed("question", "query")


def keyed(messages: DataFrame) -> DataFrame:
    """``messages`` (with conv_id and document_id, null where there is none) with the conversation's ``key``."""
    return messages.withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.concat(F.lit("legacy:"), F.coalesce(F.col("document_id").cast("string"), F.lit("library")))))


def listing(messages: DataFrame) -> DataFrame:
    """key, title, n_messages, last_turn, document_id (the first message's), and place: newest first among a document's."""
    asked = (F.col("role") == "user") & (trimmed(F.col("text")) != "")
    first = F.struct("turn", F.coalesce("conv_id", F.lit(-1)).alias("c"))
    by = keyed(messages).groupBy("key").agg(
        F.min_by(F.when(asked, F.col("text")), F.when(asked, first)).alias("first"), F.count("*").alias("n_messages"), F.max("turn").alias("last_turn"), F.min_by("document_id", first).alias("document_id")
    )
    rows = by.select("key", F.coalesce(first_question_title(F.col("first")), F.lit("Conversation")).alias("title"), "n_messages", "last_turn", "document_id")
    order = [F.desc("last_turn"), F.asc("key")]
    own = rows.where("document_id is not null").withColumn("place", F.row_number().over(Window.partitionBy("document_id").orderBy(*order)))
    return own.unionByName(placed(rows.where("document_id is null"), order))


def placed(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` with their ``place`` in one order of all, from 1: each task numbers a range of them, and adds how many come
    in the ranges before its own."""
    ranges = shared.kept(rows.sparkSession, rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "placed")
    counts = ranges.groupBy("range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    within = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    out = ranges.withColumn("within", within).join(F.broadcast(counts.select("range", F.coalesce(before, F.lit(0)).alias("before"))), "range")
    return out.withColumn("place", (F.col("within") + F.col("before")).cast("int")).select(*rows.columns, "place")


def history(messages: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each request (req, conv_id, document_id; null means any) its messages in the order of time: req, rk, conv_id, turn, role."""
    rows = messages.select("conv_id", "document_id", "turn", "role")
    whole = wanted.where("conv_id is not null").select("req", "conv_id").join(rows, "conv_id")
    per_document = wanted.where("conv_id is null and document_id is not null").select("req", "document_id").join(rows, "document_id")
    every = whole.select("req", "conv_id", "turn", "role").unionByName(per_document.select("req", "conv_id", "turn", "role"))
    order = Window.partitionBy("req").orderBy("turn", "conv_id")
    return every.withColumn("rk", F.row_number().over(order))


def turns(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Two messages for each question (conv_id, seq, question): it, and its answer (conv_id, seq, answer) or an error message."""
    both = questions.join(answers, ["conv_id", "seq"], "left")
    asked = both.select("conv_id", (F.col("seq") * 2).alias("seq"), F.lit("user").alias("role"), F.col("question").alias("text"), F.lit(None).cast("string").alias("error"))
    failed = F.col("answer").isNull()
    said = both.select("conv_id", (F.col("seq") * 2 + 1).alias("seq"), F.lit("assistant").alias("role"), F.coalesce("answer", F.lit("")).alias("text"), F.when(failed, "The assistant could not answer that.").alias("error"))
    return asked.unionByName(said)
