"""A training corpus in five stages: quality, line dedup, near-duplicate join, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. Further columns of the documents
are left behind at the first stage.

Defined cases, in every stage: a null text counts as empty; an empty document is no duplicate or leak, and stays unless
the classifier rejects it; rows that repeat an id and text are one document, of which the join keeps one row; of equal
texts the least id stays, and one without an id only where no other is; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import decontaminate, line_dedup, ngram_join, packing, quality
from pagewright.llm.storage import Workspace

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.scored(docs, quality.fit(docs, labels)).where("score >= 0.5").select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later matches of a line go; so does a document of which no word is left."""
    out = line_dedup.dedup(docs.select(*COLUMNS)).where(r"n_removed = 0 or text rlike '[^\\x20\\x09-\\x0D]'")
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the least id stays."""
    return ngram_join.keep_one(docs.select(*COLUMNS))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go."""
    return decontaminate.without_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: SQL can express neither the fitted classifier nor the tokenizer
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = work.keep(stage(spark, docs, sf_dir), name)
        if before:
            work.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
