"""Operators on one large group: equal to the plain way, and in bounded time."""

import random
import time

from pagewright.operators import archives, summaries, transcripts
from pyspark.sql import functions as F


def plain_names(names):
    taken, out = set(), []
    for name in names:
        stem, dot, ext = name.rpartition(".") if "." in name[1:] else (name, "", "")
        n, new = 2, name
        while new.lower() in taken:
            new, n = f"{stem} ({n}){dot}{ext}", n + 1
        taken.add(new.lower())
        out.append(new)
    return out


def test_unique_names_equal_the_plain_fold(spark):
    rng = random.Random(4)
    pool = ["scan.pdf", "Scan.PDF", "scan (2).pdf", "scan (3).pdf", "scan (2) (2).pdf", "SCAN (2).pdf", "note", "note (2)", ".hidden", "a.b.c", "a.b (2).c"]
    names = [rng.choice(pool) for _ in range(600)]
    got = archives.unique_names(spark.createDataFrame([("x", k, n) for k, n in enumerate(names)], "archive string, entry_no long, name string"))
    assert [r.unique for r in got.orderBy("entry_no").collect()] == plain_names(names)


def test_many_equal_names_in_one_archive(spark):
    entries = spark.range(100_000).select(F.lit("x").alias("archive"), F.col("id").alias("entry_no"), F.lit("scan.pdf").alias("name"))
    began = time.time()
    last = archives.unique_names(entries).orderBy(F.desc("entry_no")).first()
    assert last.unique == "scan (100000).pdf" and time.time() - began < 30


def test_places_without_a_document(spark):
    """All conversations without a document have one order, in which each task numbers a range."""
    said = spark.range(20_000).select(F.col("id").alias("conv_id"), F.lit(None).cast("long").alias("document_id"), (F.col("id") * 7919 % 5000).alias("turn"), F.lit("user").alias("role"), F.lit("q").alias("text"))
    rows = transcripts.listing(said).collect()
    want = sorted(rows, key=lambda r: (-r.last_turn, r.key))
    assert [r.place for r in want] == list(range(1, 20_001))
    plan = transcripts.listing(said)._jdf.queryExecution().optimizedPlan().toString()
    assert "document_id" not in "".join(line for line in plan.splitlines() if "Window" in line and "range" in line)


def test_summaries_by_blocks(spark):
    """A block at a time gives what all at once gives, also where many passages are alike."""
    rng = random.Random(8)
    rows = []
    for d in range(12):
        for k in range(rng.choice([1, 7, 8, 9, 60])):
            words = ["same", "words", "here"] if rng.random() < 0.7 else [rng.choice("abcdefgh") * 3 for _ in range(rng.randint(1, 60))]
            rows.append((d, k // 10, k % 10 * 100, k % 10 * 100 + 50, " ".join(words), round(rng.random(), 2), words[:1]))
    scored = spark.createDataFrame(rows, "doc_id long, page_index int, start int, stop int, text string, score double, highlights array<string>")
    whole = sorted(map(str, summaries.summaries(scored, block=1000).collect()))
    assert len(whole) == 12 and sorted(map(str, summaries.summaries(scored, block=8).collect())) == whole


def test_summary_of_a_very_long_document(spark):
    scored = spark.range(200_000).select(
        F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("page_index"), F.col("id").cast("int").alias("start"), F.col("id").cast("int").alias("stop"),
        F.concat(F.lit("passage "), F.col("id")).alias("text"), (F.col("id") % 1000 / 1000).alias("score"), F.array(F.lit("x")).alias("highlights"),
    )
    began = time.time()
    assert len(summaries.summaries(scored).first().sentences) == 5 and time.time() - began < 60
