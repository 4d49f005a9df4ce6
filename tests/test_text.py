"""Operators whose results SQL does not give, on small inputs and as invariants over a whole table."""

import re

from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import answers, facts, passages, summaries
from pagewright.plans import views


def test_passages_are_spans_of_their_page(spark, sf_dir):
    pages = views.pages(spark, sf_dir)
    found = passages.passages(pages).join(pages.select("doc_id", "page_index", F.col("text").alias("page")), ["doc_id", "page_index"])
    bad = F.expr("substring(page, start + 1, stop - start) <> text or length(text) not between 12 and 220")
    assert found.where(bad).count() == 0 and found.count() > 0


def test_human_sizes(spark):
    rows = [(0,), (1023,), (1024,), (10_137,), (10_240,), (1024**2,), (5 * 1024**3,)]
    got = spark.createDataFrame(rows, "n long").select(T.human_size(F.col("n")).alias("s")).collect()
    assert [r.s for r in got] == ["0 B", "1023 B", "1.0 KB", "9.9 KB", "10 KB", "1.0 MB", "5.0 GB"]


def test_fact_shapes(spark):
    pages = spark.createDataFrame([(1, 0, "Due 12/03/2026, total 248.60 to a.b@c.de. Not 1234 or x12.50y")], "doc_id long, page_index int, text string")
    got = sorted((r.kind, r.value) for r in facts.facts(pages).collect())
    assert got == [("amount", "248.60"), ("date", "12/03/2026"), ("email", "a.b@c.de")]


def test_capitalised_is_one_character(spark):
    """As DuckDB's upper(), also where full upper case has several characters."""
    import duckdb

    first = [c for c in map(chr, range(1, 0x10000)) if len(c.upper()) > 1] + list("aéÿß1 ") + ["ßheit", "élan", ""]
    got = spark.createDataFrame([(c,) for c in first], "c string").select(T.capitalised(F.col("c")).alias("s")).collect()
    db = duckdb.connect()
    assert [r.s for r in got] == [db.execute("SELECT upper($1[1:1]) || $1[2:]", [c]).fetchone()[0] for c in first]


def words(text):
    return {w for w in re.split(r"[\W_]+", text.lower()) if len(w) >= 2}


def test_summaries_equal_a_greedy_choice(spark):
    text = "One two three four five six.\nOne two three four five seven.\nEight nine ten eleven twelve.\nTotal due 248.60 by 12/03/2026 here.\nAlpha beta gamma delta epsilon."
    pages = spark.createDataFrame([(1, 0, text), (1, 1, text.replace("nine", "zeta") + "\nAnother line that stands alone."), (2, 0, "")], "doc_id long, page_index int, text string")
    scored = summaries.scores(passages.passages(pages))
    rows = sorted((r for r in scored.collect()), key=lambda r: (-r.score, r.page_index, r.start))
    chosen = []
    for r in rows:
        if len(chosen) == 5:
            break
        if any(len(words(r.text) & words(c.text)) >= 0.6 * len(words(r.text) | words(c.text)) for c in chosen):
            continue
        if chosen and sum(len(c.text) for c in chosen) + len(r.text) > 120:
            break
        chosen.append(r)
    got = summaries.summaries(scored, 5, 120).collect()
    assert [r.doc_id for r in got] == [1] and len(chosen) > 1
    assert [(x.page_index, x.start) for x in got[0].sentences] == sorted((c.page_index, c.start) for c in chosen)


def test_summaries_deal_passages_once(spark, sf_dir):
    """Words of passages stay in their task, and so do scored passages."""
    scored = summaries.scores(passages.passages(views.pages(spark, sf_dir)))
    plan = summaries.summaries(scored, dealt=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Aggregate" not in plan and "Join" not in plan
    own = [sorted(map(str, summaries.summaries(scored, 3, 300, dealt=d).collect())) for d in (True, False)]
    assert own[0] == own[1] and own[0]


def test_passages_of_a_document_over_several_batches(spark):
    rows = [(d, k // 9, k % 9 * 50, f"word{k % 7} other{k % (d + 2)} third{k} of 12/03/2026 " + "x" * (k % 20)) for d in range(5) for k in range(40)]
    spans = spark.createDataFrame([(d, p, a, a + len(t), t) for d, p, a, t in rows], "doc_id long, page_index int, start int, stop int, text string")
    whole = sorted(map(str, summaries.scores(spans).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(str, summaries.scores(spans).collect())) == whole and len(whole) == 200
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_outline_takes_headings_first(spark):
    docs = spark.createDataFrame([(1, "Report"), (2, "Notes")], "doc_id long, title string")
    pages = spark.createDataFrame([(1, 0, "# Report\n## Costs\nbody text that is long enough\n## costs\n# Plan"), (2, 0, "Date: today\nThe opening line of these notes is this.")], "doc_id long, page_index int, text string")
    got = {r.doc_id: r for r in summaries.outlines(docs, pages, summaries.scores(passages.passages(pages))).collect()}
    assert (got[1].topics, got[1].from_headings) == (["Costs", "Plan"], True)
    assert got[2].topics[0] == "The opening line of these notes is this." and not got[2].from_headings


def test_citation_window(spark):
    page = "a" * 200 + " here it stands. " + "b" * 200
    pages = spark.createDataFrame([(1, 0, page)], "doc_id long, page_index int, text string")
    chosen = spark.createDataFrame([(7, 1, 0, 201, 216)], "qid long, doc_id long, page_index int, start int, stop int")
    snippet = answers.citations(chosen, pages).collect()[0].snippet
    assert snippet.startswith("…a") and snippet.endswith("b…") and "here it stands." in snippet and 230 <= len(snippet) <= 242
