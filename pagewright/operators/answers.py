"""Passages that answer questions: candidates, priors, ranking, selection and the composed answer, for many questions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import tokens
from pagewright.functions import lexicon as L
from pagewright.operators import facts, markup, passages, tiers

CANDIDATES, IDEAL, INTENT_BOOST, FLOOR, SYNONYM = 6, 25, 1.35, 0.5, 0.6
PER_DOCUMENT, MOST, BUDGET, PAD = 2, 4, 1200, 240
TIES = ("doc_id", "page_index", "start")


def priors(docs: DataFrame, questions: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """The best documents of each analysed question by the whole search for its terms: qid, doc_id, prior of 0.5 to 1."""
    hits = tiers.ranked(docs, questions.select("qid", F.array_join("terms", " ").alias("query")), most=most)
    best = F.max("score").over(Window.partitionBy("qid"))
    return hits.select("qid", "doc_id", F.when(best <= 0, 1.0).otherwise(F.round(0.5 + 0.5 * F.col("score") / best, 6)).alias("prior"))


def rank(questions: DataFrame, pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """Scored passages of the candidate documents: qid, doc_id, page_index, start, stop, text, coverage, shaped, score.

    Only pages of candidates are cut. A passage with no term, without one of the quoted phrases, or with less than half
    of several terms is left out.
    """
    wanted = pages.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    cut = passages.passages(wanted).withColumn("words", tokens(F.col("text")))
    asked = questions.select("qid", "phrases", "intent", F.col("content_terms").alias("content"), F.array_union("content_terms", "synonyms").alias("near"))
    table = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in L.ALTERNATIVES.items() for x in pair))
    rows = candidates.join(asked, "qid").join(cut, "doc_id")
    rows = rows.where(F.size("words") > 0).where(F.forall("phrases", lambda p: F.contains(F.lower("text"), p)))
    matched = F.array_intersect("content", "words")
    indirect = F.filter(F.array_except("content", "words"), lambda t: t.isin(*L.ALTERNATIVES) & F.arrays_overlap(table[t], F.col("words")))
    rows = rows.withColumns({"matched": matched, "credit": F.size(matched) + SYNONYM * F.size(indirect), "n": F.size("words"), "k": F.size("content")})
    rows = rows.withColumn("at", F.expr("filter(transform(words, (w, i) -> if(array_contains(near, w), i, -1)), i -> i >= 0)"))
    quoted = F.size("phrases") > 0
    rows = rows.withColumn("coverage", F.when(F.col("k") == 0, F.when(quoted, 1.0).otherwise(0.0)).otherwise(F.least(F.lit(1.0), F.col("credit") / F.col("k"))))
    rows = rows.where(quoted | ((F.col("coverage") > 0) & ((F.col("k") <= 1) | (F.col("coverage") >= FLOOR))))
    rows = rows.withColumn("shaped", facts.satisfies(F.col("intent"), F.col("text")))
    span = F.coalesce(F.array_max("at") - F.array_min("at"), F.lit(0))
    score = F.col("coverage") * (1 + F.log1p(F.size("at").cast("double"))) / (1 + span / F.col("n")) / (1 + F.abs(F.col("n") - IDEAL) / IDEAL) * F.when(F.col("shaped"), INTENT_BOOST).otherwise(1.0) * F.col("prior")
    return rows.select("qid", "doc_id", "page_index", "start", "stop", "text", "matched", F.round("coverage", 6).alias("coverage"), "shaped", F.round(score, 6).alias("score"))


def select(ranked: DataFrame) -> DataFrame:
    """At most ``MOST`` passages a question, one a page and ``PER_DOCUMENT`` a document, within ``BUDGET`` characters: rk."""
    w = lambda *by: Window.partitionBy("qid", *by).orderBy(F.desc("score"), *TIES)
    rows = ranked.withColumn("r", F.row_number().over(w("doc_id", "page_index"))).where("r = 1")
    rows = rows.withColumn("r", F.row_number().over(w("doc_id"))).where(F.col("r") <= PER_DOCUMENT)
    running = F.sum(F.length("text")).over(w().rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"rk": F.row_number().over(w()), "used": running})
    return rows.where((F.col("rk") <= MOST) & ((F.col("used") <= BUDGET) | (F.col("rk") == 1))).drop("r", "used")


def citations(selected: DataFrame, pages: DataFrame) -> DataFrame:
    """``selected`` with the passage's surroundings on its page as ``snippet`` (from ``begin`` to ``end``), some ``PAD`` characters on one line, without markers."""
    page = pages.select("doc_id", "page_index", F.col("text").alias("page"))
    room = F.greatest(F.lit(0), F.floor((PAD - (F.col("stop") - F.col("start"))) / 2)).cast("int")
    begin, end = F.greatest(F.lit(0), F.col("start") - room), F.least(F.length("page"), F.col("stop") + room)
    flat = markup.inline_text(F.substring("page", begin + 1, end - begin))
    snippet = F.concat(F.when(begin > 0, "…").otherwise(""), flat, F.when(end < F.length("page"), "…").otherwise(""))
    return selected.join(page, ["doc_id", "page_index"]).withColumns({"snippet": snippet, "begin": begin, "end": end}).drop("page")


def readable(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """qid and whether any of a question's candidates has text."""
    known = candidates.join(docs.select("doc_id", F.col("text").rlike(r"\S").alias("has_text")), "doc_id")
    return known.groupBy("qid").agg(F.bool_or(F.coalesce("has_text", F.lit(False))).alias("candidates_read"))


def compose(questions: DataFrame, selected: DataFrame, library: DataFrame, candidates_read: DataFrame) -> DataFrame:
    """One row for each question: kind, confidence, the best passage, its document, and the number of citations.

    ``library`` is one row: n_docs and n_readable; ``candidates_read`` is that of ``readable``. A question without a
    passage is empty_library, no_text (of all its candidates, or of the library where it has none), unclear (no terms) or
    no_match.
    """
    best = selected.where("rk = 1").select("qid", F.col("doc_id").alias("best_doc"), F.col("text").alias("answer"), "coverage", "shaped")
    cited = selected.groupBy("qid").agg(F.count("*").alias("n_citations"), F.count_distinct("doc_id").alias("n_documents"))
    rows = questions.select("qid", "mode", "terms", "phrases").join(best, "qid", "left").join(cited, "qid", "left").join(candidates_read, "qid", "left").crossJoin(F.broadcast(library))  # one row
    read = F.coalesce("candidates_read", F.col("n_readable") > 0)
    empty = F.when((F.size("terms") == 0) & (F.size("phrases") == 0), "unclear").when(F.col("n_docs") == 0, "empty_library").when(~read, "no_text").otherwise("no_match")
    whole = F.col("coverage") >= 0.999
    confidence = F.when(whole & F.col("shaped"), "strong").when(whole | F.col("shaped"), "partial").when(F.col("answer").isNotNull(), "weak")
    return rows.select("qid", "mode", F.when(F.col("answer").isNull(), empty).otherwise("answer").alias("kind"), confidence.alias("confidence"), "best_doc", "answer", F.coalesce("n_citations", F.lit(0)).alias("n_citations"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


def fallbacks(questions: DataFrame, selected: DataFrame) -> DataFrame:
    """Questions for a kind of value of which no passage was selected."""
    asked = questions.where("mode = 'answer' and intent <> 'general' and (size(terms) > 0 or size(phrases) > 0)")
    return asked.join(selected.select("qid").distinct(), "qid", "left_anti")
