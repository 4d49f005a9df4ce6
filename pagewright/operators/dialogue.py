"""What the assistant does with a question besides ranking passages: routes, targets, findings, explanations, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import lexicon as L
from pagewright.functions import text as T
from pagewright.operators import answers, facts, tiers

SCOPE_DOCUMENTS, MOST_VALUES, DIGEST_VALUES, COUNTED = 6, 15, 6, 20
#: kinds in the order of a digest, with the words for one and for several
LABELS = {
    "date": ("date", "dates"), "amount": ("amount", "amounts"), "person": ("name", "names"), "contact": ("contact detail", "contact details"),
    "identifier": ("reference number", "reference numbers"), "place": ("place", "places"),
}
#: fixed values: questions that are offered, by what they need
DOCUMENT_QUESTIONS = (("Summarise this document", None), ("Find important dates", "date"), ("Find amounts", "amount"), ("Find names", "person"), ("Find contact details", "contact"), ("Find reference numbers", "identifier"))
LIBRARY_QUESTIONS = (("Find all important dates", "date"), ("Who is mentioned in my documents?", "person"), ("What amounts are mentioned?", "amount"))
OFFERED = 4


def scoped_priors(docs: DataFrame, questions: DataFrame) -> DataFrame:
    """qid, doc_id, prior: the document of ``scope_doc_id`` where a question has one, else the best of the library."""
    own = questions.where("scope_doc_id is not null").select("qid", F.col("scope_doc_id").alias("doc_id"))
    own = own.join(docs.select("doc_id"), "doc_id", "left_semi").select("qid", "doc_id", F.lit(1.0).alias("prior"))
    return own.unionByName(answers.priors(docs, questions.where("scope_doc_id is null")))


def targets(docs: DataFrame, questions: DataFrame) -> DataFrame:
    """qid, target: the best hit of a question's subject terms, of questions that have any and hit anything."""
    asked = questions.where("size(subject_terms) > 0").select("qid", F.array_join("subject_terms", " ").alias("query"))
    return tiers.ranked(docs, asked, most=1).select("qid", F.col("doc_id").alias("target"))


def routed(questions: DataFrame, found: DataFrame) -> DataFrame:
    """qid, route, target: what is done with each analysed question, on which document."""
    q = questions.join(found, "qid", "left")
    prose = F.size(F.split(T.trimmed(F.col("subject")), r"\s+")) >= 8
    subject_tokens = T.tokens(F.col("subject"))
    whole = ~F.exists(subject_tokens, lambda t: ~t.isin(*L.WHOLE_DOCUMENT))
    explain = (
        F.when(T.trimmed(F.col("subject")) == "", "nothing_to_explain")
        .when(whole, "explain_latest")
        .when(F.col("subject_is_delimited") | prose, "explain_passage")
        .otherwise("explain_by_search")
    )
    missing = F.col("target").isNull()
    narrowed = F.size("subject_terms") > 0
    summary = F.when(~missing, "summarise").when(narrowed, "ask_which_document").otherwise("summarise_latest")
    find = F.when(missing, "find_in_library").otherwise("find_in_document")
    unclear = (F.size("terms") == 0) & (F.size("phrases") == 0)
    route = F.when(unclear, "unclear").when(F.col("mode") == "explain", explain).when(F.col("mode") == "summary", summary).when(F.col("mode") == "find", find).otherwise("retrieve")
    return q.select("qid", route.alias("route"), "target")


def latest_readable(docs: DataFrame, most: int = SCOPE_DOCUMENTS) -> DataFrame:
    """doc_id, place of the newest documents with text."""
    newest = docs.where(F.col("text").rlike(r"\S")).select("doc_id", "updated_at").orderBy(F.desc("updated_at"), F.desc("doc_id")).limit(most)
    return newest.withColumn("place", F.row_number().over(Window.orderBy(F.desc("updated_at"), F.desc("doc_id")))).select("doc_id", "place")  # ``most`` rows


def scope_values(pages: DataFrame, scopes: DataFrame, most: int) -> DataFrame:
    """scope, intent, rk, doc_id, page_index, start, value: the first different values of each kind in the documents of
    each scope (scope, doc_id, place)."""
    wanted = pages.join(scopes.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = facts.located(wanted).withColumn("value", facts.tidy(F.col("value"))).withColumn("key", facts.fingerprint(F.col("value"))).where("key <> ''")
    rows = rows.groupBy("doc_id", "intent", "key").agg(F.min(F.struct("page_index", "start", "value")).alias("f"))
    placed = scopes.join(rows, "doc_id").groupBy("scope", "intent", "key").agg(F.min(F.struct("place", "doc_id", "f.page_index", "f.start", "f.value")).alias("f"))
    order = Window.partitionBy("scope", "intent").orderBy("f")
    return placed.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= most).select("scope", "intent", "rk", "f.doc_id", "f.page_index", "f.start", "f.value")


def _label(intent: Column, plural: int) -> Column:
    out = F.lit(("entry", "entries")[plural])
    for name, words in LABELS.items():
        out = F.when(intent == name, words[plural]).otherwise(out)
    return out


def counted_label(n: Column, intent: Column) -> Column:
    """As in "three amounts"."""
    return F.concat(T.number_word(n), F.lit(" "), F.when(n == 1, _label(intent, 0)).otherwise(_label(intent, 1)))


def findings(asked: DataFrame, values: DataFrame, names: DataFrame) -> DataFrame:
    """qid, kind, confidence, n, text: answers made of the values of one kind in a scope.

    ``asked`` has qid, scope and intent, ``names`` the name of each scope.
    """
    listed = values.groupBy("scope", "intent").agg(F.array_sort(F.collect_list(F.struct("rk", "value"))).alias("v"))
    rows = asked.join(listed, ["scope", "intent"], "left").join(names, "scope")
    n = F.when(F.col("v").isNull(), 0).otherwise(F.size("v"))
    some = F.concat(F.lit("I found "), counted_label(n, F.col("intent")), F.lit(" in "), F.col("name"), F.lit(":\n"), F.array_join(F.transform("v", lambda x: F.concat(F.lit("• "), x["value"])), "\n"))
    none = F.concat(F.lit("I could not find any "), _label(F.col("intent"), 1), F.lit(" in "), F.col("name"), F.lit("."))
    return rows.select(
        "qid",
        F.when(n > 0, "extraction").otherwise("no_match").alias("kind"),
        F.when(n > 0, F.when(F.col("intent") == "person", "partial").otherwise("strong")).alias("confidence"),
        n.alias("n"),
        F.when(n > 0, some).otherwise(none).alias("text"),
    )


def fallback_answers(asked: DataFrame, values: DataFrame, names: DataFrame) -> DataFrame:
    """qid, kind, confidence, n, text for questions that no passage answers: what ``findings`` lists, and where it lists
    nothing no text, so that the first answer stands."""
    return findings(asked, values, names).withColumn("text", F.when(F.col("n") > 0, F.col("text")))


def digests(asked: DataFrame, values: DataFrame, names: DataFrame) -> DataFrame:
    """qid, kind, confidence, n, text: all kinds of values in a scope, a section each; ``asked`` has qid and scope."""
    few = values.where(F.col("rk") <= DIGEST_VALUES).groupBy("scope", "intent").agg(F.array_sort(F.collect_list(F.struct("rk", "value"))).alias("v"))
    order = F.array_position(F.array(*map(F.lit, LABELS)), F.col("intent"))
    section = F.concat(T.capitalised(_label(F.col("intent"), 1)), F.lit("\n"), F.array_join(F.transform("v", lambda x: F.concat(F.lit("• "), x["value"])), "\n"))
    sections = few.groupBy("scope").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), section.alias("s")))).alias("s"), F.sum(F.size("v")).alias("n"))
    rows = asked.join(sections, "scope", "left").join(names, "scope")
    some = F.concat(F.lit("Here is what stands out in "), F.col("name"), F.lit(":\n\n"), F.array_join(F.transform("s", lambda x: x["s"]), "\n\n"))
    none = F.concat(F.lit("I could not find any dates, amounts, names or reference numbers in "), F.col("name"), F.lit("."))
    have = F.col("s").isNotNull()
    return rows.select("qid", F.when(have, "extraction").otherwise("no_match").alias("kind"), F.when(have, "partial").alias("confidence"), F.coalesce("n", F.lit(0)).cast("int").alias("n"), F.when(have, some).otherwise(none).alias("text"))


def cited_documents(selected: DataFrame) -> DataFrame:
    """qid, documents (in the order in which they are first cited), spans_multiple."""
    first = selected.groupBy("qid", "doc_id").agg(F.min("rk").alias("rk"))
    return first.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "doc_id"))), lambda x: x["doc_id"]).alias("documents")).withColumn("spans_multiple", F.size("documents") > 1)


def page_citations(cited: DataFrame) -> DataFrame:
    """qid, doc_id, page_index, place, terms (all of the page's, in the order in which they come), relevance (the greatest,
    from 0 to 1) of ``cited`` (qid, place, doc_id, page_index, relevance, terms)."""
    by = cited.groupBy("qid", "doc_id", "page_index").agg(F.min("place").alias("place"), F.array_sort(F.collect_list(F.struct("place", "terms"))).alias("t"), F.max("relevance").alias("relevance"))
    terms = F.array_distinct(F.flatten(F.transform("t", lambda x: x["terms"])))
    return by.select("qid", "doc_id", "page_index", "place", terms.alias("terms"), F.least(F.greatest("relevance", F.lit(0.0)), F.lit(1.0)).alias("relevance"))


def related(docs: DataFrame, pages: DataFrame, selections: DataFrame) -> DataFrame:
    """Passages elsewhere with the wording of each selection (analysed, with ``question`` as its text), but not the same text."""
    ranked = answers.rank(selections, pages, answers.priors(docs, selections))
    flat = lambda c: F.lower(T.trimmed(F.regexp_replace(c, r"\s+", " ")))
    own = selections.select("qid", flat(F.col("question")).alias("own"))
    return answers.select(ranked.join(own, "qid").where(flat(F.col("text")) != F.col("own")).drop("own"))


def explained(topics: DataFrame, counts: DataFrame, titles: DataFrame) -> DataFrame:
    """doc_id, text: what a document is about, from its topics (doc_id, topics, from_headings), and how many facts of each
    kind (doc_id, intent, n) it records; a document without topics has no text."""
    order = F.array_position(F.array(*map(F.lit, LABELS)), F.col("intent"))
    records = counts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), counted_label(F.col("n"), F.col("intent")).alias("s")))).alias("r"))
    rows = topics.join(titles, "doc_id").join(records, "doc_id", "left")
    subject = F.concat(F.lit("“"), F.col("title"), F.lit("”"))
    covers = F.concat(subject, F.lit(" covers "), T.listed(F.col("topics")), F.lit("."))
    about = F.concat(subject, F.lit(" is about “"), T.without_stop(F.get("topics", F.lit(0))), F.lit("”."))
    also = F.concat(F.lit("\n\nIt also covers:\n"), F.array_join(F.transform(F.slice("topics", 2, 100), lambda t: F.concat(F.lit("• "), t)), "\n"))
    body = F.when(F.col("from_headings"), covers).otherwise(F.concat(about, F.when(F.size("topics") > 1, also).otherwise("")))
    tail = F.when(F.col("r").isNull(), "").otherwise(F.concat(F.lit("\n\nIt records "), T.listed(F.transform("r", lambda x: x["s"])), F.lit(".")))
    return rows.select("doc_id", F.when(F.size("topics") > 0, F.concat(body, tail)).alias("text"))


def suggested(docs: DataFrame) -> DataFrame:
    """doc_id, questions: up to four that a readable document can answer."""
    text = F.col("text")
    offers = F.array(*(F.when(facts.has(need, text) if need else F.lit(True), F.lit(q)) for q, need in DOCUMENT_QUESTIONS))
    some = F.slice(F.filter(offers, lambda q: q.isNotNull()), 1, OFFERED)
    return docs.where(text.rlike(r"\S")).select("doc_id", some.alias("questions"))


def suggested_for_library(docs: DataFrame) -> DataFrame:
    """One row: questions that the whole library can answer."""
    readable = docs.where(F.col("text").rlike(r"\S"))
    flags = readable.agg(F.max_by("title", F.struct("updated_at", "doc_id")).alias("title"), *(F.bool_or(facts.has(need, F.col("text"))).alias(need) for _, need in LIBRARY_QUESTIONS))
    offers = F.array(F.lit("Summarize my latest document"), F.concat(F.lit("What is the "), F.col("title"), F.lit(" about?")), *(F.when(F.col(need), F.lit(q)) for q, need in LIBRARY_QUESTIONS))
    return flags.where("title is not null").select(F.slice(F.filter(offers, lambda q: q.isNotNull()), 1, OFFERED).alias("questions"))


def recorded(texts: DataFrame) -> DataFrame:
    """doc_id, intent, n, values: how many values of each kind but places a text has, and the first six as they stand there."""
    rows = facts.located(texts, tuple(i for i in L.ANSWERS if i != "place")).groupBy("doc_id", "intent").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "value"))).alias("v"))
    return rows.select("doc_id", "intent", F.size("v").cast("long").alias("n"), F.array_join(F.transform(F.slice("v", 1, DIGEST_VALUES), lambda x: x["value"]), ", ").alias("values"))
