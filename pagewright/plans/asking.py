"""Queries of the assistant besides passage ranking: scopes, routes, findings, explanations, citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import lexicon as L
from pagewright.operators import answers as A
from pagewright.operators import dialogue, facts, passages, questions, summaries
from pagewright.plans import views as V
from pagewright.plans.views import RANKED, TIERS
from pagewright.plans.registry import query
from pagewright.sources import shared
from pagewright.plans.writing import CLAUSE

_TRIM = V._TRIM
_FLAT = r"regexp_replace(regexp_replace(%s, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


def _asked(spark, d):
    return questions.analysis(V.questions(spark, d))


def _long(df, *names):
    return df.withColumns({c: F.col(c).cast("long") for c in names})


# -- what a question is about

_SUBJECT = rf"""CASE WHEN mode <> 'explain' THEN '' WHEN contains(question, ':') AND length(question[strpos(question, ':') + 1:]) > 0 THEN {_TRIM % "question[strpos(question, ':') + 1:]"}
    ELSE {_TRIM % r"regexp_replace(question, '(?i)^\s*(explain|clarify)\b[:\s]*', '')"} END"""


@query(f"{V.QUESTIONS} SELECT qid, {_SUBJECT} AS subject, mode = 'explain' AND contains(question, ':') AS subject_is_delimited, brief FROM analysed")
def question_subjects(spark, d):
    return _asked(spark, d).select("qid", "subject", "subject_is_delimited", "brief")


_SUBJECTS = TIERS.replace("FROM searches", "FROM (SELECT qid, array_to_string(subject_terms, ' ') AS query FROM analysed WHERE len(subject_terms) > 0)")
_ROUTES = rf"""{V.QUESTIONS}{_SUBJECTS}{RANKED % ""}, target AS (SELECT qid, doc_id AS target FROM hits WHERE rk = 1),
subjects AS (SELECT *, {_SUBJECT} AS subject FROM analysed),
routes AS (SELECT qid, intent, brief, target, CASE WHEN len(terms) = 0 AND len(phrases) = 0 THEN 'unclear'
    WHEN mode = 'explain' THEN CASE WHEN subject = '' THEN 'nothing_to_explain' WHEN len({V._drop(V._TOKENS % "subject", L.WHOLE_DOCUMENT)}) = 0 THEN 'explain_latest'
        WHEN contains(question, ':') OR len(regexp_split_to_array({_TRIM % "subject"}, '\s+')) >= 8 THEN 'explain_passage' ELSE 'explain_by_search' END
    WHEN mode = 'summary' THEN CASE WHEN target IS NOT NULL THEN 'summarise' WHEN len(subject_terms) > 0 THEN 'ask_which_document' ELSE 'summarise_latest' END
    WHEN mode = 'find' THEN CASE WHEN target IS NULL THEN 'find_in_library' ELSE 'find_in_document' END ELSE 'retrieve' END AS route FROM subjects LEFT JOIN target USING (qid))"""


def _routes(spark, d, source=V.questions):
    q, docs = shared.kept(spark, questions.analysis(source(spark, d)), "questions"), V.documents(spark, d)
    return q, docs, dialogue.routed(q, dialogue.targets(docs, q))


@query(f"{_ROUTES} SELECT qid, route, target FROM routes")
def question_routes(spark, d):
    """What is done with each question, and on which document."""
    return _routes(spark, d)[2]


@query(f"""{V.QUESTIONS.replace("FROM conversations WHERE role = 'user'", "FROM conversations WHERE role = 'user' AND conv_id % 3 > 0")}{V.PRIORS}
SELECT qid, doc_id, prior FROM cand UNION ALL SELECT conv_id * 10000 + turn, doc_id, 1.0 FROM conversations JOIN docs ON doc_id = conv_id WHERE role = 'user' AND conv_id % 3 = 0""")
def scoped_priors(spark, d):
    """Candidates of each question; a third is asked about one document."""
    conv = F.expr("qid div 10000")
    q = _asked(spark, d).withColumn("scope_doc_id", F.when(conv % 3 == 0, conv))
    return dialogue.scoped_priors(V.documents(spark, d), q)


# -- findings

_KINDS = list(dialogue.LABELS)
_one = " ".join(f"WHEN '{k}' THEN '{w[0]}'" for k, w in dialogue.LABELS.items())
_many = " ".join(f"WHEN '{k}' THEN '{w[1]}'" for k, w in dialogue.LABELS.items())
_WORDS = "['no', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten']"
_COUNT = f"CASE WHEN n <= 10 THEN {_WORDS}[n + 1] ELSE n::VARCHAR END || ' ' || CASE WHEN n = 1 THEN CASE intent {_one} ELSE 'entry' END ELSE CASE intent {_many} ELSE 'entries' END END"

#: the questions that ask for values, with their scope: the document they name, or the library's newest
_NEWEST = r", newest AS (SELECT doc_id, row_number() OVER (ORDER BY updated_at DESC, doc_id DESC) AS place FROM docs WHERE regexp_matches(text, '\S') ORDER BY place LIMIT 6)"
_VALUES = rf"""scopes AS (SELECT DISTINCT scope, target AS doc_id, 1::BIGINT AS place FROM asking WHERE target IS NOT NULL UNION ALL SELECT 'library', doc_id, place FROM newest),
names AS (SELECT 'library' AS scope, 'your documents' AS name UNION ALL SELECT doc_id::VARCHAR, title FROM docs),
inside AS (SELECT scope, intent, key, min({{'place': place, 'doc_id': scopes.doc_id, 'page_index': page_index, 'start': start, 'value': value}}) AS f FROM scopes JOIN (SELECT doc_id, intent, key, page_index, start, v AS value,
    row_number() OVER (PARTITION BY doc_id, intent, key ORDER BY page_index, start, v) AS r FROM keyed WHERE key <> '') x ON x.doc_id = scopes.doc_id AND r = 1 GROUP BY 1, 2, 3),
vals AS (SELECT scope, intent, f.value AS value, row_number() OVER (PARTITION BY scope, intent ORDER BY f) AS rk FROM inside),
vlist AS (SELECT scope, intent, count(*) AS n, string_agg('• ' || value, chr(10) ORDER BY rk) AS listed FROM vals WHERE rk <= 15 GROUP BY 1, 2)"""
_SCOPES = rf"""{_ROUTES.replace(V.QUESTIONS, V.VALUE_QUESTIONS)}{_NEWEST}{V.FACTS}{V.FACT_KEYS},
asking AS (SELECT qid, intent, coalesce(target::VARCHAR, 'library') AS scope, target FROM routes WHERE route IN ('find_in_document', 'find_in_library')),
{_VALUES}"""


def _scoped(spark, d, asked):
    """Questions (qid, intent, target) with their scope, the values of each scope, and its name."""
    docs, pages = V.documents(spark, d), V.pages(spark, d)
    asked = asked.withColumn("scope", F.coalesce(F.col("target").cast("string"), F.lit("library")))
    own = asked.where("target is not null").select("scope", F.col("target").alias("doc_id"), F.lit(1).alias("place")).distinct()
    scopes = own.unionByName(dialogue.latest_readable(docs).select(F.lit("library").alias("scope"), "doc_id", "place"))
    names = docs.select(F.col("doc_id").cast("string").alias("scope"), F.col("title").alias("name")).join(scopes.select("scope").distinct(), "scope", "left_semi")
    names = names.unionByName(spark.range(1).select(F.lit("library").alias("scope"), F.lit("your documents").alias("name")))
    return asked, dialogue.scope_values(pages, scopes, dialogue.MOST_VALUES), names


@query(rf"""{_SCOPES}, few AS (SELECT scope, intent, count(*) AS n, string_agg('• ' || value, chr(10) ORDER BY rk) AS listed FROM vals WHERE rk <= 6 GROUP BY 1, 2),
digest AS (SELECT scope, sum(n) AS n, string_agg(upper(label[1:1]) || label[2:] || chr(10) || listed, chr(10) || chr(10) ORDER BY list_position({V._list(_KINDS)}, intent)) AS sections
    FROM (SELECT *, CASE intent {_many} END AS label FROM few) GROUP BY 1)
SELECT qid, CASE WHEN n IS NULL THEN 'no_match' ELSE 'extraction' END AS kind, CASE WHEN n IS NULL THEN NULL WHEN intent = 'person' THEN 'partial' ELSE 'strong' END AS confidence, coalesce(n, 0)::INT AS n,
    CASE WHEN n IS NULL THEN 'I could not find any ' || CASE intent {_many} END || ' in ' || name || '.' ELSE 'I found ' || {_COUNT} || ' in ' || name || ':' || chr(10) || listed END AS text
FROM asking LEFT JOIN vlist USING (scope, intent) JOIN names USING (scope) WHERE intent <> 'general'
UNION ALL SELECT qid, CASE WHEN n IS NULL THEN 'no_match' ELSE 'extraction' END, CASE WHEN n IS NULL THEN NULL ELSE 'partial' END, coalesce(n, 0)::INT,
    CASE WHEN n IS NULL THEN 'I could not find any dates, amounts, names or reference numbers in ' || name || '.' ELSE 'Here is what stands out in ' || name || ':' || chr(10) || chr(10) || sections END
FROM asking LEFT JOIN digest USING (scope) JOIN names USING (scope) WHERE intent = 'general'""")
def find_answers(spark, d):
    """Answers to questions that ask for all values of a kind, or for whatever stands out."""
    q, _, routes = _routes(spark, d, V.value_questions)
    finding = routes.where("route in ('find_in_document', 'find_in_library')").join(q.select("qid", "intent"), "qid")
    asked, values, names = _scoped(spark, d, shared.kept(spark, finding, "finding"))
    listed = dialogue.findings(asked.where("intent <> 'general'").select("qid", "scope", "intent"), values, names)
    return listed.unionByName(dialogue.digests(asked.where("intent = 'general'").select("qid", "scope"), values, names))


_SELECTED = f"{V.SPANS}{V.QUESTIONS}{V.PRIORS}{V.RANK}{V.SELECTED}"
_UNANSWERED = "SELECT qid, intent, subject_terms FROM analysed WHERE mode = 'answer' AND intent <> 'general' AND (len(terms) > 0 OR len(phrases) > 0) AND qid NOT IN (SELECT qid FROM selected)"
_VALUED = _SELECTED.replace(V.QUESTIONS, V.VALUE_QUESTIONS)


def _unanswered(spark, d):
    q = shared.kept(spark, questions.analysis(V.value_questions(spark, d)), "questions")
    candidates = shared.kept(spark, A.priors(V.documents(spark, d), q), "candidates")
    return shared.kept(spark, A.fallbacks(q, A.select(A.rank(q, V.pages(spark, d), candidates))), "unanswered")


@query(f"{_VALUED} SELECT qid, intent, array_to_string(subject_terms, ' ') AS subject_terms FROM ({_UNANSWERED})")
def fallback_questions(spark, d):
    """Questions for a value that no passage answers: those that then list what there is of the kind."""
    return _unanswered(spark, d).select("qid", "intent", F.array_join("subject_terms", " ").alias("subject_terms"))


_FALLBACK = rf"""{_VALUED}{_SUBJECTS}{RANKED % ""}{_NEWEST}{V.FACTS}{V.FACT_KEYS}, open_q AS ({_UNANSWERED}), target AS (SELECT qid, doc_id AS target FROM hits WHERE rk = 1),
asking AS (SELECT qid, intent, coalesce(target::VARCHAR, 'library') AS scope, target FROM open_q LEFT JOIN target USING (qid)),{_VALUES}"""


@query(f"""{_FALLBACK} SELECT qid, CASE WHEN n IS NULL THEN 'no_match' ELSE 'extraction' END AS kind, CASE WHEN n IS NOT NULL THEN CASE WHEN intent = 'person' THEN 'partial' ELSE 'strong' END END AS confidence, coalesce(n, 0)::INT AS n,
    CASE WHEN n IS NOT NULL THEN 'I found ' || {_COUNT} || ' in ' || name || ':' || chr(10) || listed END AS text FROM asking LEFT JOIN vlist USING (scope, intent) JOIN names USING (scope)""")
def fallback_answers(spark, d):
    """What those questions are answered with: the values of the kind in the document that the subject points to, or in the
    newest ones. Where there are none, the question stays without a match and has no text."""
    open_q = _unanswered(spark, d)
    asked, values, names = _scoped(spark, d, open_q.join(dialogue.targets(V.documents(spark, d), open_q), "qid", "left").select("qid", "intent", "target"))
    return dialogue.fallback_answers(asked, values, names)


@query(rf"""{V.FACTS}{V.FACT_KEYS}, newest AS (SELECT doc_id, row_number() OVER (ORDER BY updated_at DESC, doc_id DESC) AS place FROM docs WHERE regexp_matches(text, '\S') ORDER BY place LIMIT 6),
inside AS (SELECT intent, key, min({{'place': place, 'doc_id': newest.doc_id, 'page_index': page_index, 'start': start, 'value': v}}) AS f FROM newest JOIN keyed ON keyed.doc_id = newest.doc_id WHERE key <> '' GROUP BY 1, 2)
SELECT * FROM (SELECT intent, row_number() OVER (PARTITION BY intent ORDER BY f) AS rk, f.doc_id AS doc_id, f.page_index AS page_index, f.start AS start, f.value AS value FROM inside) WHERE rk <= 15""")
def library_findings(spark, d):
    """The first values of each kind in the newest documents: what a question without a document gets."""
    scopes = dialogue.latest_readable(V.documents(spark, d)).select(F.lit("library").alias("scope"), "doc_id", "place")
    return _long(dialogue.scope_values(V.pages(spark, d), scopes, dialogue.MOST_VALUES), "page_index", "start").drop("scope")


# -- related passages and selections: the items' texts stand for selected passages

_CHOSEN = V.QUESTIONS.replace("SELECT conv_id * 10000 + turn AS qid, coalesce(text, '') AS question FROM conversations WHERE role = 'user'", "SELECT item_id AS qid, coalesce(text, '') AS question FROM benchmark")
_RELATED = f"""{V.SPANS}{_CHOSEN}{V.PRIORS}{V.RANK.replace("FROM r4)", f"FROM r4 WHERE lower({_FLAT % 'text'}) <> (SELECT lower({_FLAT % 'question'}) FROM q0 WHERE q0.qid = r4.qid))")}{V.SELECTED}"""


def _selections(spark, d):
    return questions.analysis(V.table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question")))


@query(f"{_RELATED} SELECT qid, doc_id, page_index, start, rk FROM selected")
def related_passages(spark, d):
    """Other places with the wording of a selected passage."""
    found = dialogue.related(V.documents(spark, d), V.pages(spark, d), _selections(spark, d))
    return _long(found, "page_index").select("qid", "doc_id", "page_index", "start", "rk")


_OWN = V.FACTS.replace("FROM pgs)", "FROM (SELECT item_id AS doc_id, 0 AS page_index, text FROM benchmark UNION ALL SELECT -doc_id, 0, text FROM pgs WHERE page_index = 0 AND doc_id % 5 = 1))", 1)


@query(f"""{_OWN}, nth AS (SELECT doc_id AS qid, intent, value, row_number() OVER (PARTITION BY doc_id, intent ORDER BY start, kind, value) AS rk, count(*) OVER (PARTITION BY doc_id, intent) AS n FROM located WHERE intent <> 'place')
SELECT qid, intent, any_value(n) AS n, string_agg(value, ', ' ORDER BY rk) AS "values" FROM nth WHERE rk <= 6 GROUP BY 1, 2""")
def selection_facts(spark, d):
    """What a selected passage (an item, or a document's first page) records: the first six values of each kind, as they stand there."""
    own = V.table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(0).alias("page_index"), "text")
    first = V.pages(spark, d).where("page_index = 0 and doc_id % 5 = 1").select((-F.col("doc_id")).alias("doc_id"), "page_index", "text")
    return dialogue.recorded(own.unionByName(first)).withColumnRenamed("doc_id", "qid")


# -- citations

_TOP = f"{_SELECTED}, cited AS (SELECT *, score / max(score) OVER (PARTITION BY qid) AS relevance FROM selected)"


def _chosen(spark, d):
    q, pages = _asked(spark, d), V.pages(spark, d)
    return A.select(A.rank(q, pages, A.priors(V.documents(spark, d), q)))


@query(f"""{_TOP} SELECT qid, array_to_string(list_transform(list_sort(list({{'rk': rk, 'doc_id': doc_id}})), lambda x: x.doc_id::VARCHAR), ',') AS documents, count(*) > 1 AS spans_multiple
FROM (SELECT qid, doc_id, min(rk) AS rk FROM cited GROUP BY 1, 2) GROUP BY 1""")
def citation_rollup(spark, d):
    """The documents that an answer cites, in order."""
    return dialogue.cited_documents(_chosen(spark, d)).withColumn("documents", F.array_join(F.transform("documents", lambda x: x.cast("string")), ","))


@query(f"{_TOP} SELECT qid, doc_id, page_index, min(rk) AS place, round(max(least(greatest(relevance, 0), 1)), 6) AS relevance FROM cited GROUP BY 1, 2, 3")
def citations_by_page(spark, d):
    """One citation a page, with the relevance of its best passage."""
    from pyspark.sql import Window

    top = F.max("score").over(Window.partitionBy("qid"))
    cited = _chosen(spark, d).select("qid", F.col("rk").alias("place"), "doc_id", "page_index", (F.col("score") / top).alias("relevance"), F.col("matched").alias("terms"))
    return _long(dialogue.page_citations(cited), "page_index").select("qid", "doc_id", "page_index", "place", F.round("relevance", 6).alias("relevance"))


# -- summaries and outlines

_GREEDY = r""", wordy AS (SELECT scored.*, spans.text, list_distinct(%s) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, page_index, start) AS i FROM scored JOIN spans USING (doc_id, page_index, start)),
fold AS (SELECT doc_id, 1::BIGINT AS i, [words] AS chosen, length(text) AS used, %d <= 1 AS done, true AS took FROM wordy WHERE i = 1
    UNION ALL SELECT doc_id, i, CASE WHEN take THEN list_append(chosen, words) ELSE chosen END, CASE WHEN take THEN used + n ELSE used END, over OR (take AND len(chosen) + 1 >= %d), take
    FROM (SELECT w.doc_id, w.i, f.chosen, f.used, w.words, length(w.text) AS n, NOT alike AND f.used + length(w.text) > %d AS over, NOT alike AND f.used + length(w.text) <= %d AS take
        FROM (SELECT * FROM fold WHERE NOT done) f JOIN wordy w ON w.doc_id = f.doc_id AND w.i = f.i + 1,
        LATERAL (SELECT len(list_filter(f.chosen, lambda c: len(list_intersect(c, w.words)) >= 0.6::DOUBLE * len(list_distinct(list_concat(c, w.words))))) > 0 AS alike))),
chosen AS (SELECT doc_id, wordy.page_index, wordy.start, wordy.text, score, max(score) OVER (PARTITION BY doc_id) AS best FROM fold JOIN wordy USING (doc_id, i) WHERE took)"""


def greedy(sentences: int, budget: int) -> str:
    return f"{V.SPANS}{V.WEIGHTS}{V.SCORES}{_GREEDY % (V._TOKENS % 'spans.text', sentences, sentences, budget, budget)}"


_MARKED = ", marks AS (SELECT doc_id, page_index, start, list_transform(list_sort(list({'w': -round(weight, 9), 'term': term}))[1:3], lambda x: x.term) AS highlights FROM wc JOIN weights USING (doc_id, term) GROUP BY 1, 2, 3)"
_PLACED = f"""{_MARKED} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_index, start) AS place, page_index, start, text, round(CASE WHEN best <= 0 THEN 0 ELSE score / best END, 6) AS weight,
    array_to_string(highlights, ' ') AS highlights FROM chosen JOIN marks USING (doc_id, page_index, start)"""


def _summary(spark, d, *limits):
    found = summaries.summaries(summaries.scores(passages.passages(V.pages(spark, d))), *limits, dealt=True)
    rows = found.select("doc_id", F.posexplode("sentences").alias("k", "s")).select("doc_id", (F.col("k") + 1).alias("place"), "s.*")
    return _long(rows, "place", "page_index").withColumn("highlights", F.array_join("highlights", " "))


@query(greedy(5, 1200) + _PLACED)
def summary(spark, d):
    """The chosen sentences of each document, in its order."""
    return _summary(spark, d)


@query(greedy(2, 600) + _PLACED)
def summary_brief(spark, d):
    return _summary(spark, d, 2, 600)


#: topics: the opening line and four sentences
_TOPICS = rf"""{greedy(4, 1200)}, l AS (SELECT doc_id, ln // 10 AS page_index, ln % 10 AS line_no, {_FLAT % "line"} AS f FROM doc_lines),
opening AS (SELECT doc_id, arg_min({CLAUSE % {"f": "f"}}, {{'p': page_index, 'l': line_no}}) AS opening FROM l WHERE length(f) >= 20 AND NOT regexp_matches(f, '^[^:]{{1,28}}:\s*\S') GROUP BY 1),
said AS (SELECT doc_id, list({CLAUSE % {"f": "f"}} ORDER BY page_index, start) AS said FROM (SELECT *, {_FLAT % "text"} AS f FROM chosen) GROUP BY 1),
topics AS (SELECT d.doc_id, CASE WHEN opening IS NULL THEN coalesce(said, []) ELSE list_concat([opening], list_filter(coalesce(said, []), lambda s: s <> opening)) END[1:8] AS topics FROM docs d LEFT JOIN opening USING (doc_id) LEFT JOIN said USING (doc_id))"""


def _outline(spark, d):
    pages = V.pages(spark, d)
    return summaries.outlines(V.documents(spark, d), pages, summaries.scores(passages.passages(pages)), dealt=True)


@query(f"{_TOPICS} SELECT doc_id, array_to_string(topics, chr(10)) AS topics, false AS from_headings FROM topics")
def doc_outline(spark, d):
    """What each document is about; the given tables have no headings, which ``heading_topics`` covers."""
    return _outline(spark, d).withColumn("topics", F.array_join("topics", "\n"))


@query(rf""", h AS (SELECT doc_id, page_index, ln, {_TRIM % r"regexp_replace(line, '^#{1,3}\s+', '')"} AS topic, lower({_TRIM % "title"}) AS t FROM note_lines JOIN docs USING (doc_id) WHERE regexp_matches(line, '^#{{1,3}}\s+')),
k AS (SELECT doc_id, lower(topic) AS key, min({{'ln': ln, 'topic': topic}}) AS f FROM h WHERE topic <> '' AND length(topic) <= 90 AND lower(topic) <> t GROUP BY 1, 2)
SELECT * FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY f.ln) AS place, f.topic AS topic FROM k) WHERE place <= 8""")
def heading_topics(spark, d):
    """The different headings of the notes, without those that repeat a title."""
    return summaries.heading_topics(V.documents(spark, d), V.notes(spark, d)).select("doc_id", F.col("place").cast("long").alias("place"), "topic")


_COUNTED = f"""{V.FACTS}{V.FACT_KEYS}, kinds AS (SELECT doc_id, intent, least(count(*), 20) AS n FROM ranked_facts GROUP BY 1, 2),
records AS (SELECT doc_id, list({_COUNT} ORDER BY list_position({V._list(_KINDS)}, intent)) AS r FROM kinds GROUP BY 1)"""


@query(f"""{_TOPICS}{_COUNTED}
SELECT doc_id, CASE WHEN len(topics) > 0 THEN '“' || title || '” is about “' || CASE WHEN topics[1] LIKE '%.' THEN topics[1][1:-2] ELSE topics[1] END || '”.'
    || CASE WHEN len(topics) > 1 THEN chr(10) || chr(10) || 'It also covers:' || chr(10) || array_to_string(list_transform(topics[2:], lambda t: '• ' || t), chr(10)) ELSE '' END
    || CASE WHEN r IS NULL THEN '' ELSE chr(10) || chr(10) || 'It records ' || CASE WHEN len(r) = 1 THEN r[1] ELSE array_to_string(r[1:-2], ', ') || ' and ' || r[-1] END || '.' END END AS text
FROM topics JOIN docs USING (doc_id) LEFT JOIN records USING (doc_id)""")
def explanations(spark, d):
    """What each document is about and what it records, in words."""
    counts = facts.top(V.pages(spark, d), dialogue.COUNTED).groupBy("doc_id", "intent").agg(F.count("*").alias("n"))
    return dialogue.explained(_outline(spark, d), counts, V.documents(spark, d).select("doc_id", "title"))


# -- suggestions


def _offer(table_text: str, pairs) -> str:
    has = {i: V._has(i).replace("(text,", f"({table_text},") for i in L.ANSWERS}
    return ", ".join(f"CASE WHEN {has[need] if need else 'true'} THEN {V._text(q)} END" for q, need in pairs)


@query(rf"""SELECT doc_id, array_to_string(list_filter([{_offer("text", dialogue.DOCUMENT_QUESTIONS)}], lambda q: q IS NOT NULL)[1:4], '|') AS questions FROM docs WHERE regexp_matches(text, '\S')""")
def suggested_questions(spark, d):
    """Up to four questions that each document can answer."""
    return dialogue.suggested(V.documents(spark, d)).withColumn("questions", F.array_join("questions", "|"))


@query(rf""", f AS (SELECT arg_max(title, {{'u': updated_at, 'd': doc_id}}) AS title, bool_or({V._has("date")}) AS a, bool_or({V._has("person")}) AS b, bool_or({V._has("amount")}) AS c FROM docs WHERE regexp_matches(text, '\S'))
SELECT array_to_string(list_filter(['Summarize my latest document', 'What is the ' || title || ' about?', CASE WHEN a THEN 'Find all important dates' END, CASE WHEN b THEN 'Who is mentioned in my documents?' END,
    CASE WHEN c THEN 'What amounts are mentioned?' END], lambda q: q IS NOT NULL)[1:4], '|') AS questions FROM f WHERE title IS NOT NULL""")
def library_questions(spark, d):
    """Up to four questions that the whole library can answer."""
    return dialogue.suggested_for_library(V.documents(spark, d)).withColumn("questions", F.array_join("questions", "|"))
