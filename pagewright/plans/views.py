"""The library's tables, derived from the given ones; the same rules as SQL for DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import lexicon as L

PAGE_LINES = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals rows anew only where the input has fewer parts than the cluster has cores, which a large input never has."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, title, text, tags, updated_at, is_favorite, doc_source."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return d.select(
        "doc_id",
        F.substring(F.split("text", "\n")[0], 1, 120).alias("title"),
        "text",
        F.array("lang", "source").alias("tags"),
        F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(doc_id as int), 0)").alias("updated_at"),
        (F.col("doc_id") % 7 == 0).alias("is_favorite"),
        F.element_at(F.array(*map(F.lit, ("scanned", "imported", "created", "archive"))), (F.col("doc_id") % 4 + 1).cast("int")).alias("doc_source"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_index, text, kind, ocr_status: ten lines a page."""
    lines = F.split("text", "\n", -1)
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", lines.alias("lines"))
    n = F.ceil(F.size("lines") / PAGE_LINES).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda p: F.array_join(F.slice("lines", p * PAGE_LINES + 1, PAGE_LINES), "\n"))
    page = d.select("doc_id", F.posexplode(cut).alias("page_index", "text"))
    turn = F.col("doc_id") + F.col("page_index")
    return page.select(
        "doc_id",
        "page_index",
        "text",
        F.when(F.col("doc_id") % 4 == 2, "text").otherwise("image").alias("kind"),
        F.when(F.col("doc_id") % 4 == 2, "completed").when(turn % 11 == 0, "pending").when(turn % 13 == 0, "failed").otherwise("completed").alias("ocr_status"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, role, text of user and assistant turns."""
    return table(spark, sf_dir, "conversations").where("role <> 'system'").select("conv_id", "turn", "role", "text")


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid and the query's distinct terms: the whole text of an item."""
    from pagewright.functions.text import tokens

    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.array_distinct(tokens(F.col("text"))).alias("terms"))


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, query: for each item its text, and the title and the tags of one document."""
    items = table(spark, sf_dir, "benchmark").select((F.col("item_id") * 3).alias("qid"), F.col("text").alias("query"), (F.col("item_id") * 37).alias("doc_id"))
    found = items.join(documents(spark, sf_dir), "doc_id").select("qid", "title", F.array_join("tags", " ").alias("tags"))
    return items.select("qid", "query").unionByName(found.select((F.col("qid") + 1).alias("qid"), F.col("title").alias("query"))).unionByName(found.select((F.col("qid") + 2).alias("qid"), F.col("tags").alias("query")))


#: what a line of ``notes`` is turned into, by its number and document
_NOTES = (("# ", ""), ("## ", ""), ("- ", ""), ("{n}. ", ""), ("> ", ""), ("**", "** and _more_"), ("", ""), ("### ", " *stray"), ("  * ", ""))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as written notes: doc_id, page_index, text with markup on every line, pictures between them."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ln", "line"))
    turn = (F.col("doc_id") + F.col("ln")) % (len(_NOTES) + 1)
    line = F.concat(F.lit("![Image](p"), F.col("doc_id") % 50, F.lit("-"), F.col("ln") % 3, F.lit(".jpg)"))
    for k, (before, after) in enumerate(_NOTES):
        start = F.concat((F.col("ln") % 100).cast("string"), F.lit(". ")) if "{n}" in before else F.lit(before)
        line = F.when(turn == k, F.concat(start, F.col("line"), F.lit(after))).otherwise(line)
    rows = lines.select("doc_id", F.floor(F.col("ln") / PAGE_LINES).cast("int").alias("page_index"), F.struct("ln", line.alias("line")).alias("l"))
    return rows.groupBy("doc_id", "page_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda l: l["line"]), "\n").alias("text"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, question: the user turns."""
    return table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 10000 + F.col("turn")).alias("qid"), F.col("text").alias("question"))


#: questions that ask for values, by documents: of a kind that no passage gives, with a word of the title or without, and of all
_ASKING = (
    (20, 1, "What is the phone number of {word} xqz{id} wqz{id} vqz{id}?"), (20, 2, "When does vqz{id} expire?"), (40, 3, "Who signed xqz{id}?"),
    (60, 4, "List all dates"), (60, 5, "Show me all names"), (60, 6, "Show the important information"),
)


def value_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``questions``, and such that ask for values."""
    d = documents(spark, sf_dir).select("doc_id", F.regexp_extract("title", "([A-Za-z]{4,})", 1).alias("word"))
    asked = F.explode(F.array(*(F.struct(F.lit(n).alias("every"), F.lit(k).alias("k"), F.lit(text).alias("text")) for n, k, text in _ASKING))).alias("a")
    rows = d.select("doc_id", "word", asked).where("doc_id % a.every = 0")
    shown = F.replace(F.replace("a.text", F.lit("{word}"), F.col("word")), F.lit("{id}"), F.col("doc_id").cast("string"))
    return questions(spark, sf_dir).unionByName(rows.select((-(F.col("doc_id") * 10 + F.col("a.k"))).alias("qid"), shown.alias("question")))


def archive_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """archive (host), entry_no, path, size: pages as entries of one archive a host."""
    p = table(spark, sf_dir, "pages")
    rest = F.regexp_extract("url", "://([^?#]*)", 1)
    return p.select(
        F.regexp_extract(rest, "^([^/]*)", 1).alias("archive"),
        F.col("page_id").alias("entry_no"),
        F.regexp_extract(rest, "^[^/]*/(.*)$", 1).alias("path"),
        F.octet_length("html").cast("long").alias("size"),
        (F.octet_length("html") / (F.col("page_id") % 400 + 1)).cast("long").alias("compressed"),
    )


#: the same views for DuckDB
SQL = r"""
docs AS (SELECT doc_id, substr(string_split(text, chr(10))[1], 1, 120) AS title, text, [lang, source] AS tags,
    TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS updated_at, doc_id % 7 = 0 AS is_favorite,
    ['scanned', 'imported', 'created', 'archive'][doc_id % 4 + 1] AS doc_source FROM documents),
doc_lines AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS ln, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
pgs AS (SELECT doc_id, ln // 10 AS page_index, string_agg(line, chr(10) ORDER BY ln) AS text,
    CASE WHEN doc_id % 4 = 2 THEN 'text' ELSE 'image' END AS kind,
    CASE WHEN doc_id % 4 = 2 THEN 'completed' WHEN (doc_id + ln // 10) % 11 = 0 THEN 'pending' WHEN (doc_id + ln // 10) % 13 = 0 THEN 'failed' ELSE 'completed' END AS ocr_status
    FROM doc_lines GROUP BY doc_id, ln // 10),
note_lines AS (SELECT doc_id, ln // 10 AS page_index, ln, CASE (doc_id + ln) % 10 WHEN 0 THEN '# ' || line WHEN 1 THEN '## ' || line WHEN 2 THEN '- ' || line WHEN 3 THEN (ln % 100) || '. ' || line
    WHEN 4 THEN '> ' || line WHEN 5 THEN '**' || line || '** and _more_' WHEN 6 THEN line WHEN 7 THEN '### ' || line || ' *stray' WHEN 8 THEN '  * ' || line
    ELSE '![Image](p' || (doc_id % 50) || '-' || (ln % 3) || '.jpg)' END AS line FROM doc_lines),
notes AS (SELECT doc_id, page_index, string_agg(line, chr(10) ORDER BY ln) AS text FROM note_lines GROUP BY 1, 2),
toks AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: length(x) >= 2) AS body,
    list_filter(regexp_split_to_array(lower(title), '[^\p{L}\p{N}]+'), lambda x: length(x) >= 2) AS title_tokens FROM docs),
messages AS (SELECT conv_id, turn, role, text FROM conversations WHERE role <> 'system'),
search_terms AS (SELECT DISTINCT item_id AS qid, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: length(x) >= 2)) AS term FROM benchmark),
searches AS (SELECT item_id * 3 AS qid, text AS query FROM benchmark UNION ALL SELECT item_id * 3 + 1, title FROM benchmark JOIN docs ON doc_id = item_id * 37
    UNION ALL SELECT item_id * 3 + 2, tags[1] || ' ' || tags[2] FROM benchmark JOIN docs ON doc_id = item_id * 37),
entries AS (SELECT regexp_extract(regexp_extract(url, '://([^?#]*)', 1), '^([^/]*)', 1) AS archive, page_id AS entry_no,
    regexp_extract(regexp_extract(url, '://([^?#]*)', 1), '^[^/]*/(.*)$', 1) AS path, strlen(html)::BIGINT AS size,
    trunc(strlen(html) / (page_id % 400 + 1))::BIGINT AS compressed FROM pages)
"""


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(map(_text, words)) + "]"


def _any(words, of: str = "tokens") -> str:
    return f"list_has_any({of}, {_list(words)})"


def _holds(phrases) -> str:
    return "(" + " OR ".join(f"contains(normalised, {_text(p)})" for p in phrases) + ")"


def _drop(of: str, words) -> str:
    return f"list_filter({of}, lambda x: NOT list_contains({_list(sorted(set(words)))}, x))"


def _first(of: str) -> str:
    """Each value once, where it stands first."""
    return f"list_filter({of}, lambda x, i: list_position({of}, x) = i)"


_TRIM = r"regexp_replace(%s, '^\s+|\s+$', '', 'g')"
_TOKENS = r"list_filter(regexp_split_to_array(lower(%s), '[^\p{L}\p{N}]+'), lambda x: length(x) >= 2)"
_BREAKS = r"([.!?;])(\s+)|(\n+)"

#: passages of at most 220 characters, with offsets: parts between marks, long ones cut one piece a step
SPANS = rf""", marked AS (SELECT doc_id, page_index, string_split_regex(regexp_replace(translate(text, chr(1) || chr(2), '  '), '{_BREAKS}', '\1' || chr(1) || '\2\3' || chr(2), 'g'), '[\x01\x02]') AS parts FROM pgs),
part AS (SELECT doc_id, page_index, parts[i] AS span, coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: length(x))), 0)::BIGINT AS pos
    FROM (SELECT doc_id, page_index, parts, unnest(range(1, len(parts) + 1)) AS i FROM marked)),
pieces AS (SELECT doc_id, page_index, pos, '' AS piece, span AS rest FROM part
    UNION ALL SELECT doc_id, page_index, pos + length(piece), rest[1:k], rest[k + 1:] FROM (SELECT *, CASE WHEN length(rest) <= 220 THEN length(rest)
        ELSE coalesce(nullif(length(regexp_extract(rest[1:221], '(?s)^(.+) ', 1)), 0), 220) END AS k FROM pieces WHERE rest <> '')),
spans AS (SELECT doc_id, page_index, pos + length(piece) - length(regexp_replace(piece, '^\s+', '')) AS start, {_TRIM % "piece"} AS text FROM pieces WHERE length({_TRIM % "piece"}) >= 12)"""

#: questions with what they ask for
_normalised = "lower(question)"
for _short, _long in L.CONTRACTIONS.items():
    _normalised = f"replace({_normalised}, {_text(_short)}, {_text(_long)})"
_intent = " ".join(f"WHEN {_any(words)} THEN '{name}'" for name, words in L.INTENTS.items())
_alike = "MAP {" + ", ".join(f"{_text(t)}: {_list(o)}" for t, o in L.ALTERNATIVES.items()) + "}"
QUESTIONS = rf""", q0 AS (SELECT conv_id * 10000 + turn AS qid, coalesce(text, '') AS question FROM conversations WHERE role = 'user'),
q1 AS (SELECT qid, question, {_normalised} AS normalised, list_filter(list_transform(regexp_extract_all(question, '"([^"]+)"', 1), lambda p: lower({_TRIM % "p"})), lambda p: p <> '') AS phrases FROM q0),
q2 AS (SELECT *, {_TOKENS % "normalised"} AS tokens FROM q1),
q3 AS (SELECT *, {_drop(_first("tokens"), L.STOPWORDS)} AS plain, CASE {_intent} ELSE 'general' END AS intent FROM q2),
q4 AS (SELECT *, CASE WHEN len(plain) = 0 AND len(phrases) = 0 THEN {_first("tokens")} ELSE plain END AS terms,
    CASE WHEN {_any(L.EXPLAIN + L.ABOUT)} OR {_holds(L.ABOUT_PHRASES)} OR regexp_matches({_TRIM % "normalised"}, {_text(L.ABOUT_PATTERN)}) THEN 'explain'
    WHEN {_any(L.SUMMARY)} OR {_holds(L.SUMMARY_PHRASES)} THEN 'summary'
    WHEN len({_drop("tokens", L.STOPWORDS + L.REQUEST + L.VOCABULARY)}) = 0 AND ({_any(L.ENUMERATION + L.PLURALS + L.MENTION + L.POINTING)} OR {_holds(L.ENUMERATION_PHRASES)})
        AND intent <> 'place' THEN 'find' ELSE 'answer' END AS mode FROM q3),
q5 AS (SELECT *, {_drop("terms", L.REQUEST)} AS c, {_alike} AS alike FROM q4),
analysed AS (SELECT *, CASE WHEN len(c) = 0 THEN terms ELSE c END AS content, {_drop("terms", L.REQUEST + L.VOCABULARY)} AS subject_terms,
    list_sort(list_filter(list_distinct(flatten(list_transform(terms, lambda t: coalesce(map_extract_value(alike, t), [])))), lambda a: NOT list_contains(terms, a))) AS synonyms,
    mode = 'summary' AND {_any(L.BRIEF)} AS brief, len({_drop("tokens", L.WHOLE_DOCUMENT)}) = 0 AS names_only_document,
    len(regexp_split_to_array({_TRIM % "question"}, '\s+')) >= 8 AS reads_as_prose FROM q5)"""

#: the same with questions that ask for values
VALUE_QUESTIONS = QUESTIONS.replace(
    " FROM conversations WHERE role = 'user')",
    " FROM conversations WHERE role = 'user'"
    + "".join(f" UNION ALL SELECT -(doc_id * 10 + {k}), replace(replace({_text(text)}, '{{word}}', regexp_extract(title, '([A-Za-z]{{4,}})', 1)), '{{id}}', doc_id::VARCHAR) FROM docs WHERE doc_id % {every} = 0" for every, k, text in _ASKING)
    + ")",
    1,
)

#: the tiers of a search, and its best hits
TIERS = rf""", asked AS (SELECT qid, array_to_string({_TOKENS % "query"}, ' ') AS key FROM searches WHERE length({_TRIM % "query"}) >= 2 AND len({_TOKENS % "query"}) > 0),
keys AS (SELECT key, list_filter(t, lambda x, i: list_position(t, x) = i) AS terms, replace(key, ' ', '[^A-Za-z0-9]+') AS pattern FROM (SELECT DISTINCT key, string_split(key, ' ') AS t FROM asked)),
own AS (SELECT doc_id, text, lower(text) AS low, body, title_tokens, list_distinct(flatten(list_transform(tags, lambda g: {_TOKENS % "g"}))) AS tag_terms FROM docs JOIN toks USING (doc_id)),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(body) AS term FROM toks) GROUP BY 1, 2),
s AS (SELECT count(*) AS n, avg(len(body)) FILTER (WHERE len(body) > 0) AS avgdl FROM toks),
bm AS (SELECT key, p.doc_id, sum(ln(1 + (n - 0.5) / 1.5) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(body) / avgdl))) AS bm25
    FROM (SELECT key, unnest(terms) AS term FROM keys) JOIN p USING (term) JOIN toks ON toks.doc_id = p.doc_id, s GROUP BY 1, 2),
met AS (SELECT keys.key, own.doc_id, len(terms) AS n, len(list_filter(terms, lambda x: list_contains(title_tokens, x))) AS m, array_to_string(title_tokens, ' ') = keys.key AS exact, len(title_tokens) AS nt,
    len(body) AS bl, CASE WHEN contains(keys.key, ' ') AND len(list_filter(terms, lambda x: NOT contains(low, x))) = 0 THEN len(regexp_extract_all(text, pattern, 0, 'i')) ELSE 0 END AS occ, list_sort(list_filter(terms, lambda x: list_contains(tag_terms, x))) AS tags, coalesce(bm25, 0) AS bm25
    FROM keys CROSS JOIN own LEFT JOIN bm ON bm.key = keys.key AND bm.doc_id = own.doc_id),
tiered AS (SELECT key, doc_id, CASE WHEN exact THEN 'exact_title' WHEN m = n THEN 'partial_title' WHEN occ > 0 THEN 'phrase' WHEN bm25 > 0 THEN 'content' WHEN len(tags) > 0 THEN 'tag' WHEN m > 0 THEN 'partial_title' END AS kind,
    round(CASE WHEN exact THEN 1 / (1 + nt) WHEN m = n THEN m / greatest(nt, 1) WHEN occ > 0 THEN occ / greatest(bl, 1) WHEN bm25 > 0 THEN bm25 WHEN len(tags) > 0 THEN len(tags) / n ELSE m / n * 0.5::DOUBLE END::DOUBLE, 6) AS score,
    CASE WHEN NOT exact AND m < n AND occ = 0 AND bm25 = 0 THEN tags ELSE [] END AS matched FROM met)"""
RANKED = """, best AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY list_position(['exact_title', 'partial_title', 'phrase', 'content', 'tag'], kind), score DESC, doc_id) AS rk FROM tiered WHERE kind IS NOT NULL %s),
hits AS (SELECT qid, rk, doc_id, kind, score, matched FROM asked JOIN best USING (key) WHERE rk <= 50)"""

#: the best documents of each question: the first hits of the whole search for its terms
PRIORS = (
    re.sub(r"(?<![\\\w.'])\b(asked|keys|own|p|s|bm|met|tiered)\b", r"c_\1", TIERS.replace("FROM searches", "FROM (SELECT qid, array_to_string(terms, ' ') AS query FROM analysed)"))
    + """, c_hits AS (SELECT qid, doc_id, score FROM c_asked JOIN (SELECT *, row_number() OVER (PARTITION BY key ORDER BY list_position(['exact_title', 'partial_title', 'phrase', 'content', 'tag'], kind), score DESC, doc_id) AS rk
    FROM c_tiered WHERE kind IS NOT NULL) USING (key) WHERE rk <= 6),
cand AS (SELECT qid, doc_id, CASE WHEN max(score) OVER (PARTITION BY qid) <= 0 THEN 1.0 ELSE round(0.5 + 0.5 * score / max(score) OVER (PARTITION BY qid), 6) END AS prior FROM c_hits)"""
)


def _pattern(kind: str) -> str:
    """The shape without look-ahead; digits in an identifier are asked for afterwards."""
    return L.SHAPES[kind].replace("(?=[A-Za-z0-9-]*[0-9])", "")


def _good(kind: str, value: str) -> str:
    if kind == "identifier":
        return f"regexp_matches({value}, '[0-9]')"
    if kind == "name":
        words = rf"regexp_split_to_array(lower({value}), '\s+')"
        return f"NOT {_any(L.FURNITURE, words)} AND NOT list_contains({_list(L.ORGANISATIONS)}, {words}[-1])"
    return "true"


def _has(intent: str) -> str:
    return "(" + " OR ".join(f"len(list_filter(regexp_extract_all(text, {_text(_pattern(k))}), lambda v: {_good(k, 'v')})) > 0" for k in L.ANSWERS[intent]) + ")"


_shaped = " ".join(f"WHEN '{i}' THEN {_has(i)}" for i in L.SHAPED)
RANK = f""", w AS (SELECT *, {_TOKENS % "text"} AS words FROM spans WHERE doc_id IN (SELECT doc_id FROM cand)),
r1 AS (SELECT qid, doc_id, page_index, start, text, prior, phrases, intent, content, words, alike, list_concat(content, synonyms) AS near, len(words) AS nw, len(content) AS k
    FROM cand JOIN analysed USING (qid) JOIN w USING (doc_id) WHERE len(words) > 0 AND len(list_filter(phrases, lambda f: NOT contains(lower(text), f))) = 0),
r2 AS (SELECT *, len(list_filter(content, lambda t: list_contains(words, t))) + 0.6::DOUBLE * len(list_filter(content, lambda t: NOT list_contains(words, t)
        AND coalesce(list_has_any(map_extract_value(alike, t), words), false))) AS credit, list_filter(range(0, nw), lambda i: list_contains(near, words[i + 1])) AS spots FROM r1),
r3 AS (SELECT *, CASE WHEN k = 0 THEN CASE WHEN len(phrases) > 0 THEN 1.0 ELSE 0.0 END ELSE least(1.0, credit / k) END::DOUBLE AS cov FROM r2),
r4 AS (SELECT *, coalesce(list_max(spots) - list_min(spots), 0) AS spread, CASE intent {_shaped} ELSE false END AS shaped FROM r3 WHERE len(phrases) > 0 OR (cov > 0 AND (k <= 1 OR cov >= 0.5))),
ranked AS (SELECT qid, doc_id, page_index, start, text, round(cov, 6) AS coverage, shaped,
    round(cov * (1 + ln(1 + len(spots))) / (1 + spread / nw) / (1 + abs(nw - 25) / 25) * CASE WHEN shaped THEN 1.35 ELSE 1.0 END::DOUBLE * prior::DOUBLE, 6) AS score FROM r4)"""

SELECTED = """, s1 AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id, page_index ORDER BY score DESC, start) AS r FROM ranked),
s2 AS (SELECT * EXCLUDE (r), row_number() OVER (PARTITION BY qid, doc_id ORDER BY score DESC, page_index, start) AS r FROM s1 WHERE r = 1),
s3 AS (SELECT * EXCLUDE (r), row_number() OVER o AS rk, sum(length(text)) OVER (o ROWS UNBOUNDED PRECEDING) AS used FROM s2 WHERE r <= 2 WINDOW o AS (PARTITION BY qid ORDER BY score DESC, doc_id, page_index, start)),
selected AS (SELECT * FROM s3 WHERE rk <= 4 AND (used <= 1200 OR rk = 1))"""

#: facts with their offsets: odd parts between the marks are the matches
_each = "\n    UNION ALL ".join(
    f"SELECT doc_id, page_index, '{i}' AS intent, '{k}' AS kind, string_split_regex(regexp_replace({'flat' if k == 'name' else 'text'}, {_text('(' + _pattern(k) + ')')}, chr(1) || '\\1' || chr(2), 'g'), '[\\x01\\x02]') AS parts FROM fp"
    for i, kinds in L.ANSWERS.items() for k in kinds
)
_kept = " ".join(f"WHEN '{k}' THEN {_good(k, 'value')}" for k in ("identifier", "name"))
FACTS = rf""", fp AS (SELECT doc_id, page_index, translate(text, chr(1) || chr(2), '  ') AS text, array_to_string(list_transform(string_split(translate(text, chr(1) || chr(2), '  '), chr(10)), lambda x: CASE WHEN regexp_matches(x, '^#{{1,3}}\s+') THEN repeat(' ', length(x)) ELSE x END), chr(10)) AS flat FROM pgs),
every AS ({_each}),
placed AS (SELECT doc_id, page_index, intent, kind, list_sum(list_transform(parts[1:i - 1], lambda x: length(x)))::BIGINT AS start, parts[i] AS value
    FROM (SELECT *, unnest(range(2, len(parts) + 1, 2)) AS i FROM every)),
located AS (SELECT * FROM placed WHERE CASE kind {_kept} ELSE true END)"""
FACT_KEYS = rf""", tidied AS (SELECT *, regexp_replace(regexp_replace(value, '\s+', ' ', 'g'), '^[\s.,;:*_]+|[\s.,;:*_]+$', '', 'g') AS v FROM located),
keyed AS (SELECT *, regexp_replace(regexp_replace(lower(v), '\s+', ' ', 'g'), '^[^A-Za-z0-9_€£$¥₹+]+|[^A-Za-z0-9_]+$', '', 'g') AS key FROM tidied),
firsts AS (SELECT doc_id, intent, page_index, start, v AS value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, intent, key ORDER BY page_index, start, v) AS r FROM keyed WHERE key <> '') WHERE r = 1),
ranked_facts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, intent ORDER BY page_index, start, value) AS rk FROM firsts)"""

#: the weight of a document's words, and of its passages
WEIGHTS = f""", kept AS (SELECT doc_id, page_index, start, {_drop("ws", L.STOPWORDS)} AS ws FROM (SELECT *, {_TOKENS % "text"} AS ws FROM spans)),
wc AS (SELECT doc_id, page_index, start, term, count(*) AS n FROM (SELECT doc_id, page_index, start, unnest(ws) AS term FROM kept) WHERE NOT regexp_matches(term, '^[0-9]+$') GROUP BY 1, 2, 3, 4),
wt AS (SELECT doc_id, term, sum(n) AS tf, count(*) AS sf FROM wc GROUP BY 1, 2),
weights AS (SELECT doc_id, term, tf, sf, tf / max(tf) OVER (PARTITION BY doc_id) * ln((m + 1) / sf) AS weight FROM wt JOIN (SELECT doc_id, count(*) AS m FROM spans GROUP BY 1) USING (doc_id))"""
_fact = " OR ".join(_has(i) for i in ("date", "amount", "identifier", "contact"))
SCORES = f""", mean AS (SELECT doc_id, page_index, start, avg(weight) AS mean FROM wc JOIN weights USING (doc_id, term) GROUP BY 1, 2, 3),
nth AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_index, start) AS nth, len({_TOKENS % "text"}) AS nw FROM spans),
scored AS (SELECT doc_id, page_index, start, round(mean / (1 + abs(nw - 22) / 22) * CASE WHEN page_index = 0 AND nth <= 3 THEN 1.2 ELSE 1.0 END::DOUBLE
    * CASE WHEN {_fact} THEN 1.25 ELSE 1.0 END::DOUBLE, 6) AS score FROM nth JOIN mean USING (doc_id, page_index, start) WHERE mean > 0)"""

#: kinds of lines with the patterns that show them, in the order in which they are tried, and what starts a line
_IMAGE_LINE = r"^\s*!\[([^\]]*)\]\(([^)\s]+)\)\s*$"
_LINE_KINDS = {"image": _IMAGE_LINE, "heading1": r"^#\s+", "heading2": r"^##\s+", "heading3": r"^###\s+", "numbered": r"^\s*\d{1,3}[.)]\s+", "bullet": r"^\s*[-*•]\s+", "quote": r"^\s*>"}
_LEAD = r"^(?:#{1,3}\s+|\s*\d{1,3}[.)]\s+|\s*[-*•]\s+|\s*>\s?)"


def line_kind(line: str = "line") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({line}, '{p}') THEN '{k}'" for k, p in _LINE_KINDS.items()) + " ELSE 'paragraph' END"


def markup_parts(name: str, lines: str) -> str:
    """SQL of parts in the lines (key, ln, line): {name}(key, ln, k, part, marker, bold, italic, block, start); a line break is
    a part of its own. A state of two flags goes over the marks of each line."""
    last = lambda mark: f"CASE WHEN list_contains(p, '{mark}') THEN len(p) - list_position(list_reverse(p), '{mark}') + 1 ELSE 0 END"
    pair, one = "(p[k] = '**' AND (a.b OR k < l2))", "((p[k] = '*' AND (a.i OR k < greatest(l1, l2))) OR (p[k] = '_' AND (a.i OR k < lu)))"
    return rf""", {name}_l AS (SELECT key, ln, line, {line_kind()} AS block, CASE WHEN regexp_matches(line, '{_IMAGE_LINE}') THEN line ELSE regexp_extract(line, '{_LEAD}', 0) END AS lead FROM {lines}),
{name}_p AS (SELECT *, regexp_extract_all(line[length(lead) + 1:], '\*\*|[*_]|[^*_]+') AS p FROM {name}_l),
{name}_c AS (SELECT *, list_reduce(range(1, len(p) + 1), lambda a, k: {{'b': a.b <> {pair}, 'i': a.i <> {one}, 'c': a.c || (CASE WHEN {pair} OR {one} THEN 4 ELSE 0 END + CASE WHEN a.b THEN 2 ELSE 0 END + CASE WHEN a.i THEN 1 ELSE 0 END)::VARCHAR}}, {{'b': false, 'i': false, 'c': ''}}).c AS c
    FROM (SELECT *, {last("**")} AS l2, {last("*")} AS l1, {last("_")} AS lu FROM {name}_p)),
{name}_u AS (SELECT key, ln, -1 AS k, chr(10) AS part, 0 AS code, 'paragraph' AS block FROM {name}_l WHERE ln > 0 UNION ALL SELECT key, ln, 0, lead, 4, block FROM {name}_l WHERE lead <> ''
    UNION ALL SELECT key, ln, k, p[k], c[k]::INT, block FROM (SELECT *, unnest(range(1, len(p) + 1)) AS k FROM {name}_c)),
{name} AS (SELECT key, ln, k, part, code & 4 > 0 AS marker, code & 2 > 0 AS bold, code & 1 > 0 AS italic, block,
    sum(length(part)) OVER (PARTITION BY key ORDER BY ln, k ROWS UNBOUNDED PRECEDING) - length(part) AS start FROM {name}_u)"""


def flat_texts(name: str, texts: str) -> str:
    """SQL of {name}(key, ln, k, part, marker, ...) of the parts of ``texts`` (key, text), and {name}_flat(key, text) without markers."""
    lines = f"(SELECT key, generate_subscripts(a, 1) - 1 AS ln, unnest(a) AS line FROM (SELECT key, string_split(text, chr(10)) AS a FROM {texts}))"
    return f"{markup_parts(name, lines)}, {name}_flat AS (SELECT key, coalesce(string_agg(part, '' ORDER BY ln, k) FILTER (WHERE NOT marker), '') AS text FROM {name} GROUP BY 1)"


#: the notes' lines, with a page's number within its document in the key
NOTE_LINES = "(SELECT {'d': doc_id, 'p': page_index} AS key, ln - 10 * page_index AS ln, line FROM note_lines)"
