"""The engine's queries over the derived views, and the same results as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import lexicon as L
from pagewright.functions import text as T
from pagewright.operators import answers as A
from pagewright.operators import archives, facts, library, markup, passages, questions, search, store, summaries, transcripts
from pagewright.plans import views as V
from pagewright.plans.registry import ORACLES, QUERIES, query
from pagewright.sources import shared
from pagewright.sources.shared import folder
from pagewright.streaming import live

def _whole_index(df):
    return df.withColumn("page_index", F.col("page_index").cast("long"))


# -- tokens and statistics


@query("SELECT doc_id, len(body)::BIGINT AS n_tokens, len(list_distinct(body))::BIGINT AS n_distinct FROM toks")
def tokens(spark, d):
    t = V.documents(spark, d).select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query("""SELECT doc_id, term, sum(w)::BIGINT AS weight FROM (SELECT doc_id, unnest(body) AS term, 1 AS w FROM toks
    UNION ALL SELECT doc_id, unnest(title_tokens), 3 FROM toks) GROUP BY 1, 2""")
def term_counts(spark, d):
    docs = V.documents(spark, d)
    part = lambda c, w: docs.select("doc_id", F.explode(T.tokens(F.col(c))).alias("term"), F.lit(w).alias("w"))
    return part("text", 1).unionByName(part("title", search.TITLE_WEIGHT)).groupBy("doc_id", "term").agg(F.sum("w").alias("weight"))


@query("SELECT count(*) AS n_docs, round(avg(len(body)) FILTER (WHERE len(body) > 0), 6) AS avgdl FROM toks")
def corpus_stats(spark, d):
    return search.corpus_stats(V.documents(spark, d)).withColumn("avgdl", F.round("avgdl", 6))


@query(""", df AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(body) AS term FROM toks) GROUP BY 1)
SELECT term, df, round(ln(1 + ((SELECT count(*) FROM toks) - df + 0.5) / (df + 0.5)), 6) AS idf FROM df""")
def bm25_idf(spark, d):
    docs = V.documents(spark, d)
    df = docs.select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.round(search.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query("""SELECT doc_id, len(list_distinct(title_tokens))::BIGINT AS n_title_terms, len(list_distinct(body))::BIGINT AS n_body_terms,
    len(body)::BIGINT AS body_length, array_to_string(list_sort(list_distinct(title_tokens)), ' ') AS title_terms FROM toks""")
def index_entries(spark, d):
    t = V.documents(spark, d).select("doc_id", T.tokens(F.col("title")).alias("t"), T.tokens(F.col("text")).alias("b"))
    size = lambda c: F.size(c).cast("long")
    return t.select("doc_id", size(F.array_distinct("t")).alias("n_title_terms"), size(F.array_distinct("b")).alias("n_body_terms"), size(F.col("b")).alias("body_length"), F.array_join(F.array_sort(F.array_distinct("t")), " ").alias("title_terms"))


_BM25 = """, p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(body) AS term FROM toks) GROUP BY 1, 2),
df AS (SELECT term, %s AS df FROM p GROUP BY term),
s AS (SELECT count(*) AS n, avg(len(body)) FILTER (WHERE len(body) > 0) AS avgdl FROM toks),
x AS (SELECT qid, p.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(body) / avgdl))), 6) AS score
    FROM search_terms JOIN p USING (term) JOIN df USING (term) JOIN toks ON toks.doc_id = p.doc_id, s GROUP BY 1, 2)
SELECT * FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rk FROM x) WHERE rk <= 50"""


@query(_BM25 % "count(*)")
def bm25_topk(spark, d):
    return search.bm25(V.documents(spark, d), V.search_queries(spark, d))


@query(_BM25 % "1")
def bm25_parity(spark, d):
    return search.bm25(V.documents(spark, d), V.search_queries(spark, d), idf_mode="constant")


@query(""", q AS (SELECT qid, term, count(*) OVER (PARTITION BY qid) AS n FROM search_terms),
w AS (SELECT item_id AS qid, array_to_string(list_distinct_first, ' ') AS whole FROM (SELECT item_id, list_filter(t, lambda x, i: list_position(t, x) = i) AS list_distinct_first
    FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 2) AS t FROM benchmark))),
t AS (SELECT doc_id, unnest(list_distinct(title_tokens)) AS term, len(title_tokens) AS n_title, array_to_string(title_tokens, ' ') AS title FROM toks),
h AS (SELECT qid, doc_id, count(*) AS m, any_value(n) AS n, any_value(n_title) AS n_title, bool_or(whole = title) AS exact FROM q JOIN t USING (term) JOIN w USING (qid) GROUP BY 1, 2),
g AS (SELECT DISTINCT doc_id, lower(unnest(tags)) AS term FROM docs),
a AS (SELECT qid, doc_id, CASE WHEN exact THEN 0 WHEN m = n THEN 1 ELSE 5 END AS c, CASE WHEN exact THEN 'exact_title' ELSE 'partial_title' END AS kind,
    CASE WHEN exact THEN 1.0 / (1 + n_title) WHEN m = n THEN m / n_title ELSE m / n_title * 0.5 END AS score FROM h
    UNION ALL SELECT qid, doc_id, 4, 'tag', count(*) / any_value(n) FROM q JOIN g USING (term) GROUP BY 1, 2)
SELECT qid, doc_id, arg_min(kind, c) AS kind, round(arg_min(score::DOUBLE, c), 6) AS score FROM a GROUP BY 1, 2""")
def title_tag_tiers(spark, d):
    return search.title_and_tag_hits(V.documents(spark, d), V.search_queries(spark, d))


@query("SELECT DISTINCT unnest(tags) AS tag FROM docs")
def library_tags(spark, d):
    return V.documents(spark, d).select(F.explode("tags").alias("tag")).distinct()


@query("SELECT count(*) AS n, sum(('0x' || substr(md5(doc_id || ':' || epoch_us(updated_at)), 1, 8))::BIGINT)::BIGINT AS fingerprint FROM docs")
def fingerprint(spark, d):
    """Order-free, so that it is added up where the rows are."""
    key = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.unix_micros("updated_at").cast("string")))
    return V.documents(spark, d).agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(key, 1, 8), 16, 10).cast("long")).alias("fingerprint"))


# -- library


@query("SELECT doc_id, title, updated_at, doc_source FROM docs ORDER BY updated_at DESC, doc_id DESC")
def library_recent(spark, d):
    return V.documents(spark, d).orderBy(F.desc("updated_at"), F.desc("doc_id")).select("doc_id", "title", "updated_at", "doc_source")


@query("SELECT item_id AS wanted, doc_id IS NOT NULL AS found, title FROM benchmark LEFT JOIN docs ON doc_id = item_id * 37")
def doc_lookup(spark, d):
    wanted = V.table(spark, d, "benchmark").select(F.col("item_id").alias("wanted"), (F.col("item_id") * 37).alias("doc_id"))
    docs = V.documents(spark, d).select("doc_id", "title", F.lit(True).alias("hit"))
    return wanted.join(docs, "doc_id", "left").select("wanted", F.coalesce("hit", F.lit(False)).alias("found"), "title")


@query("""SELECT count(*) AS n_all, count(*) FILTER (WHERE is_favorite) AS favorites, count(*) FILTER (WHERE doc_source IN ('scanned', 'imported')) AS scanned,
    count(*) FILTER (WHERE doc_source = 'created') AS written FROM docs""")
def library_filters(spark, d):
    source = F.col("doc_source")
    return V.documents(spark, d).agg(F.count("*").alias("n_all"), F.count_if("is_favorite").alias("favorites"), F.count_if(source.isin("scanned", "imported")).alias("scanned"), F.count_if(source == "created").alias("written"))


@query("SELECT arg_max(doc_id, updated_at) AS doc_id FROM docs WHERE regexp_matches(text, '\\S')")
def latest_readable(spark, d):
    return V.documents(spark, d).where(F.col("text").rlike(r"\S")).agg(F.max_by("doc_id", "updated_at").alias("doc_id"))


@query("SELECT doc_id, page_index FROM pgs WHERE kind = 'image' AND ocr_status IN ('pending', 'failed')")
def ocr_worklist(spark, d):
    return V.pages(spark, d).where("kind = 'image' and ocr_status in ('pending', 'failed')").select("doc_id", F.col("page_index").cast("long").alias("page_index"))


@query("""SELECT doc_id, CASE WHEN doc_source = 'archive' THEN 'completed' WHEN NOT bool_or(kind = 'image') THEN 'completed' WHEN bool_or(ocr_status = 'pending') THEN 'pending'
    WHEN bool_or(ocr_status = 'failed') THEN 'failed' ELSE 'completed' END AS status FROM docs JOIN pgs USING (doc_id) GROUP BY doc_id, doc_source""")
def doc_status(spark, d):
    return library.document_status(V.pages(spark, d), V.documents(spark, d))


@query("""SELECT doc_id, count(*) AS n_pages, sum(length(text))::BIGINT + 2 * (count(*) - 1) AS n_chars FROM pgs WHERE regexp_matches(text, '\\S') GROUP BY doc_id""")
def extracted_text(spark, d):
    p = V.pages(spark, d).withColumn("text", T.without_images(F.col("text"))).where(F.col("text").rlike(r"\S"))
    return p.groupBy("doc_id").agg(F.count("*").alias("n_pages"), (F.sum(F.length("text")) + 2 * (F.count("*") - 1)).alias("n_chars"))


@query("""SELECT doc_id, CASE WHEN bool_or(regexp_matches(line, '^\\s*!\\[([^\\]]*)\\]\\(([^)\\s]+)\\)\\s*$')) THEN 'has_picture' WHEN NOT bool_or(regexp_matches(line, '\\S')) THEN 'no_text' ELSE 'ok' END AS verdict
    FROM doc_lines GROUP BY doc_id""")
def export_eligibility(spark, d):
    lines = F.split("text", "\n", -1)
    picture, text = F.exists(lines, lambda x: x.rlike(T.IMAGE_LINE)), F.col("text").rlike(r"\S")
    return V.documents(spark, d).select("doc_id", F.when(picture, "has_picture").when(~text, "no_text").otherwise("ok").alias("verdict"))


@query(""", e AS (SELECT doc_id, page_index, text, 0 AS late, page_index AS seq FROM pgs UNION ALL SELECT doc_id, NULL, 'appended ' || doc_id, 1, doc_id FROM docs WHERE doc_id % 5 = 0)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY late, seq) - 1 AS page_index, md5(text) AS text_md5 FROM e""")
def page_append(spark, d):
    new = V.documents(spark, d).where("doc_id % 5 = 0").select("doc_id", F.concat(F.lit("appended "), F.col("doc_id")).alias("text"), F.col("doc_id").alias("seq"))
    return library.append_pages(V.pages(spark, d), new).select("doc_id", F.col("page_index").cast("long").alias("page_index"), F.md5("text").alias("text_md5"))


@query(""", e AS (SELECT *, page_index = doc_id % 3 AS gone, sum(CASE WHEN page_index = doc_id % 3 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id) AS remaining FROM pgs)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_index) - 1 AS page_index, md5(text) AS text_md5 FROM e WHERE NOT gone OR remaining = 0""")
def page_delete(spark, d):
    gone = V.documents(spark, d).select("doc_id", (F.col("doc_id") % 3).cast("int").alias("page_index"))
    return library.delete_pages(V.pages(spark, d), gone).select("doc_id", F.col("page_index").cast("long").alias("page_index"), F.md5("text").alias("text_md5"))


@query(""", n AS (SELECT doc_id, max(page_index) AS top FROM pgs GROUP BY 1)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN top - page_index ELSE page_index END AS page_index, md5(text) AS text_md5 FROM pgs JOIN n USING (doc_id)""")
def page_reorder(spark, d):
    """A third of the documents is turned round; another third asks for an order that is no permutation."""
    p = V.pages(spark, d)
    order = p.groupBy("doc_id").agg(F.max("page_index").alias("top")).select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.reverse(F.sequence(F.lit(0), "top"))).otherwise(F.array(F.lit(-1))).alias("page_order"))
    return library.reorder_pages(p, order.where("doc_id % 3 < 2")).select("doc_id", F.col("page_index").cast("long").alias("page_index"), F.md5("text").alias("text_md5"))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk FROM events) WHERE rk = 1")
def upsert_latest(spark, d):
    return library.latest(V.table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("SELECT doc_id, title FROM docs WHERE doc_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND user_id IS NOT NULL)")
def delete_docs(spark, d):
    gone = V.table(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("doc_id"))
    return V.documents(spark, d).join(gone, "doc_id", "left_anti").select("doc_id", "title")


@query(""", i AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN updated_at - INTERVAL 1 HOUR ELSE updated_at END AS at FROM docs WHERE doc_id % 9 <> 0 UNION ALL SELECT -doc_id - 1, updated_at FROM docs WHERE doc_id % 50 = 0)
SELECT coalesce(docs.doc_id, i.doc_id) AS doc_id, CASE WHEN i.doc_id IS NULL THEN 'added' WHEN docs.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS drift
FROM docs FULL JOIN i ON docs.doc_id = i.doc_id WHERE i.doc_id IS NULL OR docs.doc_id IS NULL OR docs.updated_at <> i.at""")
def index_drift(spark, d):
    """The library against an index that is older in parts."""
    docs = V.documents(spark, d).select("doc_id", "updated_at")
    old = docs.where("doc_id % 9 <> 0").select(F.col("doc_id").alias("i"), F.expr("if(doc_id % 10 = 0, updated_at - interval 1 hour, updated_at)").alias("at"))
    old = old.unionByName(docs.where("doc_id % 50 = 0").select((-F.col("doc_id") - 1).alias("i"), F.col("updated_at").alias("at")))
    both = docs.join(old, docs.doc_id == old.i, "full_outer").where("i is null or doc_id is null or updated_at <> at")
    return both.select(F.coalesce("doc_id", "i").alias("doc_id"), F.expr("case when i is null then 'added' when doc_id is null then 'removed' else 'changed' end").alias("drift"))


# -- text


@query("""SELECT doc_id, page_index, count(*) AS n_lines, count(*) FILTER (WHERE regexp_matches(line, '^\\s*[-*•]\\s+')) AS bullets, count(*) FILTER (WHERE regexp_matches(line, '^#{1,3}\\s+')) AS headings
    FROM (SELECT doc_id, page_index, unnest(string_split(text, chr(10))) AS line FROM pgs) GROUP BY 1, 2""")
def markup_blocks(spark, d):
    b = markup.blocks(V.pages(spark, d))
    return b.groupBy("doc_id", F.col("page_index").cast("long").alias("page_index")).agg(F.count("*").alias("n_lines"), F.count_if(F.col("kind") == "bullet").alias("bullets"), F.count_if(F.col("kind").startswith("heading")).alias("headings"))


@query(""", s AS (SELECT doc_id, page_index, unnest(string_split(regexp_replace(text, '([.!?;])\\s+|\\n+', '\\1' || chr(1), 'g'), chr(1))) AS t FROM pgs)
SELECT doc_id, page_index, count(*) AS n_passages, sum(length(t))::BIGINT AS n_chars FROM (SELECT doc_id, page_index, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS t FROM s) WHERE length(t) >= 12 GROUP BY 1, 2""")
def passage_spans(spark, d):
    p = passages.passages(V.pages(spark, d), longest=None)
    return p.groupBy("doc_id", F.col("page_index").cast("long").alias("page_index")).agg(F.count("*").alias("n_passages"), F.sum(F.col("stop") - F.col("start")).alias("n_chars"))


@query(f"""{V.SPANS}
SELECT doc_id, page_index, start, start + length(text) AS stop, text FROM spans""")
def passages_cut(spark, d):
    return _whole_index(passages.passages(V.pages(spark, d)))


@query(""", f AS (SELECT doc_id, page_index, unnest(regexp_extract_all(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\\.[A-Za-z0-9_.-]*[A-Za-z0-9_]')) AS value FROM pgs)
SELECT doc_id, page_index, regexp_replace(value, '^[^A-Za-z0-9_]+', '') AS value, count(*) AS n FROM f GROUP BY 1, 2, 3""")
def fact_emails(spark, d):
    f = facts.facts(V.pages(spark, d), ("email",))
    return f.groupBy("doc_id", F.col("page_index").cast("long").alias("page_index"), "value").agg(F.count("*").alias("n"))


@query(f"""{V.FACTS}
SELECT doc_id, page_index, intent, kind, start, value FROM located""")
def fact_shapes(spark, d):
    """Every fact of the nine shapes with its offset."""
    return _whole_index(facts.located(V.pages(spark, d)))


@query(f"""{V.FACTS}{V.FACT_KEYS}
SELECT doc_id, intent, rk, page_index, start, value FROM ranked_facts WHERE rk <= 15""")
def facts_top(spark, d):
    return _whole_index(facts.top(V.pages(spark, d)))


@query(f"""{V.FACTS}{V.FACT_KEYS}
SELECT doc_id, intent, count(*) AS n, string_agg(value, ' | ' ORDER BY rk) AS "values" FROM ranked_facts WHERE rk <= 6 GROUP BY 1, 2""")
def fact_digest(spark, d):
    return facts.digest(V.pages(spark, d))


@query(f"""{V.FACTS}
SELECT doc_id, page_index, {", ".join(f"bool_or(intent = '{i}') AS has_{i}" for i in L.ANSWERS)} FROM located GROUP BY 1, 2""")
def passage_signals(spark, d):
    """Which kinds of facts a page holds, of the pages that hold any."""
    p = V.pages(spark, d).select("doc_id", "page_index", *(facts.has(i, F.col("text")).alias(f"has_{i}") for i in L.ANSWERS))
    return _whole_index(p.where(" or ".join(f"has_{i}" for i in L.ANSWERS)))


@query("SELECT doc_id, lower(tags[1]) || ',' || lower(tags[2]) AS tags FROM docs")
def normalise_tags(spark, d):
    raw = F.array(F.concat(F.lit(" "), F.upper(F.col("tags")[0])), F.col("tags")[1], F.lower(F.col("tags")[1]))
    return V.documents(spark, d).select("doc_id", F.array_join(T.normal_tags(raw), ",").alias("tags"))


@query("""SELECT doc_id, CASE WHEN n = '' THEN 'document' ELSE n END AS name FROM (SELECT doc_id, substr(regexp_replace(regexp_replace(regexp_replace(title, '[\\\\/:*?"<>|\\x00-\\x1f\\x7f]', '_', 'g'), '^\\s+|\\s+$', '', 'g'), '[. ]+$', ''), 1, 120) AS n FROM docs)""")
def sanitise_names(spark, d):
    return V.documents(spark, d).select("doc_id", T.safe_name(F.col("title")).alias("name"))


# -- archives


@query("""SELECT entry_no, CASE WHEN path LIKE '/%' OR list_contains(p, '..') OR len(k) = 0 THEN NULL ELSE array_to_string(k, '/') END AS path
FROM (SELECT entry_no, path, string_split(path, '/') AS p, list_filter(string_split(path, '/'), lambda x: x <> '' AND x <> '.') AS k FROM entries)""")
def safe_paths(spark, d):
    return V.archive_entries(spark, d).select("entry_no", T.safe_path(F.col("path")).alias("path"))


@query("""SELECT CASE e WHEN 'pdf' THEN 'pdf' WHEN 'txt' THEN 'text' WHEN 'md' THEN 'text' WHEN 'docx' THEN 'text' ELSE 'other' END AS kind, count(*) AS n
FROM (SELECT lower(regexp_extract(path, '[^/]\\.([^./]*)$', 1)) AS e FROM entries) GROUP BY 1""")
def entry_kinds(spark, d):
    return V.archive_entries(spark, d).groupBy(T.entry_kind(F.col("path")).alias("kind")).agg(F.count("*").alias("n"))


@query(""", x AS (SELECT *, CASE WHEN size > 134217728 THEN false WHEN compressed <= 0 THEN size = 0 ELSE size // compressed <= 300 END AS safe FROM entries)
SELECT archive, count(*) AS n_entries, count(*) FILTER (WHERE NOT safe) AS n_refused, coalesce(sum(size) FILTER (WHERE safe), 0)::BIGINT AS bytes,
    count(*) <= 4000 AND coalesce(sum(size) FILTER (WHERE safe), 0) <= 536870912 AS accepted FROM x GROUP BY 1""")
def archive_safety(spark, d):
    return archives.archive_safety(V.archive_entries(spark, d))


@query(""", x AS (SELECT archive, size, list_filter(string_split(path, '/'), lambda y: y <> '') AS p FROM entries),
u AS (SELECT archive, size, p, unnest(range(0, len(p))) AS depth FROM x WHERE len(p) > 0),
c AS (SELECT archive, array_to_string(p[1:depth], '/') AS folder, CASE WHEN depth = len(p) - 1 THEN 'f:' ELSE 'd:' END || p[depth + 1] AS child, size FROM u)
SELECT archive, coalesce(folder, '') AS folder, sum(size)::BIGINT AS bytes, count(*) AS n_files, count(DISTINCT child) AS n_children FROM c GROUP BY 1, 2""")
def folder_rollup(spark, d):
    return archives.folder_rollup(V.archive_entries(spark, d))


@query("SELECT archive, count(*) AS n_files, sum(size)::BIGINT AS bytes, round(1 - sum(compressed) / sum(size), 6) AS saved FROM entries GROUP BY 1")
def archive_totals(spark, d):
    return V.archive_entries(spark, d).groupBy("archive").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"), F.round(1 - F.sum("compressed") / F.sum("size"), 6).alias("saved"))


@query("SELECT archive, entry_no, running FROM (SELECT archive, entry_no, sum(size) OVER (PARTITION BY archive ORDER BY entry_no)::BIGINT AS running FROM entries) WHERE running <= 2147483648")
def bundle_plan(spark, d):
    return archives.running_totals(V.archive_entries(spark, d), archives.BUILD_BYTES).select("archive", "entry_no", "running")


@query(""", b AS (SELECT archive, entry_no, sum(size) OVER (PARTITION BY archive ORDER BY entry_no)::BIGINT AS running,
    count(*) OVER (PARTITION BY archive) AS n, sum(size) OVER (PARTITION BY archive) AS total FROM entries)
SELECT archive, entry_no, running, n <= 500 AND total <= 2147483648 AS taken, CASE WHEN n > 500 THEN 'too many sources' WHEN total > 2147483648 THEN 'too many bytes' END AS reason FROM b""")
def build_plan(spark, d):
    return archives.build_plan(V.archive_entries(spark, d)).select("archive", "entry_no", "running", "taken", "reason")


@query("""SELECT archive, entry_no, CASE WHEN size < 1024 THEN size || ' B' WHEN size >= 1073741824 THEN n3 || ' GB' WHEN size >= 1048576 THEN n2 || ' MB' ELSE n1 || ' KB' END AS readable
FROM (SELECT *, CASE WHEN size / 1024 >= 10 THEN floor(size / 1024 + 0.5)::BIGINT::VARCHAR ELSE printf('%.1f', floor(size / 1024 * 10 + 0.5) / 10) END AS n1,
    CASE WHEN size / 1048576 >= 10 THEN floor(size / 1048576 + 0.5)::BIGINT::VARCHAR ELSE printf('%.1f', floor(size / 1048576 * 10 + 0.5) / 10) END AS n2,
    CASE WHEN size / 1073741824 >= 10 THEN floor(size / 1073741824 + 0.5)::BIGINT::VARCHAR ELSE printf('%.1f', floor(size / 1073741824 * 10 + 0.5) / 10) END AS n3 FROM entries)""")
def size_report(spark, d):
    return V.archive_entries(spark, d).select("archive", "entry_no", T.human_size(F.col("size")).alias("readable"))


# -- transcripts

_FIRST = "regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


_CONVERSATIONS = f""", f AS (SELECT conv_id, arg_min({_FIRST}, turn) FILTER (WHERE role = 'user' AND regexp_matches(text, '\\S')) AS t, count(*) AS n_messages, max(turn) AS last_turn FROM messages GROUP BY 1)
SELECT conv_id, coalesce(CASE WHEN length(t) <= 60 THEN t ELSE rtrim(substr(t, 1, 59)) || '…' END, 'Conversation') AS title, n_messages, last_turn FROM f"""
_NEWEST = "SELECT conv_id, turn, rk FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rk FROM messages) WHERE rk <= %d"


@query(_CONVERSATIONS)
def conversations(spark, d):
    return transcripts.conversations(V.messages(spark, d))


@query(_NEWEST % 200)
def transcript_cap(spark, d):
    return transcripts.newest(V.messages(spark, d)).select("conv_id", "turn", "rk")


@query(""", q AS (SELECT conv_id, lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS key, max(turn) AS turn, arg_max(text, turn) AS question FROM messages WHERE role = 'user' AND regexp_matches(text, '\\S') GROUP BY 1, 2)
SELECT * FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rk, question FROM q) WHERE rk <= 5""")
def recent_questions(spark, d):
    return transcripts.recent_questions(V.messages(spark, d))


@query("""SELECT conv_id, turn, CASE WHEN NOT regexp_matches(text, '\\S') THEN 'empty' WHEN length(text) > 500 THEN 'too_long' ELSE 'ok' END AS verdict FROM messages WHERE role = 'user'""")
def validate_inputs(spark, d):
    text = F.col("text")
    return V.messages(spark, d).where("role = 'user'").select("conv_id", "turn", F.when(~text.rlike(r"\S"), "empty").when(F.length(text) > 500, "too_long").otherwise("ok").alias("verdict"))


# -- questions and answers


@query(f"""{V.QUESTIONS}
SELECT qid, array_to_string(terms, ' ') AS terms, array_to_string(synonyms, ' ') AS synonyms, array_to_string(phrases, '|') AS phrases, intent, mode,
    array_to_string(content, ' ') AS content_terms, array_to_string(subject_terms, ' ') AS subject_terms, brief, names_only_document, reads_as_prose FROM analysed""")
def question_analysis(spark, d):
    q = questions.analysis(V.questions(spark, d))
    joined = lambda c, by=" ": F.array_join(c, by).alias(c)
    return q.select("qid", joined("terms"), joined("synonyms"), joined("phrases", "|"), "intent", "mode", joined("content_terms"), joined("subject_terms"), "brief", "names_only_document", "reads_as_prose")


def _answering(spark, d):
    """The analysed questions, the pages and the candidate documents."""
    q = questions.analysis(V.questions(spark, d))
    return q, V.pages(spark, d), A.priors(V.documents(spark, d), q)


@query(f"{V.QUESTIONS}{V.PRIORS} SELECT qid, doc_id, prior FROM cand")
def doc_priors(spark, d):
    return _answering(spark, d)[2]


@query(f"{V.SPANS}{V.QUESTIONS}{V.PRIORS}{V.RANK} SELECT qid, doc_id, page_index, start, coverage, shaped, score FROM ranked")
def passage_rank(spark, d):
    return _whole_index(A.rank(*_answering(spark, d)).select("qid", "doc_id", "page_index", "start", "coverage", "shaped", "score"))


@query(f"{V.SPANS}{V.QUESTIONS}{V.PRIORS}{V.RANK}{V.SELECTED} SELECT qid, doc_id, page_index, start, rk FROM selected")
def answer_selection(spark, d):
    return _whole_index(A.select(A.rank(*_answering(spark, d))).select("qid", "doc_id", "page_index", "start", "rk"))


_WINDOWS = f"""{V.SPANS}{V.QUESTIONS}{V.PRIORS}{V.RANK}{V.SELECTED}, room AS (SELECT qid, s.doc_id, s.page_index, rk, pgs.text AS page, greatest(0, s.start - greatest(0, floor((240 - length(s.text)) / 2)))::BIGINT AS "begin",
    least(length(pgs.text), s.start + length(s.text) + greatest(0, floor((240 - length(s.text)) / 2)))::BIGINT AS "end" FROM selected s JOIN pgs USING (doc_id, page_index)),
keyed_room AS (SELECT *, {{'q': qid, 'r': rk}} AS key FROM room)"""


@query(rf"""{_WINDOWS}{V.flat_texts("m", '(SELECT key, page["begin" + 1:"end"] AS text FROM keyed_room)')} SELECT qid, doc_id, page_index, rk, CASE WHEN "begin" > 0 THEN '…' ELSE '' END
    || regexp_replace(regexp_replace(x.text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') || CASE WHEN "end" < length(page) THEN '…' ELSE '' END AS snippet FROM keyed_room JOIN m_flat x USING (key)""")
def citations(spark, d):
    q, pages, cand = _answering(spark, d)
    return _whole_index(A.citations(A.select(A.rank(q, pages, cand)), pages).select("qid", "doc_id", "page_index", "rk", "snippet"))


@query(f"""{V.SPANS}{V.QUESTIONS}{V.PRIORS}{V.RANK}{V.SELECTED} SELECT qid, s.doc_id, s.page_index, rk, greatest(0, s.start - greatest(0, floor((240 - length(s.text)) / 2)))::BIGINT AS "begin",
    least(length(pgs.text), s.start + length(s.text) + greatest(0, floor((240 - length(s.text)) / 2)))::BIGINT AS "end" FROM selected s JOIN pgs USING (doc_id, page_index)""")
def citation_windows(spark, d):
    """Where each citation begins and ends on its page."""
    q, pages, cand = _answering(spark, d)
    rows = A.citations(A.select(A.rank(q, pages, cand)), pages).select("qid", "doc_id", "page_index", "rk", "begin", "end")
    return rows.withColumns({c: F.col(c).cast("long") for c in ("page_index", "begin", "end")})


@query(rf"""{V.SPANS}{V.QUESTIONS}{V.PRIORS}{V.RANK}{V.SELECTED},
n AS (SELECT qid, count(*) AS n_citations, count(DISTINCT doc_id) AS n_documents FROM selected GROUP BY 1)
SELECT a.qid, mode, CASE WHEN s.qid IS NOT NULL THEN 'answer' WHEN len(terms) = 0 AND len(phrases) = 0 THEN 'unclear' WHEN c.seen AND NOT c.read THEN 'no_text' ELSE 'no_match' END AS kind,
    CASE WHEN coverage >= 0.999 AND shaped THEN 'strong' WHEN coverage >= 0.999 OR shaped THEN 'partial' WHEN s.qid IS NOT NULL THEN 'weak' END AS confidence,
    s.doc_id AS best_doc, s.text AS answer, coalesce(n_citations, 0) AS n_citations, coalesce(n_documents, 0) AS n_documents
FROM analysed a LEFT JOIN (SELECT * FROM selected WHERE rk = 1) s USING (qid) LEFT JOIN n USING (qid)
LEFT JOIN (SELECT qid, true AS seen, bool_or(regexp_matches(text, '\S')) AS read FROM cand JOIN docs USING (doc_id) GROUP BY 1) c USING (qid)""")
def answers(spark, d):
    q, pages, cand = _answering(spark, d)
    library_size = V.documents(spark, d).agg(F.count("*").alias("n_docs"), F.count_if(F.col("text").rlike(r"\S")).alias("n_readable"))
    return A.compose(q, A.select(A.rank(q, pages, cand)), library_size, A.readable(V.documents(spark, d), cand))


# -- summaries


@query(f"{V.SPANS}{V.WEIGHTS} SELECT doc_id, term, tf::BIGINT AS tf, sf, round(weight, 6) AS weight FROM weights")
def term_significance(spark, d):
    return summaries.significance(passages.passages(V.pages(spark, d))).withColumn("weight", F.round("weight", 6))


@query(f"{V.SPANS}{V.WEIGHTS}{V.SCORES} SELECT doc_id, page_index, start, score FROM scored")
def sentence_scores(spark, d):
    return _whole_index(summaries.scores(passages.passages(V.pages(spark, d))).select("doc_id", "page_index", "start", "score"))


# -- streams: each reads what is there now and ends


def _stream(spark, d, name):
    # as a pattern, the path may be one file or a folder
    return spark.readStream.schema(spark.read.parquet(f"{d}/{name}.parquet").schema).parquet(f"{d}/{name}.parque[t]")


def _said(spark, d, at):
    """The messages as a stream of several batches: a file for each quarter of the turns."""
    said = V.messages(spark, d)
    quarter = F.expr("ntile(4) over (partition by conv_id order by turn)")
    said.select("*", quarter.alias("file")).repartition(4, "file").write.partitionBy("file").parquet(f"{at}/said")
    return spark.readStream.schema(said.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{at}/said")


@query("SELECT term, doc_id, count(*) AS tf, any_value(len(body)) AS body_length FROM (SELECT doc_id, body, unnest(body) AS term FROM toks) GROUP BY 1, 2")
def stream_index(spark, d):
    at = folder(spark, "index")
    live.keep_index(_stream(spark, d, "documents").select(F.col("doc_id").alias("seq"), "doc_id", "text"), f"{at}/rows", f"{at}/state").awaitTermination()
    return live.current_index(spark, f"{at}/rows")


@query(_CONVERSATIONS)
def stream_conversations(spark, d):
    at = folder(spark, "conversations")
    live.live_transcripts(_said(spark, d, at), at, f"{at}/state").awaitTermination()
    return live.conversations_of(live.current_view(spark, at))


@query(_NEWEST % 200)
def stream_transcripts(spark, d):
    at = folder(spark, "transcripts")
    live.live_transcripts(_said(spark, d, at), at, f"{at}/state").awaitTermination()
    return live.transcripts_of(live.current_view(spark, at))


@query(""", e AS (SELECT user_id AS doc_id, event_id AS seq, event_type FROM events WHERE user_id IS NOT NULL), l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) AS r FROM e)
SELECT doc_id, event_type || ' ' || seq AS title FROM l WHERE r = 1 AND event_type <> 'error'""")
def stream_library(spark, d):
    """Events as changes of documents, errors as deletions: the library after all of them."""
    at = folder(spark, "library")
    e = _stream(spark, d, "events").where("user_id is not null")
    changes = e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("doc_id"), F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("title"), (F.col("event_type") == "error").alias("deleted"))
    live.live_library(changes, f"{at}/rows", f"{at}/state").awaitTermination()
    return live.current_library(spark, f"{at}/rows")


@query("""SELECT doc_id, 'body' AS field, term, count(*) AS tf FROM (SELECT doc_id, unnest(body) AS term FROM toks WHERE doc_id % 7 <> 0) GROUP BY 1, 3
UNION ALL SELECT doc_id, 'title', unnest(list_distinct(title_tokens)), 1 FROM toks WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id, 'tag', unnest(list_distinct(flatten(list_transform(tags, lambda g: list_filter(regexp_split_to_array(lower(g), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 2))))), 1 FROM docs WHERE doc_id % 7 <> 0""")
def stream_entries(spark, d):
    """An index that follows edits: every document comes, with another text first, and a seventh is emptied again."""
    at = folder(spark, "entries")
    docs = _stream(spark, d, "documents")
    own = docs.select("doc_id", F.substring(F.split("text", "\n")[0], 1, 120).alias("title"), "text", F.array("lang", "source").alias("tags"))
    steps = F.array(F.struct(F.lit(0).alias("seq"), F.lit("draft").alias("text")), F.struct(F.lit(1).alias("seq"), F.col("text")), F.struct(F.lit(2).alias("seq"), F.lit(None).cast("string").alias("text")))
    each = own.select("doc_id", "title", "tags", F.explode(F.when(F.col("doc_id") % 7 == 0, steps).otherwise(F.slice(steps, 1, 2))).alias("e")).select("doc_id", "e.seq", "e.text", F.when(F.col("e.seq") < 2, F.col("title")).alias("title"), F.when(F.col("e.seq") < 2, F.col("tags")).alias("tags"))
    live.keep_entries(each, f"{at}/index", f"{at}/state").awaitTermination()
    return store.stored(spark, f"{at}/index")


@query(r"""SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN 'A .parquet file can not be imported.' WHEN doc_id % 50 <> 3 AND NOT regexp_matches(text, '\S') THEN 'There was no text in that file.' END AS reason,
CASE WHEN doc_id % 50 <> 7 AND (doc_id % 50 = 3 OR regexp_matches(text, '\S')) THEN md5(CASE WHEN doc_id % 50 = 3 THEN '\uFFFD' ELSE text END || chr(10)) END AS text_md5 FROM documents WHERE text IS NOT NULL""".replace("\\uFFFD", "\ufffd"))
def dropped_files(spark, d):
    """Every document dropped as a file of its own and read in several batches, of which the last runs twice: texts by their
    hash, the others with the reason. Some files are no UTF-8, some of a kind that is not read."""
    at, poison = folder(spark, "dropped"), F.col("doc_id") % 50
    docs = V.table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    named = docs.where(poison != 7).select(F.when(poison == 3, F.unhex(F.lit("FF")).cast("string")).otherwise(F.col("text")).alias("value"), "doc_id")
    named.write.partitionBy("doc_id").text(f"{at}/in/text")
    docs.where(poison == 7).write.partitionBy("doc_id").parquet(f"{at}/in/other")
    batches = max(100, docs.count() // 4)
    run = lambda: live.drop_folder(spark, f"{at}/in", f"{at}/out", f"{at}/state", batches).awaitTermination()
    run()
    shared.delete(spark, f"{at}/state/commits/{max(map(int, shared.names(spark, f'{at}/state/commits')))}")
    run()
    own = F.regexp_extract("path", "doc_id=(-?[0-9]+)/", 1).cast("long").alias("doc_id")
    texts = spark.read.parquet(f"{at}/out/texts").select(own, F.lit(None).cast("string").alias("reason"), F.md5("text").alias("text_md5"))
    return texts.unionByName(spark.read.parquet(f"{at}/out/rejected").select(own, "reason", F.lit(None).cast("string").alias("text_md5")))


# the other families of queries register themselves
from pagewright.plans import asking, editing, finding, manifests, writing  # noqa: E402, F401

__all__ = ["ORACLES", "QUERIES"]
