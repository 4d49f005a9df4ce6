"""Queries of edits: pages, documents, recognition, new documents, transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import library, markup, transcripts
from pagewright.plans import views as V
from pagewright.plans.registry import query

_LAST = "timestamp '2026-01-01 00:00:00'"


def _pages(spark, d):
    """Pages with ``edited``: whether somebody has written on them."""
    return V.pages(spark, d).withColumn("edited", (F.col("doc_id") + F.col("page_index")) % 6 == 0)


def _long(df, *names):
    return df.withColumns({c: F.col(c).cast("long") for c in names})


_PAGES = ", ep AS (SELECT *, (doc_id + page_index) % 6 = 0 AS edited FROM pgs)"


@query("""SELECT doc_id, page_index, CASE WHEN doc_id % 5 = 1 AND page_index = doc_id % 3 THEN 'pending' ELSE ocr_status END AS ocr_status, kind,
    md5(CASE WHEN doc_id % 5 = 1 AND page_index = doc_id % 3 THEN '' ELSE text END) AS text_md5 FROM pgs""")
def page_replace(spark, d):
    """A fifth of the documents gets a new picture for one page."""
    new = V.documents(spark, d).where("doc_id % 5 = 1").select("doc_id", (F.col("doc_id") % 3).cast("int").alias("page_index"))
    return _long(library.replace_pages(V.pages(spark, d), new), "page_index").select("doc_id", "page_index", "ocr_status", "kind", F.md5("text").alias("text_md5"))


@query("""SELECT doc_id, page_index, CASE WHEN doc_id % 4 = 1 AND page_index = doc_id % 2 THEN 'completed' ELSE ocr_status END AS ocr_status,
    md5(CASE WHEN doc_id % 4 = 1 AND page_index = doc_id % 2 THEN 'edited ' || doc_id ELSE text END) AS text_md5,
    CASE WHEN doc_id % 4 = 1 AND page_index = doc_id % 2 THEN TIMESTAMP '2026-01-01' + to_minutes(doc_id) END AS edited_at FROM pgs""")
def page_edit(spark, d):
    """A quarter of the documents has one page written anew, twice, of which the later counts."""
    at = F.expr(f"{_LAST} + make_interval(0, 0, 0, 0, 0, cast(doc_id as int), 0)")
    late = V.documents(spark, d).where("doc_id % 4 = 1").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("page_index"), F.concat(F.lit("edited "), F.col("doc_id")).alias("new_text"), at.alias("ts"))
    early = late.select("doc_id", "page_index", F.lit("too early").alias("new_text"), F.expr("ts - interval 1 hour").alias("ts"))
    return _long(library.edit_texts(V.pages(spark, d), late.unionByName(early)), "page_index").select("doc_id", "page_index", "ocr_status", F.md5("text").alias("text_md5"), "edited_at")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN TIMESTAMP '2026-01-01' + to_minutes(doc_id) ELSE updated_at END AS updated_at,
    CASE WHEN doc_id % 3 = 0 AND doc_id % 4 <> 1 THEN 'doc-' || doc_id || '.pdf' END AS pdf_path FROM docs""")
def apply_page_edits(spark, d):
    """What page edits do to their documents."""
    docs = V.documents(spark, d).select("doc_id", "updated_at", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("doc-"), F.col("doc_id"), F.lit(".pdf"))).alias("pdf_path"))
    edits = docs.where("doc_id % 4 = 1").select("doc_id", F.expr(f"{_LAST} + make_interval(0, 0, 0, 0, 0, cast(doc_id as int), 0)").alias("ts"))
    return library.touched(docs, edits).select("doc_id", "updated_at", "pdf_path")


@query(""", r AS (SELECT user_id AS doc_id, max({'ts': ts, 'e': event_id}) AS r FROM events WHERE event_type = 'purchase' GROUP BY 1),
n AS (SELECT user_id AS doc_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1),
g AS (SELECT user_id AS doc_id, max({'ts': ts, 'e': event_id}) AS g FROM events WHERE event_type = 'view' GROUP BY 1),
j AS (SELECT docs.*, r.r.ts AS rts, r.r.e AS re, n.n, g.g.ts AS gts, g.g.e AS ge FROM docs LEFT JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id))
SELECT doc_id, CASE WHEN re % 4 <> 0 THEN 'Renamed ' || re ELSE title END AS title, CASE WHEN n % 2 = 1 THEN NOT is_favorite ELSE is_favorite END AS is_favorite,
    CASE WHEN ge IS NULL THEN tags[1] || ',' || tags[2] ELSE 'view,n' || (ge % 5) END AS tags,
    greatest(updated_at, CASE WHEN re % 4 <> 0 THEN rts END, gts) AS updated_at FROM j""")
def apply_doc_edits(spark, d):
    """Events as edits: purchases rename (every fourth to the name that is there), clicks turn the favourite, views set tags."""
    docs = V.documents(spark, d)
    e = V.table(spark, d, "events").select(F.col("user_id").alias("doc_id"), "ts", "event_id", "event_type").where("doc_id is not null")
    last = lambda kind: e.where(F.col("event_type") == kind).groupBy("doc_id").agg(F.max(F.struct("ts", "event_id")).alias("e")).select("doc_id", "e.*")
    renames = last("purchase").join(docs.select("doc_id", "title"), "doc_id").select("doc_id", "ts", F.when(F.col("event_id") % 4 == 0, F.col("title")).otherwise(F.concat(F.lit("Renamed "), F.col("event_id"))).alias("new_title"))
    tags = last("view").select("doc_id", "ts", F.array(F.lit("view"), F.concat(F.lit("n"), F.col("event_id") % 5)).alias("new_tags"))
    return library.edit_documents(docs, renames, e.where("event_type = 'click'"), tags).withColumn("tags", F.array_join("tags", ","))


_RESULT = "kind = 'image' AND ocr_status IN ('pending', 'failed')"


@query(f"""SELECT doc_id, page_index, CASE WHEN {_RESULT} THEN CASE WHEN (doc_id + page_index) % 2 = 0 THEN 'completed' ELSE 'failed' END ELSE ocr_status END AS ocr_status,
    md5(CASE WHEN {_RESULT} AND (doc_id + page_index) % 2 = 0 THEN 'recognised ' || doc_id || '/' || page_index ELSE text END) AS text_md5, {_RESULT} AS tried FROM pgs""")
def apply_ocr(spark, d):
    """Every page that waits is tried; half of them fail."""
    return _long(_recognised(spark, d), "page_index").select("doc_id", "page_index", "ocr_status", F.md5("text").alias("text_md5"), "tried")


@query(f"""SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE (doc_id + page_index) % 2 = 0) AS recognised FROM pgs WHERE {_RESULT} GROUP BY 1""")
def ocr_progress(spark, d):
    """How many pages of each document were tried, and how many have a text now."""
    return _recognised(spark, d).where("tried").groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if(F.col("ocr_status") == "completed").alias("recognised"))


def _recognised(spark, d):
    pages = V.pages(spark, d)
    turn = F.col("doc_id") + F.col("page_index")
    results = pages.select("doc_id", "page_index", F.concat(F.lit("recognised "), F.col("doc_id"), F.lit("/"), F.col("page_index")).alias("new_text"), (turn % 2 == 0).alias("ok"))
    return library.apply_recognition(pages, results)


@query(f"{_PAGES} SELECT doc_id, page_index FROM ep WHERE kind = 'image' AND NOT edited")
def ocr_worklist_forced(spark, d):
    """All pages to recognise again: those with a picture on which nobody has written."""
    return _long(library.awaiting(_pages(spark, d), force=True), "page_index").select("doc_id", "page_index")


@query(f"{_PAGES} SELECT doc_id, page_index, regexp_matches(text, '\\S') AS has_text, kind = 'image' AS has_image, edited FROM ep")
def page_flags(spark, d):
    p = _long(_pages(spark, d), "page_index")
    return p.select("doc_id", "page_index", F.col("text").rlike(r"\S").alias("has_text"), (F.col("kind") == "image").alias("has_image"), "edited")


@query("""SELECT DISTINCT 'p' || (doc_id % 60) || '-' || (doc_id % 4) || '.jpg' AS image_name FROM docs
EXCEPT SELECT regexp_extract(line, '^\\s*!\\[([^\\]]*)\\]\\(([^)\\s]+)\\)\\s*$', 2) FROM note_lines""")
def orphan_images(spark, d):
    """Stored pictures that no note shows."""
    stored = V.documents(spark, d).select(F.concat(F.lit("p"), F.col("doc_id") % 60, F.lit("-"), F.col("doc_id") % 4, F.lit(".jpg")).alias("image_name"))
    return library.orphans(stored, V.notes(spark, d).select(F.explode(markup.image_names(F.col("text"))).alias("image_name")))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 'scanned' ELSE doc_source END AS source, CASE WHEN event_type IN ('pending', 'running', 'completed', 'failed') THEN event_type ELSE 'pending' END AS status,
    CASE WHEN doc_id % 3 = 2 THEN 'text' ELSE 'scanned' END AS kind FROM docs LEFT JOIN (SELECT event_id, event_type FROM events) e ON event_id = doc_id""")
def decode_enums(spark, d):
    """Stored names of enums, some of which no version knows."""
    docs = V.documents(spark, d).join(V.table(spark, d, "events").select(F.col("event_id").alias("doc_id"), "event_type"), "doc_id", "left")
    raw = F.when(F.col("doc_id") % 5 == 4, "fax").otherwise(F.col("doc_source"))
    kind = F.element_at(F.array(F.lit("scanned"), F.lit(None), F.lit("text")), (F.col("doc_id") % 3 + 1).cast("int"))
    return docs.select("doc_id", library.decoded(raw, library.SOURCES, "scanned").alias("source"), library.decoded(F.col("event_type"), library.STATUSES, "pending").alias("status"), library.decoded(kind, library.PAGE_KINDS, "scanned").alias("kind"))


@query("""SELECT item_id AS doc_id, coalesce(nullif(substr(regexp_replace(string_split(text, chr(10))[1], '^\\s+|\\s+$', '', 'g'), 1, 120), ''), 'Untitled') AS title, page_index,
    CASE WHEN item_id % 3 > 0 THEN 'scan-' || item_id || '-' || page_index || '.jpg' END AS image_path, CASE WHEN item_id % 3 > 0 THEN 'image' ELSE 'text' END AS kind, CASE WHEN item_id % 3 > 0 THEN 'pending' ELSE 'completed' END AS ocr_status
FROM (SELECT item_id, text, unnest(range(0, greatest(item_id % 3, 1))) AS page_index FROM benchmark)""")
def create_docs(spark, d):
    """Items as new documents of none, one or two pictures; without one it is a written document."""
    items = V.table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.split("text", "\n")[0].alias("title"))
    paths = F.expr("transform(slice(array(0, 1), 1, cast(doc_id % 3 as int)), i -> concat('scan-', doc_id, '-', i, '.jpg'))")
    return _long(library.new_documents(items.withColumn("paths", paths)), "page_index")


@query("""SELECT doc_id, CASE WHEN length(t) = 0 THEN 'empty' WHEN length(t) > 120 THEN 'too_long' ELSE 'ok' END AS title, CASE WHEN n > 12 THEN 'too_many' WHEN longest > 32 THEN 'too_long' ELSE 'ok' END AS tags
FROM (SELECT doc_id, regexp_replace(string_split(text, chr(10))[1], '^\\s+|\\s+$', '', 'g') AS t, len(w) AS n, coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS longest
    FROM (SELECT doc_id, text, list_filter(string_split(string_split(text, chr(10))[1], ' '), lambda x: x <> '')[1:doc_id % 20] AS w FROM documents))""")
def validate_library(spark, d):
    """Whole first lines as titles, and their words as tags: what a rename or new tags would be told."""
    first = F.split("text", "\n")[0]
    words = F.slice(F.filter(F.split(first, " "), lambda x: x != ""), F.lit(1), (F.col("doc_id") % 20).cast("int"))
    return V.table(spark, d, "documents").select("doc_id", library.title_verdict(first).alias("title"), library.tags_verdict(words).alias("tags"))


@query("""SELECT doc_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY page_index)) AS text_md5 FROM pgs WHERE regexp_matches(text, '\\S') GROUP BY 1""")
def export_text(spark, d):
    """The readable text of each document as it would be shared; documents without any are refused."""
    p = V.pages(spark, d).withColumn("text", T.without_images(F.col("text"))).where(F.col("text").rlike(r"\S"))
    whole = p.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_index", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    return whole.select("doc_id", F.md5("text").alias("text_md5"))


# -- transcripts


def _said(spark, d):
    """Messages of which some have no conversation and some no document."""
    m = V.messages(spark, d)
    return m.select(F.when(m.conv_id % 5 > 0, m.conv_id).alias("conv_id"), F.when(m.conv_id % 3 > 0, m.conv_id % 40).alias("document_id"), "turn", "role", "text", m.conv_id.alias("origin"))


_SAID = """, said AS (SELECT CASE WHEN conv_id % 5 > 0 THEN conv_id END AS conv_id, CASE WHEN conv_id % 3 > 0 THEN conv_id % 40 END AS document_id, turn, role, text FROM messages),
keyed AS (SELECT *, coalesce(conv_id::VARCHAR, 'legacy:' || coalesce(document_id::VARCHAR, 'library')) AS key FROM said)"""


@query(f"{_SAID} SELECT key, count(*) AS n_messages, count(DISTINCT document_id) AS n_documents FROM keyed GROUP BY 1")
def conversation_keys(spark, d):
    return transcripts.keyed(_said(spark, d)).groupBy("key").agg(F.count("*").alias("n_messages"), F.count_distinct("document_id").alias("n_documents"))


@query(f"""{_SAID}, f AS (SELECT key, arg_min(text, {{'t': turn, 'c': conv_id}}) FILTER (WHERE role = 'user' AND regexp_matches(text, '\\S')) AS t0, count(*) AS n_messages, max(turn) AS last_turn,
    arg_min(document_id, {{'t': turn, 'c': conv_id}}) AS document_id FROM keyed WHERE conv_id IS NOT NULL GROUP BY 1),
g AS (SELECT *, regexp_replace(regexp_replace(t0, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM f)
SELECT key, coalesce(CASE WHEN length(t) <= 60 THEN t ELSE rtrim(substr(t, 1, 59)) || '…' END, 'Conversation') AS title, n_messages, last_turn, document_id,
    row_number() OVER (PARTITION BY document_id ORDER BY last_turn DESC, key) AS place FROM g""")
def conversation_list(spark, d):
    """The conversations of each document, newest first."""
    return transcripts.listing(_said(spark, d).where("conv_id is not null")).select("key", "title", "n_messages", "last_turn", "document_id", "place")


@query("SELECT conv_id, turn, role FROM messages WHERE conv_id NOT IN (SELECT item_id * 3 FROM benchmark)")
def transcript_delete(spark, d):
    """Without the conversations that somebody deleted."""
    gone = V.table(spark, d, "benchmark").select((F.col("item_id") * 3).alias("conv_id"))
    return V.messages(spark, d).join(gone, "conv_id", "left_anti").select("conv_id", "turn", "role")


@query(f"""{_SAID}, req AS (SELECT item_id AS req, CASE WHEN item_id % 2 = 0 THEN item_id + 1 END AS conv_id, CASE WHEN item_id % 2 = 1 THEN item_id END AS document_id FROM benchmark)
SELECT req, said.conv_id, turn, role, row_number() OVER (PARTITION BY req ORDER BY turn, said.conv_id) AS rk FROM req JOIN said ON said.conv_id IS NOT NULL AND (said.conv_id = req.conv_id OR (req.conv_id IS NULL AND said.document_id = req.document_id))""")
def transcript_history(spark, d):
    """The messages of one conversation, or of all about one document, for each request."""
    items = V.table(spark, d, "benchmark")
    wanted = items.select(F.col("item_id").alias("req"), F.when(F.col("item_id") % 2 == 0, F.col("item_id") + 1).alias("conv_id"), F.when(F.col("item_id") % 2 == 1, F.col("item_id")).alias("document_id"))
    return transcripts.history(_said(spark, d).where("conv_id is not null"), wanted)


@query("""SELECT conv_id, 2 * turn AS seq, 'user' AS role, text, NULL AS error FROM messages WHERE role = 'user'
UNION ALL SELECT q.conv_id, 2 * q.turn + 1, 'assistant', coalesce(a.text, ''), CASE WHEN a.text IS NULL THEN 'The assistant could not answer that.' END
FROM messages q LEFT JOIN messages a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role = 'user'""")
def transcript_append(spark, d):
    """Two turns for each question: it, and the answer that follows or an error."""
    m = V.messages(spark, d)
    asked = m.where("role = 'user'").select("conv_id", F.col("turn").alias("seq"), F.col("text").alias("question"))
    return transcripts.turns(asked, m.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("seq"), F.col("text").alias("answer")))
