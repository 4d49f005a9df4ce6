"""Queries of archives and incoming files."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import archives
from pagewright.plans import views as V
from pagewright.plans.registry import query
from pagewright.sources import incoming

_KIND = """CASE WHEN e = 'pdf' THEN 'pdf' WHEN e IN ('jpg', 'jpeg', 'png', 'webp') THEN 'image' WHEN e IN ('txt', 'md', 'docx') THEN 'text' WHEN e IN ('zip', 'rar', '7z', 'tar', 'gz') THEN 'archive' ELSE 'other' END"""
#: entries under names that files have: every seventh host's path gets one of eight extensions
_NAMED = f""", named AS (SELECT archive, entry_no, size, compressed, path, regexp_extract(regexp_replace(path, '/+$', ''), '([^/]*)$', 1) AS base FROM entries),
files AS (SELECT archive, entry_no, size, compressed, CASE WHEN base = '' THEN 'index' ELSE base END || ['', '.pdf', '.JPG', '.txt', '.zip', '.png', '.docx', '.exe'][entry_no % 8 + 1] AS name FROM named),
kinds AS (SELECT *, {_KIND} AS kind FROM (SELECT *, lower(regexp_extract(name, '[^/]\\.([^./]*)$', 1)) AS e FROM files))"""


def _files(spark, d):
    e = V.archive_entries(spark, d)
    base = F.regexp_extract(F.regexp_replace("path", "/+$", ""), "([^/]*)$", 1)
    ends = F.element_at(F.array(*map(F.lit, ("", ".pdf", ".JPG", ".txt", ".zip", ".png", ".docx", ".exe"))), (F.col("entry_no") % 8 + 1).cast("int"))
    return e.withColumn("name", F.concat(F.when(base == "", "index").otherwise(base), ends)).withColumn("path", F.col("name"))


@query(f"{_NAMED} SELECT archive, count(*) AS n_files, count(*) FILTER (WHERE kind IN ('pdf', 'text', 'image')) AS n_importable, sum(size)::BIGINT AS bytes FROM kinds GROUP BY 1")
def archive_importable(spark, d):
    return archives.totals(_files(spark, d))


@query(""", x AS (SELECT archive, size, list_filter(string_split(path, '/'), lambda y: y <> '') AS p FROM entries),
u AS (SELECT archive, size, p, unnest(range(0, len(p))) AS depth FROM x WHERE len(p) > 0),
c AS (SELECT archive, coalesce(array_to_string(p[1:depth], '/'), '') AS folder, p[depth + 1] AS name, depth < len(p) - 1 AS is_folder,
    CASE WHEN depth < len(p) - 1 THEN p[depth + 2] || CASE WHEN depth = len(p) - 2 THEN '|f' ELSE '|d' END END AS below, size FROM u),
g AS (SELECT archive, folder, name, is_folder, sum(size)::BIGINT AS bytes, count(DISTINCT below) AS n_children FROM c GROUP BY 1, 2, 3, 4)
SELECT *, row_number() OVER (PARTITION BY archive, folder ORDER BY is_folder DESC, lower(name), name) AS place FROM g""")
def folder_listing(spark, d):
    return archives.listing(V.archive_entries(spark, d))


@query(f"""{_NAMED}, ordered AS (SELECT archive, entry_no, row_number() OVER (PARTITION BY archive ORDER BY entry_no) AS i, CASE WHEN entry_no % 3 = 0 THEN 'Scan.pdf' WHEN entry_no % 5 = 0 THEN 'scan (2).PDF' ELSE name END AS name FROM files),
split AS (SELECT *, CASE WHEN regexp_matches(name, '^.+\\.[^.]*$') THEN regexp_extract(name, '^(.+)\\.[^.]*$', 1) ELSE name END AS stem FROM ordered),
named_one AS (SELECT archive, 1::BIGINT AS i, entry_no, name, name AS "unique", [lower(name)] AS taken FROM split WHERE i = 1
    UNION ALL SELECT archive, i, entry_no, name, u, list_append(taken, lower(u)) FROM (SELECT s.archive, s.i, s.entry_no, s.name, taken, CASE WHEN NOT list_contains(taken, lower(s.name)) THEN s.name
        ELSE list_filter(list_transform(range(2, len(taken) + 3), lambda n: stem || ' (' || n || ')' || substr(s.name, length(stem) + 1)), lambda c: NOT list_contains(taken, lower(c)))[1] END AS u
        FROM named_one o JOIN split s ON s.archive = o.archive AND s.i = o.i + 1))
SELECT archive, entry_no, name, "unique" FROM named_one""")
def unique_names(spark, d):
    """Names of which many collide, some by letter case or by a number that is already there."""
    name = F.when(F.col("entry_no") % 3 == 0, "Scan.pdf").when(F.col("entry_no") % 5 == 0, "scan (2).PDF").otherwise(F.col("name"))
    return archives.unique_names(_files(spark, d).select("archive", "entry_no", name.alias("name")))


_OUTCOMES = f"""{_NAMED}, placed AS (SELECT *, row_number() OVER (PARTITION BY archive ORDER BY entry_no) AS place,
    CASE WHEN size > 134217728 THEN false WHEN compressed <= 0 THEN size = 0 ELSE size // compressed <= 300 END AS safe FROM kinds),
outcomes AS (SELECT archive, entry_no, kind, CASE WHEN place > 20 THEN 'stopped' WHEN kind NOT IN ('pdf', 'text', 'image') THEN 'unsupported' WHEN NOT safe THEN 'unreadable' ELSE 'imported' END AS status FROM placed)"""


@query(f"""{_OUTCOMES} SELECT archive, entry_no, status, CASE status WHEN 'stopped' THEN 'You stopped the import before this file.' WHEN 'unsupported' THEN CASE WHEN kind = 'archive' THEN 'An archive inside an archive is not opened.'
    ELSE 'Only PDFs, Word files, text files and pictures are imported.' END WHEN 'unreadable' THEN 'The entry is too large.' END AS reason FROM outcomes""")
def import_outcomes(spark, d):
    """Imports that are stopped after the twentieth entry of an archive."""
    return archives.import_outcomes(_files(spark, d), 20)


@query(f"""{_OUTCOMES} SELECT archive, {", ".join(f"count(*) FILTER (WHERE status = '{s}') AS n_{s}" for s in ("imported", "unsupported", "unreadable", "stopped"))},
    count(*) FILTER (WHERE status <> 'imported') = 0 AS is_complete FROM outcomes GROUP BY 1""")
def import_report(spark, d):
    return archives.import_report(archives.import_outcomes(_files(spark, d), 20))


@query(""", b AS (SELECT doc_id // 50 AS bundle, doc_id AS source_no, page_index AS page_no FROM pgs),
m AS (SELECT *, row_number() OVER (PARTITION BY bundle ORDER BY source_no, page_no) AS place, count(*) OVER (PARTITION BY bundle) >= 40 AS truncated,
    min(source_no) OVER (PARTITION BY bundle) < max(source_no) OVER (PARTITION BY bundle) AS several FROM b)
SELECT bundle, place, source_no, page_no, truncated FROM m WHERE several AND place <= 40""".replace("40", "200"))
def merge_plan(spark, d):
    """Fifty documents at a time as sources of one file of at most 200 pages."""
    p = V.pages(spark, d).select(F.expr("doc_id div 50").alias("bundle"), F.col("doc_id").alias("source_no"), F.col("page_index").cast("long").alias("page_no"))
    return archives.merge_plan(p)


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '\S') THEN md5(text) END AS text_md5, CASE WHEN NOT regexp_matches(text, '\S') THEN 'There was no text in that file.' END AS reason
FROM (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '  ' ELSE text END AS text FROM documents)""")
def ingest_text(spark, d):
    """Texts as the bytes of files, a third with a byte order mark, some blank."""
    text = F.when(F.col("doc_id") % 11 == 0, "  ").otherwise(F.concat(F.when(F.col("doc_id") % 3 == 0, "\ufeff").otherwise(""), F.col("text")))
    found = incoming.imported_texts(V.table(spark, d, "documents").select("doc_id", F.encode(text, "UTF-8").alias("content")))
    return found.select("doc_id", F.md5("text").alias("text_md5"), "reason")


@query(f"""{_NAMED} SELECT entry_no, CASE e WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'word' WHEN 'txt' THEN 'text' WHEN 'md' THEN 'text' WHEN 'jpg' THEN 'image' WHEN 'jpeg' THEN 'image' WHEN 'png' THEN 'image' WHEN 'webp' THEN 'image' END AS route,
    CASE WHEN e IN ('pdf', 'docx', 'txt', 'md', 'jpg', 'jpeg', 'png', 'webp') THEN NULL WHEN e = '' THEN 'A file without an extension can not be imported.' ELSE 'A .' || e || ' file can not be imported.' END AS reason FROM kinds""")
def ingest_route(spark, d):
    return _files(spark, d).select("entry_no", incoming.route(F.col("name")).alias("route"), incoming.reason(F.col("name")).alias("reason"))


@query(f"""{_NAMED}, z AS (SELECT archive, entry_no, kind, e, e = 'zip' OR entry_no % 16 = 7 AS zip FROM kinds)
SELECT archive AS batch, count(*) AS n_files, count(*) FILTER (WHERE kind NOT IN ('pdf', 'text', 'image') AND NOT zip) AS rejected, count(*) FILTER (WHERE zip) AS n_archives, bool_and(kind = 'image') AS is_all_images FROM z GROUP BY 1""")
def incoming_batch(spark, d):
    """Each host's files as one delivery; some are archives by their type only."""
    f = _files(spark, d).select(F.col("archive").alias("batch"), "name", F.when(F.col("entry_no") % 16 == 7, "application/zip").alias("mime_type"))
    return incoming.deliveries(f)


@query(f"""{_NAMED}, n AS (SELECT *, kind = 'image' AS ok FROM kinds)
SELECT archive AS batch, least(count(*) FILTER (WHERE ok), 30) AS taken, coalesce(string_agg(name, '|' ORDER BY entry_no) FILTER (WHERE NOT ok), '') AS rejected, count(*) FILTER (WHERE ok) > 30 AS truncated FROM n GROUP BY 1""")
def picture_import(spark, d):
    """Each host's files as one choice of pictures, of which thirty are taken."""
    return incoming.picture_imports(_files(spark, d).select(F.col("archive").alias("batch"), F.col("entry_no").alias("file_no"), "name"))


@query(f"""{_NAMED} SELECT entry_no, CASE WHEN regexp_replace(t, '^\\s+|\\s+$', '', 'g') = '' THEN name ELSE regexp_replace(t, '^\\s+|\\s+$', '', 'g') END AS title
FROM (SELECT entry_no, name, CASE WHEN regexp_matches(name, '^.+\\.[^.]*$') THEN regexp_extract(name, '^(.+)\\.[^.]*$', 1) ELSE name END AS t FROM files)""")
def entry_titles(spark, d):
    return _files(spark, d).select("entry_no", T.entry_title(F.col("name")).alias("title"))
