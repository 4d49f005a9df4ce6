"""Queries of markup, wording and page layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import layout, markup, summaries
from pagewright.plans import views as V
from pagewright.plans.registry import query

_IMAGE = r"^\s*!\[([^\]]*)\]\(([^)\s]+)\)\s*$"


def _long(df, *names):
    return df.withColumns({c: F.col(c).cast("long") for c in names})


@query(f"""SELECT doc_id, page_index, md5(coalesce(string_agg(line, chr(10) ORDER BY ln) FILTER (WHERE NOT regexp_matches(line, '{_IMAGE}')), '')) AS text_md5 FROM note_lines GROUP BY 1, 2""")
def strip_images(spark, d):
    """Notes without the lines that are pictures."""
    return _long(V.notes(spark, d), "page_index").select("doc_id", "page_index", F.md5(T.without_images(F.col("text"))).alias("text_md5"))


@query(f"""SELECT doc_id, page_index, string_agg(regexp_extract(line, '{_IMAGE}', 2), '|' ORDER BY ln) AS images FROM note_lines WHERE regexp_matches(line, '{_IMAGE}') GROUP BY 1, 2""")
def image_refs(spark, d):
    """The pictures of each page that has any."""
    return _long(V.notes(spark, d), "page_index").select("doc_id", "page_index", F.array_join(markup.image_names(F.col("text")), "|").alias("images")).where("images <> ''")


_BLOCKS = f""", b AS (SELECT *, regexp_matches(line, '{_IMAGE}') AS img FROM note_lines),
c AS (SELECT *, count(*) FILTER (WHERE img) OVER (PARTITION BY doc_id, page_index ORDER BY ln) AS n FROM b),
parts AS (SELECT doc_id, page_index, 2 * (n - CASE WHEN img THEN 1 ELSE 0 END) + CASE WHEN img THEN 1 ELSE 0 END AS block_no, CASE WHEN img THEN 'image' ELSE 'text' END AS kind,
    string_agg(CASE WHEN img THEN regexp_extract(line, '{_IMAGE}', 2) ELSE line END, chr(10) ORDER BY ln) AS value FROM c GROUP BY 1, 2, 3, 4),
slots AS (SELECT doc_id, page_index, unnest(range(0, 2 * max(n) + 1)) AS block_no FROM c GROUP BY 1, 2),
blocked AS (SELECT s.doc_id, s.page_index, s.block_no, coalesce(kind, 'text') AS kind, coalesce(value, '') AS value FROM slots s LEFT JOIN parts USING (doc_id, page_index, block_no))"""


@query(f"{_BLOCKS} SELECT doc_id, page_index, block_no, kind, md5(value) AS value_md5 FROM blocked")
def text_image_blocks(spark, d):
    """Text before, between and after the pictures of each page."""
    return _long(markup.text_and_images(V.notes(spark, d)), "page_index", "block_no").select("doc_id", "page_index", "block_no", "kind", F.md5("value").alias("value_md5"))


@query("SELECT doc_id, page_index, md5(text) AS text_md5, true AS same FROM notes")
def blocks_round_trip(spark, d):
    """The blocks put together again, and whether that is the page they came from."""
    notes = V.notes(spark, d)
    back = markup.serialised(markup.text_and_images(notes)).join(notes.select("doc_id", "page_index", F.col("text").alias("was")), ["doc_id", "page_index"])
    return _long(back, "page_index").select("doc_id", "page_index", F.md5("text").alias("text_md5"), (F.col("text") == F.col("was")).alias("same"))


@query(rf"""SELECT doc_id, page_index, ln - 10 * page_index AS line_no, CASE WHEN regexp_matches(line, '{_IMAGE}') THEN 'image' WHEN regexp_matches(line, '^#\s+') THEN 'heading1' WHEN regexp_matches(line, '^##\s+') THEN 'heading2'
    WHEN regexp_matches(line, '^###\s+') THEN 'heading3' WHEN regexp_matches(line, '^\s*\d{{1,3}}[.)]\s+') THEN 'numbered' WHEN regexp_matches(line, '^\s*[-*•]\s+') THEN 'bullet' WHEN regexp_matches(line, '^\s*>') THEN 'quote' ELSE 'paragraph' END AS kind,
    CASE WHEN regexp_matches(line, '^\s*\d{{1,3}}[.)]\s+') THEN regexp_extract(line, '^\s*(\d{{1,3}})', 1)::INT END AS number, nullif(regexp_extract(line, '{_IMAGE}', 2), '') AS image_name FROM note_lines""")
def markup_lines(spark, d):
    """Every line of the notes with its kind, its number in a list, its picture."""
    return _long(markup.blocks(V.notes(spark, d)), "page_index", "line_no")


_TRIMMED = r"(SELECT * FROM (SELECT {'d': doc_id, 'p': page_index, 'l': ln - 10 * page_index} AS key, 0 AS ln, regexp_replace(line, '\s+$', '') AS line FROM note_lines) WHERE line <> '')"
_RUNS = f"""{V.markup_parts("m", _TRIMMED)}, cut AS (SELECT *, count(*) FILTER (WHERE marker) OVER (PARTITION BY key ORDER BY k) AS g FROM m),
run AS (SELECT key, g, string_agg(part, '' ORDER BY k) AS text, bool_or(bold) AS bold, bool_or(italic) AS italic FROM cut WHERE NOT marker GROUP BY 1, 2)"""


@query(rf"""{_RUNS}, r AS (SELECT key, string_agg(CASE WHEN bold THEN 'b' ELSE '' END || CASE WHEN italic THEN 'i' ELSE '' END || ':' || text, '|' ORDER BY g) AS spans FROM run GROUP BY 1)
SELECT key.d AS doc_id, key.p AS page_index, key.l AS line_no, block AS kind, CASE WHEN block = 'numbered' THEN regexp_extract(line, '^\s*(\d{{1,3}})', 1)::INT END AS number,
    CASE WHEN block = 'image' THEN regexp_extract(line, '{_IMAGE}', 2) END AS image_name, coalesce(spans, '') AS spans FROM m_l LEFT JOIN r USING (key)""")
def markup_spans(spark, d):
    """Bold and italic runs of every line, each as its flags and its text."""
    flags = lambda s: F.concat(F.when(s["bold"], "b").otherwise(""), F.when(s["italic"], "i").otherwise(""), F.lit(":"), s["text"])
    return _long(markup.spans(V.notes(spark, d)), "page_index", "line_no").withColumn("spans", F.array_join(F.transform("spans", flags), "|"))


_TOKENS = f"""{V.markup_parts("m", V.NOTE_LINES)}, edge AS (SELECT *, coalesce((marker, bold, italic, block) <> lag((marker, bold, italic, block)) OVER w, true) AS new FROM m WINDOW w AS (PARTITION BY key ORDER BY start, ln, k)),
num AS (SELECT *, count(*) FILTER (WHERE new) OVER (PARTITION BY key ORDER BY start, ln, k ROWS UNBOUNDED PRECEDING) AS g FROM edge)"""


@query(f"""{_TOKENS} SELECT key.d AS doc_id, key.p AS page_index, g - 1 AS token_no, min(start) AS start, max(start + length(part)) AS stop,
    any_value(marker) AS marker, any_value(bold) AS bold, any_value(italic) AS italic, any_value(block) AS block FROM num GROUP BY key, g""")
def markup_tokens(spark, d):
    """The notes as tokens that follow each other without a gap: markers and text, with their style and block."""
    return _long(markup.token_rows(V.notes(spark, d)), "page_index", "token_no", "start", "stop")


_STRIPPED = f"""{V.markup_parts("m", V.NOTE_LINES)}, kept AS (SELECT *, sum(CASE WHEN marker THEN 0 ELSE length(part) END) OVER (PARTITION BY key ORDER BY ln, k ROWS UNBOUNDED PRECEDING) AS upto FROM m),
chars AS (SELECT key, start + j AS i, CASE WHEN marker THEN upto ELSE upto - length(part) + j END AS o FROM (SELECT *, unnest(range(0, length(part))) AS j FROM kept)),
flat AS (SELECT key, string_agg(part, '' ORDER BY ln, k) FILTER (WHERE NOT marker) AS text, max(upto) AS "end" FROM kept GROUP BY 1),
places AS (SELECT key, string_agg(o, ',' ORDER BY i) AS o FROM chars GROUP BY 1)"""


@query(f"""{_STRIPPED} SELECT n.doc_id, n.page_index, coalesce(f.text, '') AS text, coalesce("end", 0)::BIGINT AS "end", md5(concat_ws(',', o, coalesce("end", 0))) AS offsets_md5
FROM notes n LEFT JOIN flat f ON f.key = {{'d': n.doc_id, 'p': n.page_index}} LEFT JOIN places ON places.key = f.key""")
def markup_strip(spark, d):
    """Notes without markers, where each ends, and a hash of where every character then stands."""
    s = V.notes(spark, d).withColumn("s", markup.stripped(F.col("text")))
    return _long(s.select("doc_id", "page_index", F.col("s.text").alias("text"), F.element_at("s.offsets", -1).alias("end"), F.md5(F.array_join("s.offsets", ",")).alias("offsets_md5")), "page_index", "end")


#: markers of the notes, where the rules of ``_NOTES`` put them; only lines without further stars or underscores are compared
_PLAIN = r"""SELECT doc_id, ln, CASE (doc_id + ln) % 10 WHEN 5 THEN line || ' and more' WHEN 7 THEN line || ' *stray' WHEN 9 THEN '' ELSE line END AS inline FROM doc_lines
WHERE NOT regexp_matches(line, '[*_]') AND line <> '' AND NOT regexp_matches(line, '^\s') AND (doc_id + ln) % 10 <> 6"""


@query(rf"SELECT doc_id, ln AS line_no, regexp_replace(regexp_replace(inline, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS inline FROM ({_PLAIN})")
def inline_text(spark, d):
    """Each line of the notes as it is quoted, of lines that had no star, underscore or lead of their own."""
    at = F.posexplode(F.split("text", "\n", -1)).alias("k", "line")
    own = V.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "was"))
    lines = V.notes(spark, d).select("doc_id", "page_index", at).select("doc_id", (F.col("page_index") * V.PAGE_LINES + F.col("k")).alias("line_no"), "line")
    rows = lines.join(own, ["doc_id", "line_no"]).where(r"not was rlike '[*_]' and was <> '' and not was rlike '^\\s' and (doc_id + line_no) % 10 <> 6")
    return _long(rows, "line_no").select("doc_id", "line_no", markup.inline_text(F.col("line")).alias("inline"))


@query(f"""{_RUNS}, whole AS (SELECT key, string_agg(text, '' ORDER BY g) AS line FROM run GROUP BY 1)
SELECT key.d AS doc_id, key.p AS page_index, string_agg(coalesce(whole.line, ''), chr(10) ORDER BY key.l) AS text FROM m_l LEFT JOIN whole USING (key) GROUP BY 1, 2""")
def plain_text(spark, d):
    """Notes as plain text."""
    return _long(markup.plain_text(V.notes(spark, d)), "page_index")


@query(r""", w AS (SELECT doc_id, lang, source, list_filter(string_split(title, ' '), lambda x: x <> '') AS w, title FROM docs JOIN documents USING (doc_id)),
n AS (SELECT *, ['no', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten'] AS words, regexp_replace(title, '^\s+|\s+$', '', 'g') AS t FROM w)
SELECT doc_id, CASE WHEN len(w) <= 10 THEN words[len(w) + 1] ELSE len(w)::VARCHAR END || CASE WHEN len(w) = 1 THEN ' word' ELSE ' words' END AS counted, lang || ', ' || source || ' and ' || doc_id AS listed,
    upper(title[1:1]) || title[2:] AS capitalised, CASE WHEN t LIKE '%.' THEN t[1:-2] ELSE t END AS unstopped FROM n""")
def phrasing(spark, d):
    docs = V.documents(spark, d)
    n = F.size(F.filter(F.split("title", " "), lambda x: x != ""))
    items = F.array(F.col("tags")[0], F.lit("  "), F.col("tags")[1], F.col("doc_id").cast("string"))
    return docs.select("doc_id", T.counted(n, "word", "words").alias("counted"), T.listed(items).alias("listed"), T.capitalised(F.col("title")).alias("capitalised"), T.without_stop(F.col("title")).alias("unstopped"))


#: a clause of at most 90 characters
CLAUSE = r"""CASE WHEN length(%(f)s) <= 90 THEN %(f)s WHEN length(regexp_extract(%(f)s[1:91], '^(.*)[,;:]', 1)) > 30 THEN regexp_replace(%(f)s[1:length(regexp_extract(%(f)s[1:91], '^(.*)[,;:]', 1))], '^\s+|\s+$', '', 'g')
    ELSE regexp_replace(%(f)s[1:coalesce(nullif(length(regexp_extract(%(f)s[1:91], '^(.*) ', 1)), 0), 90)], '^\s+|\s+$', '', 'g') || '…' END"""


@query(rf""", l AS (SELECT doc_id, ln, regexp_replace(regexp_replace(line, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS f FROM doc_lines)
SELECT doc_id, ln AS line_no, {CLAUSE % {"f": "f"}} AS clause FROM l""")
def clauses(spark, d):
    """Every line cut to a clause."""
    lines = V.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return _long(lines, "line_no").select("doc_id", "line_no", summaries.clause(F.col("line")).alias("clause"))


# -- layout: every line of a page as two fragments, of which some stand higher, lower or on the line before

_HEIGHT = 10.0


def _elements(spark, d):
    """Words of fragments with boxes: of each line the first three words on the left, the rest on the right; every seventh
    fragment has no words of its own."""
    lines = V.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ln", "line"))
    words = F.filter(F.split("line", " "), lambda w: w != "")
    side = F.array(F.slice(words, 1, 3), F.slice(words, 4, 1 << 30))
    f = lines.select("doc_id", F.expr(f"ln div {V.PAGE_LINES}").alias("page_index"), F.expr(f"ln % {V.PAGE_LINES}").alias("block_no"), "ln", F.posexplode(side).alias("line_no", "words")).where("size(words) > 0")
    turn = F.col("doc_id") + F.col("ln") + F.col("line_no")
    top = F.col("block_no") * 12.0 + F.when(F.col("block_no") >= 5, 20.0).otherwise(0.0) + (turn % 4) * 1.5 - F.when(turn % 9 == 0, 12.0).otherwise(0.0)
    f = f.withColumns({"t": top, "h": F.lit(_HEIGHT) + (turn % 3) * 2.0, "bare": turn % 7 == 0})
    each = f.select("doc_id", "page_index", "block_no", "line_no", "t", "h", "bare", F.array_join("words", "  ").alias("line_text"), F.posexplode("words").alias("k", "text"))
    one = each.where("not bare or k = 0")
    return one.select(
        "doc_id", F.col("page_index").cast("long").alias("page_index"), F.col("block_no").cast("long").alias("block_no"), F.col("line_no").cast("long").alias("line_no"),
        F.when(~F.col("bare"), F.col("k")).alias("element_no"), "line_text", F.when(~F.col("bare"), F.col("text")).alias("text"),
        (F.col("line_no") * 500.0 + F.col("k") * 40.0).alias("l"), "t", (F.col("line_no") * 500.0 + F.col("k") * 40.0 + 35.0).alias("r"), (F.col("t") + F.col("h")).alias("b"),
    )


_FRAGMENTS = r""", lw AS (SELECT doc_id, ln, list_filter(string_split(line, ' '), lambda x: x <> '') AS w FROM doc_lines),
lf AS (SELECT doc_id, ln // 10 AS page_index, ln % 10 AS block_no, ln, s AS line_no, CASE WHEN s = 0 THEN w[1:3] ELSE w[4:] END AS words FROM lw, (SELECT unnest([0, 1]) AS s)),
frag AS (SELECT doc_id, page_index, block_no, line_no::BIGINT AS line_no, regexp_replace(regexp_replace(array_to_string(words, ' '), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text, line_no * 500.0::DOUBLE AS l,
    block_no * 12.0::DOUBLE + CASE WHEN block_no >= 5 THEN 20.0 ELSE 0.0 END::DOUBLE + ((doc_id + ln + line_no) % 4) * 1.5::DOUBLE - CASE WHEN (doc_id + ln + line_no) % 9 = 0 THEN 12.0 ELSE 0.0 END::DOUBLE AS t,
    10.0::DOUBLE + ((doc_id + ln + line_no) % 3) * 2.0::DOUBLE AS h FROM lf WHERE len(words) > 0),
fragments AS (SELECT * FROM frag WHERE text <> '')"""


@query(f"{_FRAGMENTS} SELECT doc_id, page_index, block_no, line_no, text, round(t, 3) AS t, round(t + h, 3) AS b FROM fragments")
def layout_lines(spark, d):
    """Lines put together from their words."""
    return layout.lines(_elements(spark, d)).select("doc_id", "page_index", "block_no", "line_no", "text", F.round("t", 3).alias("t"), F.round("b", 3).alias("b"))


@query(rf"""{_FRAGMENTS}, ordered AS (SELECT *, t + h AS b, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY t, l, block_no, line_no) AS i FROM fragments),
grown AS (SELECT doc_id, page_index, i, 1 AS rw, t AS top, b AS bottom, l, text FROM ordered WHERE i = 1
    UNION ALL SELECT o.doc_id, o.page_index, o.i, CASE WHEN joins THEN rw ELSE rw + 1 END, CASE WHEN joins THEN least(top, o.t) ELSE o.t END, CASE WHEN joins THEN greatest(bottom, o.b) ELSE o.b END, o.l, o.text
    FROM (SELECT o.*, g.rw, g.top, g.bottom, least(g.bottom, o.b) - greatest(g.top, o.t) > 0 AND (least(g.bottom, o.b) - greatest(g.top, o.t)) / least(g.bottom - g.top, o.b - o.t) >= 0.4::DOUBLE AS joins
        FROM grown g JOIN ordered o ON o.doc_id = g.doc_id AND o.page_index = g.page_index AND o.i = g.i + 1) o),
rws AS (SELECT doc_id, page_index, rw, min(top) AS top, max(bottom) AS bottom, string_agg(text, ' ' ORDER BY l, i) AS text FROM grown GROUP BY 1, 2, 3),
med AS (SELECT doc_id, page_index, count(*) AS n, list_sort(list(bottom - top))[count(*) // 2 + 1] AS m FROM rws GROUP BY 1, 2),
gaps AS (SELECT rws.*, n, m, lead(top) OVER (PARTITION BY doc_id, page_index ORDER BY rw) - bottom AS gap FROM rws JOIN med USING (doc_id, page_index))
SELECT doc_id, page_index, any_value(n) AS n_rows, regexp_replace(string_agg(text || CASE WHEN gap IS NULL THEN '' WHEN gap > CASE WHEN m <= 0 THEN 1.0 ELSE m END * 1.4::DOUBLE THEN chr(10) || chr(10) ELSE chr(10) END, '' ORDER BY rw), '^\s+|\s+$', '', 'g') AS text FROM gaps GROUP BY 1, 2""")
def layout_text(spark, d):
    """Pages in reading order from the boxes of their fragments."""
    return layout.compose(layout.rows(layout.lines(_elements(spark, d)))).withColumn("n_rows", F.col("n_rows").cast("long"))
