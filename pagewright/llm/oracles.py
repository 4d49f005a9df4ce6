"""The same results as DuckDB SQL, for the operators that SQL can express; it compares by plain joins."""

from __future__ import annotations

from . import collocations, licenses, variants, warc
from .ngram_join import SHINGLE

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = r"regexp_extract_all(%s, '[^\x20\x09-\x0D]+')"
_SYMBOL = r"regexp_extract_all(%s, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

NGRAM_JOIN = rf"""WITH RECURSIVE w AS (SELECT doc_id, {_SPACE % _FOLD} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))) END AS s FROM w),
one AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM one a JOIN one b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS m FROM documents UNION SELECT b.y, r.m FROM reach r JOIN both_ways b ON b.x = r.x)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, c.m AS component_id FROM s JOIN (SELECT x, min(m) AS m FROM reach GROUP BY 1) c ON c.x = s.doc_id"""


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_TEMPLATES = ", ".join(f"({_text(name)}, {_text(' '.join(licenses.words_of(text)))})" for name, text in licenses.TEMPLATES.items())
_SHINGLED = "list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))"
LICENSES = rf"""WITH t AS (SELECT license_id, {_SHINGLED} AS s FROM (SELECT license_id, string_split(words, ' ') AS w FROM (VALUES {_TEMPLATES}) v(license_id, words))),
d AS (SELECT doc_id, row_number() OVER () AS r, {_SYMBOL % _FOLD} AS w FROM documents),
ds AS (SELECT r, unnest({_SHINGLED}) AS x FROM d WHERE len(w) > 0),
ts AS (SELECT license_id, len(s) AS n, unnest(s) AS x FROM t),
hit AS (SELECT r, license_id, n, count(*) AS found FROM ds JOIN ts USING (x) GROUP BY 1, 2, 3 HAVING count(*) >= {licenses.CONTAINED}::DOUBLE * n)
SELECT doc_id, license_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(found, 0)::BIGINT AS n_found, coalesce(found / n, 0.0)::DOUBLE AS containment FROM d LEFT JOIN hit USING (r)"""

DECONTAMINATION = rf"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_SYMBOL % _FOLD} AS w FROM documents),
i AS (SELECT item_id, {_SYMBOL % _FOLD} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda p: array_to_string(w[p:p + 9], ' '))) AS x FROM i WHERE len(w) > 0),
dw AS (SELECT r, k, p, array_to_string(w[p:p + k - 1], ' ') AS x FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM iw))),
hit AS (SELECT r, item_id, p, k FROM dw JOIN iw USING (k, x)),
words AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM hit) GROUP BY 1),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""

LINE_DEDUP = rf"""WITH l AS (SELECT doc_id, text, ln, line, list_distinct({_SPACE % _FOLD.replace("text", "line")}) AS w FROM
    (SELECT doc_id, text, generate_subscripts(a, 1) - 1 AS ln, unnest(a) AS line FROM (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL))),
n AS (SELECT DISTINCT list_sort(w) AS w FROM l WHERE len(w) > 0),
df AS (SELECT word, count(*) AS df FROM (SELECT unnest(w) AS word FROM l) GROUP BY 1),
o AS (SELECT w, list(word ORDER BY df, word) AS by_rarity FROM (SELECT w, unnest(w) AS word FROM n) JOIN df USING (word) GROUP BY w),
p AS (SELECT w, len(w) AS k, unnest(by_rarity[1:len(w) - (4 * len(w) + 4) // 5 + 1]) AS t FROM o),
c AS (SELECT DISTINCT a.w AS x, b.w AS y FROM p a JOIN p b ON a.t = b.t AND a.w <> b.w AND 5 * a.k >= 4 * b.k AND 5 * b.k >= 4 * a.k),
m AS (SELECT x, y FROM c WHERE 100 * len(list_intersect(x, y)) >= 80 * (len(x) + len(y) - len(list_intersect(x, y)))),
f AS (SELECT list_sort(w) AS w, min({{'d': doc_id, 'n': ln}}) AS f FROM l WHERE len(w) > 0 GROUP BY 1),
e AS (SELECT m.x AS w, min(f.f) AS e FROM m JOIN f ON f.w = m.y GROUP BY 1),
g AS (SELECT l.*, coalesce(least(f.f, e.e) < {{'d': doc_id, 'n': ln}}, false) AS gone FROM l LEFT JOIN f ON f.w = list_sort(l.w) LEFT JOIN e ON e.w = list_sort(l.w)),
k AS (SELECT doc_id, text, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY ln) FILTER (WHERE NOT gone), '') AS kept FROM g GROUP BY 1, 2)
SELECT d.doc_id, k.kept AS text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id AND k.text = d.text"""

VARIANTS = rf"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
r AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_FOLD}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY 1, 2),
b AS (SELECT doc_id, run, n, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END)) AS bytes FROM r),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM b, crc),
cut AS (SELECT CASE WHEN h % {variants.DELETE_EVERY} = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= {variants.LEAST_LETTERS} GROUP BY 1 HAVING sum(n) >= {variants.LEAST_COUNT}),
less AS (SELECT word, n, unnest(list_distinct(list_prepend(word, list_transform(range(1, length(word) + 1), lambda i: word[1:i - 1] || word[i + 1:])))) AS s FROM v),
near AS (SELECT DISTINCT x.word, x.n, y.word AS other, y.n AS other_n FROM less x JOIN less y USING (s) WHERE x.word <> y.word AND (x.word = s OR y.word = s
    OR length(x.word) = length(y.word) AND len(list_filter(range(1, length(x.word) + 1), lambda i: x.word[i] <> y.word[i])) = 1)),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS form, max(other_n) AS form_n FROM near GROUP BY 1),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {variants.RATIO} * v.n THEN form END AS form, CASE WHEN form_n >= {variants.RATIO} * v.n THEN form_n END AS form_n FROM v LEFT JOIN best USING (word)),
way AS (SELECT word, word AS root FROM forms UNION ALL SELECT way.word, forms.form FROM way JOIN forms ON forms.word = way.root WHERE forms.form IS NOT NULL),
ends AS (SELECT way.word, way.root FROM way JOIN forms ON forms.word = way.root WHERE forms.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)"""

_GRAMS = "\n    UNION ALL ".join(f"SELECT lang, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS phrase, {k} AS m FROM p" for k in range(1, collocations.LONGEST + 1))
COLLOCATIONS = rf"""WITH p AS MATERIALIZED (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(string_split_regex({_FOLD}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
t AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM p GROUP BY 1),
f AS MATERIALIZED (SELECT lang, phrase, m, count(*) AS a FROM ({_GRAMS}) GROUP BY 1, 2, 3 HAVING count(*) >= {collocations.LEAST}),
c AS (SELECT lang, phrase, m, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
k AS (SELECT lang, phrase, m, a, w, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.m, k.a, k.k, x.a AS l, y.a AS r, n, (1000 * k.a::HUGEINT * n) // (x.a::HUGEINT * y.a) AS score FROM k JOIN t USING (lang)
    JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
weak AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS x FROM s) WHERE x = 1),
inside AS (SELECT lang, array_to_string(w[i:i + z - 1], ' ') AS phrase, max(a) AS most FROM (SELECT lang, w, m, a, z, unnest(range(1, m - z + 2)) AS i FROM (SELECT lang, w, m, a, unnest(range(2, m)) AS z FROM c)) GROUP BY 1, 2),
kept AS (SELECT weak.* FROM weak LEFT JOIN inside USING (lang, phrase) WHERE most IS NULL OR 100 * most < 100 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= {collocations.MOST_RANKS}"""

WARC = f"""WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS least FROM p WHERE payload_bytes >= {warc.LEAST_REVISIT} GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN coalesce(page_id > least, least IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN coalesce(page_id > least, least IS NOT NULL) THEN least END AS refers_to FROM p LEFT JOIN f USING (payload_digest)"""
