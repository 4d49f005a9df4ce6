"""Personal data: base patterns, and a contextual extraction bootstrapped from what they find.

Base spans (email, ip, card, phone) are seeds. The words around them are lexical patterns; numbers and codes that are
no base span are candidates. Patterns and instances form a graph that is scored in rounds: a pattern by the share of
its instances that are believed, an instance by the patterns that it is found in. Candidates under patterns of high
confidence become further spans, of kind ``id``. Everything is DataFrame and SQL functions; the patterns' quantifiers
are possessive and anchored, and spans are placed and compared in parts, so a text costs little more than its length.

Defined cases: a null text counts as empty and has no spans; repeated rows are searched each (a candidate's evidence
counts distinct values, so copies add nothing); a null doc_id stays null; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Workspace

KINDS = ("email", "ip", "card", "phone", "id")
_LOCAL = "[A-Za-z0-9._%+-]"
#: what matches here is what the plain patterns match; look-behinds and possessive quantifiers only keep failures short
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BLANK = r"\x20\x09-\x0D"
#: a word that holds a digit
CODE = rf"(?<![^{_BLANK}])[^{_BLANK}0-9]*+[0-9][^{_BLANK}]*+"
CONTEXT = 80
ROUNDS = 3
#: a pattern needs so many distinct seeds, and this confidence
LEAST_SEEDS, CONFIDENT = 3, 0.6
LEAST_DIGITS, LEAST_LENGTH = 4, 6


#: arrays are summed and searched in parts of so many, so that a text with many matches costs little more than its length
PART = 64


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _parts(array: str, make: str) -> str:
    """``make`` of each part (as y) of an array that is not empty."""
    return f"transform(sequence(0, (size({array}) - 1) div {PART}), k -> {_let(f'slice({array}, k * {PART} + 1, {PART})', 'y', make)})"


def _sum(array: str) -> str:
    return f"aggregate({array}, 0, (n, x) -> n + x)"


def _found(name: str, number: int) -> Column:
    """Spans with their context, from the pieces between matches and the matches (columns p_<name> and m_<name>)."""
    p, m = f"p_{name}", f"m_{name}"
    kind = "array<struct<start:int,kind:int,stop:int,value:string,before:string,after:string>>"
    start = f"ends[cast(i div {PART} as int)] + {_sum(f'slice(lengths, cast(i div {PART} as int) * {PART} + 1, i % {PART})')} + length(w)"
    span = f"struct(s as start, {number} as kind, s + length({m}[i]) as stop, {m}[i] as value, right(w, {CONTEXT}) as before, left({p}[i + 1], {CONTEXT}) as after)"
    spans = f"transform(slice({p}, 1, size({m})), (w, i) -> {_let(start, 's', span)})"
    # where each part of the matches begins, summed the same way over the parts
    ends = f"transform(sequence(0, size(sums) - 1), k -> {_sum('slice(sums, 1, k)')})"
    lengths = f"zip_with(slice({p}, 1, size({m})), {m}, (a, b) -> length(a) + length(b))"
    return F.expr(f"if(size({m}) = 0, cast(array() as {kind}), {_let(lengths, 'lengths', _let(_parts('lengths', _sum('y')), 'sums', _let(ends, 'ends', spans)))})")


def _apart(codes: str, base: str) -> str:
    """The codes that overlap no base span; spans are searched by parts, and parts of parts."""
    part = "struct(y[0].start as low, array_max(transform(y, b -> b.stop)) as high, y as held)"
    more = "struct(y[0].low as low, array_max(transform(y, b -> b.high)) as high, y as held)"
    meets = lambda name, inner: f"{name}.low < x.stop and x.start < {name}.high and exists({name}.held, {inner})"
    hit = f"exists(tops, t -> {meets('t', 'u -> ' + meets('u', 'b -> b.start < x.stop and x.start < b.stop'))})"
    return f"if(size({base}) = 0, {codes}, {_let(_parts(base, part), 'few', _let(_parts('few', more), 'tops', f'filter({codes}, x -> not {hit})'))})"


def _luhn(digits: str) -> str:
    return f"""aggregate(sequence(1, length({digits})), 0, (s, i) -> s + if(i % 2 = 1, 1, 0) * cast(substring({digits}, length({digits}) - i + 1, 1) as int)
        + if(i % 2 = 0, 1, 0) * element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), 1 + cast(substring({digits}, length({digits}) - i + 1, 1) as int))) % 10 = 0"""


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


#: 0 to 255 with any leading zeros; a part of zeros only is the last alternative, as 0*+ gives none back
_BYTE = "(?:0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])|0++)"
VALID = {
    "email": "true",
    "ip": f"x.value rlike '^{_BYTE}(?:[.]{_BYTE}){{3}}$'",
    "card": f"length({_digits('x.value')}) between 14 and 19 and {_luhn(_digits('x.value'))}",
    "phone": f"length({_digits('x.value')}) between 10 and 15",
}


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, ``base`` (spans with kind and context, by start, then kind) and ``codes`` (candidates)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    every = BASE | {"code": CODE}
    needs = {"email": F.col("text").contains("@"), "phone": F.col("text").contains("+")}
    cut = {}
    for name, pattern in every.items():
        use = needs.get(name, F.col("text").rlike("[0-9]"))
        cut[f"m_{name}"] = F.when(use, F.regexp_extract_all("text", F.lit(pattern), 0)).otherwise(F.array().cast("array<string>"))
        cut[f"p_{name}"] = F.when(use, F.split("text", pattern, -1)).otherwise(F.array().cast("array<string>"))
    parts = docs.select("doc_id", *(c.alias(n) for n, c in cut.items()))
    spans = parts.select("doc_id", *(_found(name, k).alias(name) for k, name in enumerate(every)))
    valid = spans.select("doc_id", *(F.expr(f"filter({k}, x -> {v})").alias(k) for k, v in VALID.items()), "code")
    base = F.array_sort(F.concat(*VALID))
    shape = f"length(x.value) >= {LEAST_LENGTH} and length({_digits('x.value')}) >= {LEAST_DIGITS}"
    codes = valid.select("doc_id", base.alias("base"), F.expr(f"filter(code, x -> {shape})").alias("code"))
    return codes.select("doc_id", "base", F.expr(_apart("code", "base")).alias("codes"))


def _patterns(x: str) -> str:
    """Up to two patterns of a span: the two words before it, and the words on both sides."""
    two = f"regexp_extract(lower({x}.before), '([^{_BLANK}]+[{_BLANK}]+[^{_BLANK}]+)[{_BLANK}]+[^{_BLANK}]{{0,2}}$', 1)"
    left = f"regexp_extract(lower({x}.before), '([^{_BLANK}]+)[{_BLANK}]+[^{_BLANK}]{{0,2}}$', 1)"
    right = f"regexp_extract(lower({x}.after), '^[^{_BLANK}]{{0,2}}[{_BLANK}]+([^{_BLANK}]+)', 1)"
    return f"filter(array(if({two} = '', null, concat('B', {two})), if({left} = '' or {right} = '', null, concat('A', {left}, ' ', {right}))), p -> p is not null)"


def _name(x: str = "x") -> str:
    return f"concat_ws(':', element_at(array({', '.join(map(repr, KINDS))}), {x}.kind + 1), {x}.start, {x}.stop)"


def extract(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, base (spans), found (further spans)."""
    work = Workspace(docs.sparkSession, "pii")
    found = base_spans(docs).select(
        "doc_id",
        F.expr("transform(base, x -> struct(x.start, x.kind, x.stop, x.value))").alias("base"),
        F.expr(f"transform(base, x -> struct(xxhash64(x.kind, x.value) as instance, {_patterns('x')} as patterns))").alias("seeds"),
        F.expr(f"transform(codes, x -> struct(x.start, 4 as kind, x.stop, x.value, xxhash64(4, x.value) as instance, {_patterns('x')} as patterns))").alias("codes"),
    )
    found = work.keep(found, "spans")
    seeds = found.select(F.explode("seeds").alias("s")).select("s.instance", F.explode("s.patterns").alias("pattern")).distinct()
    strong = work.keep(seeds.groupBy("pattern").agg(F.count("*").alias("seeds")).where(f"seeds >= {LEAST_SEEDS}"), "patterns")
    candidates = found.where("size(codes) > 0").select(F.explode("codes").alias("s")).select("s.instance", F.explode("s.patterns").alias("pattern")).distinct()
    edges = work.keep(candidates.join(strong.select("pattern"), "pattern"), "edges")
    none = F.array().cast("array<struct<start:int,kind:int,stop:int,value:string>>")
    if edges.isEmpty():
        return found.select("doc_id", "base", none.alias("found"))

    # a seed is believed wholly; a pattern is worth the belief in its instances, one doubt added
    scores = edges.select("instance").distinct().withColumn("belief", F.lit(0.0))
    for step in range(ROUNDS):
        inside = edges.join(scores, "instance").groupBy("pattern").agg(F.sum("belief").alias("belief"), F.count("*").alias("n"))
        worth = strong.join(inside, "pattern", "left").select("pattern", ((F.col("seeds") + F.coalesce("belief", F.lit(0.0))) / (F.col("seeds") + F.coalesce("n", F.lit(0)) + 1)).alias("worth"))
        worth = work.keep(worth, f"worth{step}")
        scores = edges.join(worth, "pattern").groupBy("instance").agg((1 - F.product(1 - F.col("worth"))).alias("belief"))
        scores = work.keep(scores, f"scores{step}")
    good = edges.join(worth.where(f"worth >= {CONFIDENT}").select("pattern"), "pattern").join(scores.where(f"belief >= {CONFIDENT}").select("instance"), "instance")
    good = work.keep(good.select("pattern", "instance").distinct(), "good")

    # documents are joined through the pairs of pattern and value that their codes have; those without codes are not
    row = F.monotonically_increasing_id()
    table = work.keep(found.withColumn("row", row).drop("seeds"), "rows")
    have = table.where("size(codes) > 0").select("row", F.explode("codes").alias("x")).select("row", "x", F.col("x.instance").alias("instance"), F.explode("x.patterns").alias("pattern"))
    hits = have.join(good, ["pattern", "instance"]).select("row", F.expr("struct(x.start, x.kind, x.stop, x.value)").alias("x")).groupBy("row").agg(F.array_sort(F.collect_set("x")).alias("found"))
    joined = table.join(hits, "row", "left")
    return joined.select("doc_id", "base", F.coalesce("found", none).alias("found"))


def report(found: DataFrame) -> DataFrame:
    """doc_id, the counts and hash of the base spans, and all spans."""
    both = found.withColumn("every", F.array_sort(F.concat("base", "found")))
    count = lambda k: F.expr(f"cast(size(filter(base, x -> x.kind = {k})) as long)")
    return both.select(
        "doc_id",
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(4)),
        F.sha2(F.array_join(F.expr(f"transform(base, x -> {_name()})"), ","), 256).alias("base_sha256"),
        F.array_join(F.expr(f"transform(every, x -> {_name()})"), ",").alias("spans"),
    )
