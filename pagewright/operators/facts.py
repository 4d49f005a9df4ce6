"""Facts by their shape, per page: one pass over the pages for all kinds, with offsets in code points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import lexicon as L
from pagewright.functions.text import offsets, without_marks

HEADING = r"^#{1,3}\s+"
TOP = 15
MARKS = "€£$¥₹+"


#: what every text with a fact of a kind holds; others are not searched for it
_ANCHORS = {
    "date": "[0-9][./-][0-9]", "written_date": "(?i)(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)", "amount": "(?i)[€£$¥₹]|[0-9][ ,.][0-9]|(?:eur|usd|gbp|pkr|inr|chf)", "email": "@",
    "phone": r"[0-9][0-9\s().-]{7}", "identifier": "[0-9]", "name": r"[A-Z][a-z]+[ \t]+[A-Z][a-z]", "street": r"[A-Z][a-zA-Z]+\s", "postcode": "[A-Z][0-9]",
}


def _names(values: Column) -> Column:
    words = lambda v: F.split(F.lower(v), r"\s+")
    return F.filter(values, lambda v: ~F.exists(words(v), lambda w: w.isin(*L.FURNITURE)) & ~F.element_at(words(v), -1).isin(*L.ORGANISATIONS))


def _searched(kind: str, text: Column) -> Column:
    """A name in a heading is none: its line is blanked, at its length."""
    if kind != "name":
        return text
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.when(x.rlike(HEADING), F.repeat(F.lit(" "), F.length(x))).otherwise(x))
    return F.when(F.contains(text, F.lit("#")), F.array_join(lines, "\n")).otherwise(text)


def values(kind: str, text: Column) -> Column:
    found = F.regexp_extract_all(_searched(kind, text), F.lit(L.java(L.SHAPES[kind])), F.lit(0))
    return _names(found) if kind == "name" else found


def has(intent: str, text: Column) -> Column:
    """Whether the text holds a fact of that intent."""
    if intent == "person":
        return F.size(values("name", text)) > 0
    shaped = reduce(lambda a, b: a | b, (text.rlike(L.java(L.SHAPES[k])) for k in L.ANSWERS[intent]))
    # of these intents every shape has a digit or an @, and most texts have neither
    return text.rlike("[0-9@]") & shaped if intent in ("date", "amount", "contact", "identifier") else shaped


def satisfies(intent: Column, text: Column) -> Column:
    """Whether the text answers the intent by its shape; places and general questions never do."""
    out = F.lit(False)
    for name in L.SHAPED:
        out = F.when(intent == name, has(name, text)).otherwise(out)
    return out


def facts(pages: DataFrame, kinds=("date", "email", "amount")) -> DataFrame:
    """One row for each match: doc_id, page_index, kind, value."""

    def found(kind: str) -> Column:
        return F.transform(values(kind, F.col("text")), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    return pages.select("doc_id", "page_index", F.explode(F.concat(*map(found, kinds))).alias("f")).select("doc_id", "page_index", "f.kind", "f.value")


def _parts(kind: str) -> Column:
    """The text split at marks around the matches, so that odd parts are the matches."""
    marked = F.regexp_replace(_searched(kind, without_marks(F.col("text"))), f"({L.java(L.SHAPES[kind])})", "\u0001$1\u0002")
    return F.when(F.col("text").rlike(_ANCHORS[kind]), F.split(marked, "[\u0001\u0002]", -1)).otherwise(F.array("text")).alias(kind)


def _places(intent: str, kind: str) -> Column:
    at = F.filter(F.expr(f"zip_with({kind}, {offsets(kind)}, (x, n) -> struct('{intent}' as intent, '{kind}' as kind, n as start, x as value))"), lambda m, i: i % 2 == 1)
    if kind == "name":
        at = F.filter(at, lambda m: F.size(_names(F.array(m["value"]))) > 0)
    return F.when(F.size(kind) > 1, at).otherwise(F.array().cast("array<struct<intent:string,kind:string,start:int,value:string>>"))


def located(pages: DataFrame, intents=tuple(L.ANSWERS)) -> DataFrame:
    """doc_id, page_index, intent, kind, start, value of every match."""
    kinds = [(i, k) for i in intents for k in L.ANSWERS[i]]
    cut = pages.select("doc_id", "page_index", *(_parts(k) for _, k in kinds))
    every = F.concat(*(_places(i, k) for i, k in kinds))
    return cut.select("doc_id", "page_index", F.explode(every).alias("f")).select("doc_id", "page_index", "f.*")


def tidy(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, r"\s+", " "), r"^[\s.,;:*_]+|[\s.,;:*_]+$", "")


def fingerprint(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(value), r"\s+", " "), rf"^[^A-Za-z0-9_{MARKS}]+|[^A-Za-z0-9_]+$", "")


def top(pages: DataFrame, most: int = TOP) -> DataFrame:
    """The first ``most`` different values of each document and intent, in document order: rk from 1."""
    rows = located(pages).withColumn("value", tidy(F.col("value"))).withColumn("key", fingerprint(F.col("value"))).where("key <> ''")
    first = rows.groupBy("doc_id", "intent", "key").agg(F.min(F.struct("page_index", "start", "value")).alias("f"))
    order = Window.partitionBy("doc_id", "intent").orderBy("f")
    return first.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= most).select("doc_id", "intent", "rk", "f.page_index", "f.start", "f.value")


def digest(pages: DataFrame, most: int = 6) -> DataFrame:
    """One row for each document and intent: the first values, joined."""
    rows = top(pages, most).groupBy("doc_id", "intent").agg(F.array_sort(F.collect_list(F.struct("rk", "value"))).alias("v"))
    return rows.select("doc_id", "intent", F.size("v").alias("n"), F.array_join("v.value", " | ").alias("values"))
