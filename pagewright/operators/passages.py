"""Sentence and line passages with exact offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import offsets, without_marks

LEAST, LONGEST = 12, 220
_BREAK = r"(?<=[.!?;])\s+|\n+"


def passages(pages: DataFrame, longest: int | None = LONGEST) -> DataFrame:
    """doc_id, page_index, start, stop, text: spans between sentence ends or line breaks, trimmed, of ``LEAST`` characters
    at least; a span above ``longest`` is cut at its last blank before that, or there (None: not cut)."""
    # a mark before and after each break keeps the break's own length for the offsets
    marked = F.split(F.regexp_replace(without_marks(F.col("text")), f"({_BREAK})", "\u0001$1\u0002"), "[\u0001\u0002]", -1)
    spans = pages.select("doc_id", "page_index", marked.alias("part"))
    if longest:
        spans = spans.select("doc_id", "page_index", F.expr(f"flatten(transform(part, x -> if(length(x) <= {longest}, array(x), regexp_extract_all(x, r'(?s).{{1,{longest}}}(?= |\\z)|.{{{longest}}}', 0))))").alias("part"))
    at = F.expr(f"zip_with(part, {offsets('part')}, (x, n) -> struct(x as span, n as at))")
    rows = spans.select("doc_id", "page_index", F.explode(at).alias("p")).select("doc_id", "page_index", "p.*")
    text = F.regexp_replace("span", r"^\s+|\s+$", "")
    lead = F.length("span") - F.length(F.regexp_replace("span", r"^\s+", ""))
    rows = rows.select("doc_id", "page_index", (F.col("at") + lead).alias("start"), text.alias("text"))
    return rows.where(F.length("text") >= LEAST).select("doc_id", "page_index", "start", (F.col("start") + F.length("text")).alias("stop"), "text")
