"""Pages put together from recognised fragments with their boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import trimmed

OVERLAP, GAP = 0.4, 1.4


def _flat(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, r"\s+", " "))


def lines(elements: DataFrame) -> DataFrame:
    """doc_id, page_index, block_no, line_no, text, l, t, r, b: lines of ``elements`` (with element_no, null where a line has
    none, and line_text), their words from left to right; a line without words keeps its own text, an empty one goes."""
    word = F.when(F.col("element_no").isNotNull(), F.struct(F.col("l").alias("l"), "element_no", F.col("text").alias("text")))
    rows = elements.groupBy("doc_id", "page_index", "block_no", "line_no").agg(
        F.array_sort(F.collect_list(word)).alias("words"), F.first("line_text").alias("line_text"), F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b")
    )
    text = F.when(F.size("words") == 0, F.col("line_text")).otherwise(F.array_join(F.transform("words", lambda w: w["text"]), " "))
    return rows.select("doc_id", "page_index", "block_no", "line_no", _flat(F.coalesce(text, F.lit(""))).alias("text"), "l", "t", "r", "b").where("text <> ''")


def rows(found: DataFrame) -> DataFrame:
    """doc_id, page_index, rows (array of text, top, bottom from top to bottom): lines whose boxes overlap a row's by
    ``OVERLAP`` of the lower height join it from left to right, and its box grows with them."""
    line = F.struct("t", "l", "block_no", "line_no", "b", "text")
    pages = found.groupBy("doc_id", "page_index").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    one = "struct<l:double,k:int,text:string>"
    fold = f"""aggregate(lines, cast(array() as array<struct<top:double,bottom:double,parts:array<{one}>>>), (a, x) ->
        if(size(a) > 0 and least(element_at(a, -1).bottom, x.b) > greatest(element_at(a, -1).top, x.t) and least(element_at(a, -1).bottom - element_at(a, -1).top, x.b - x.t) > 0
            and (least(element_at(a, -1).bottom, x.b) - greatest(element_at(a, -1).top, x.t)) / least(element_at(a, -1).bottom - element_at(a, -1).top, x.b - x.t) >= {OVERLAP},
        concat(slice(a, 1, size(a) - 1), array(named_struct('top', least(element_at(a, -1).top, x.t), 'bottom', greatest(element_at(a, -1).bottom, x.b),
            'parts', array_append(element_at(a, -1).parts, named_struct('l', x.l, 'k', size(element_at(a, -1).parts), 'text', x.text))))),
        array_append(a, named_struct('top', x.t, 'bottom', x.b, 'parts', array(named_struct('l', x.l, 'k', 0, 'text', x.text))))))"""
    placed = "transform(r, x -> struct(array_join(transform(array_sort(x.parts), p -> p.text), ' ') as text, x.top as top, x.bottom as bottom))"
    return pages.select("doc_id", "page_index", F.expr(fold).alias("r")).select("doc_id", "page_index", F.expr(placed).alias("rows"))


def compose(grouped: DataFrame) -> DataFrame:
    """doc_id, page_index, n_rows, text: rows joined by line breaks, by two where the gap is above ``GAP`` times the median height."""
    middle = F.expr("element_at(array_sort(transform(rows, x -> x.bottom - x.top)), cast(size(rows) div 2 as int) + 1)")
    sized = grouped.withColumn("median", F.when(middle <= 0, 1.0).otherwise(middle))
    text = F.expr(f"array_join(transform(rows, (x, i) -> concat(x.text, if(i = size(rows) - 1, '', if(get(rows, i + 1).top - x.bottom > median * {GAP}, '\\n\\n', '\\n')))), '')")
    return sized.select("doc_id", "page_index", F.size("rows").alias("n_rows"), trimmed(text).alias("text"))
