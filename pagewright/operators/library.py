"""Library maintenance as set-based edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last change of each key; ``order`` breaks ties to the end."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)))
    return changes.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def renumber(pages: DataFrame, *order: str) -> DataFrame:
    """Pages 0..n-1 in the order of the given columns."""
    return pages.withColumn("page_index", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1)


def append_pages(pages: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` (doc_id, text, seq) after the pages of its documents."""
    both = pages.select("doc_id", F.lit(0).alias("late"), F.col("page_index").cast("long").alias("at"), "text").unionByName(new.select("doc_id", F.lit(1).alias("late"), F.col("seq").cast("long").alias("at"), "text"))
    return renumber(both, "late", "at").select("doc_id", "page_index", "text")


def delete_pages(pages: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the pages in ``gone`` (doc_id, page_index), but a document keeps all pages where none would be left."""
    marked = pages.join(gone.select("doc_id", "page_index").distinct().withColumn("gone", F.lit(True)), ["doc_id", "page_index"], "left")
    marked = marked.withColumn("left", F.sum(F.when(F.col("gone").isNull(), 1).otherwise(0)).over(Window.partitionBy("doc_id")))
    return renumber(marked.where("gone is null or left = 0").withColumnRenamed("page_index", "was"), "was").select("doc_id", "page_index", "text")


def reorder_pages(pages: DataFrame, orders: DataFrame) -> DataFrame:
    """Pages by ``orders`` (doc_id, page_order); an order that is no permutation of the pages changes nothing."""
    held = pages.groupBy("doc_id").agg(F.sort_array(F.collect_set("page_index")).alias("held"))
    good = orders.join(held, "doc_id").where(F.sort_array("page_order") == F.col("held"))
    at = good.select("doc_id", F.posexplode("page_order").alias("to", "page_index"))
    return pages.join(at, ["doc_id", "page_index"], "left").select("doc_id", F.coalesce("to", "page_index").alias("page_index"), "text")


def document_status(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """One status a document: archives are complete, others pending before failed before completed."""
    have = lambda s: F.coalesce(F.bool_or(F.col("ocr_status") == s), F.lit(False)).alias(s)
    by = pages.groupBy("doc_id").agg(*(have(s) for s in ("running", "pending", "failed")), F.bool_or(F.col("kind") == "image").alias("images"))
    status: Column = (
        F.when(F.col("doc_source") == "archive", "completed")
        .when(F.col("images").isNull(), "pending")
        .when(~F.col("images"), "completed")
        .when(F.col("running"), "running")
        .when(F.col("pending"), "pending")
        .when(F.col("failed"), "failed")
        .otherwise("completed")
    )
    return docs.join(by, "doc_id", "left").select("doc_id", status.alias("status"))


SOURCES, STATUSES, PAGE_KINDS = ("scanned", "imported", "created", "archive"), ("pending", "running", "completed", "failed"), ("scanned", "imported", "text")
TITLE, TAGS, TAG = 120, 12, 32


def decoded(value: Column, known: tuple[str, ...], default: str) -> Column:
    """An enum by its name; a name that isn't known, or none, is the default."""
    return F.when(value.isin(*known), value).otherwise(default)


def replace_pages(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """Pages in ``edits`` (doc_id, page_index) get a new picture: their text goes and they wait for recognition."""
    marked = pages.join(edits.select("doc_id", "page_index").distinct().withColumn("_new", F.lit(True)), ["doc_id", "page_index"], "left")
    new = F.col("_new").isNotNull()
    return marked.withColumns({"text": F.when(new, "").otherwise(F.col("text")), "ocr_status": F.when(new, "pending").otherwise(F.col("ocr_status"))}).drop("_new")


def edit_texts(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """``pages`` with the texts of ``edits`` (doc_id, page_index, new_text, ts), the last for a page: completed, and ``edited_at`` set."""
    last = edits.groupBy("doc_id", "page_index").agg(F.max(F.struct("ts", "new_text")).alias("_e"))
    marked = pages.join(last, ["doc_id", "page_index"], "left")
    new = F.col("_e").isNotNull()
    columns = {"text": F.when(new, F.col("_e.new_text")).otherwise(F.col("text")), "ocr_status": F.when(new, "completed").otherwise(F.col("ocr_status")), "edited_at": F.col("_e.ts")}
    return marked.withColumns(columns).drop("_e")


def touched(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``docs`` (with updated_at, pdf_path) after page edits (doc_id, ts): newer, and without the PDF made before."""
    last = edits.groupBy("doc_id").agg(F.max("ts").alias("_ts"))
    both = docs.join(last, "doc_id", "left")
    return both.withColumns({"updated_at": F.greatest("updated_at", "_ts"), "pdf_path": F.when(F.col("_ts").isNull(), F.col("pdf_path"))}).drop("_ts")


def edit_documents(docs: DataFrame, renames: DataFrame, toggles: DataFrame, tags: DataFrame) -> DataFrame:
    """doc_id, title, is_favorite, tags, updated_at after edits of each kind (doc_id, ts, and new_title or new_tags).

    The last rename and the last tags count; a rename to the title that is there changes nothing; an odd number of
    toggles turns the favourite, which makes no document newer.
    """
    named = renames.groupBy("doc_id").agg(F.max(F.struct("ts", "new_title")).alias("_r"))
    turned = toggles.groupBy("doc_id").agg(F.count("*").alias("_n"))
    tagged = tags.groupBy("doc_id").agg(F.max(F.struct("ts", "new_tags")).alias("_t"))
    rows = docs.join(named, "doc_id", "left").join(turned, "doc_id", "left").join(tagged, "doc_id", "left")
    renamed = F.col("_r").isNotNull() & (F.col("_r.new_title") != F.col("title"))
    return rows.select(
        "doc_id",
        F.when(renamed, F.col("_r.new_title")).otherwise(F.col("title")).alias("title"),
        F.when(F.col("_n") % 2 == 1, ~F.col("is_favorite")).otherwise(F.col("is_favorite")).alias("is_favorite"),
        F.coalesce("_t.new_tags", "tags").alias("tags"),
        F.greatest("updated_at", F.when(renamed, F.col("_r.ts")), F.col("_t.ts")).alias("updated_at"),
    )


def awaiting(pages: DataFrame, force: bool = False) -> DataFrame:
    """Pages with a picture that wait for recognition or failed; with ``force`` all that nobody has edited."""
    image = pages.where("kind = 'image'")
    return image.where("not edited") if force else image.where("ocr_status in ('pending', 'failed')")


def apply_recognition(pages: DataFrame, results: DataFrame) -> DataFrame:
    """Pages after ``results`` (doc_id, page_index, new_text, ok) of pages that wait: the text, or failed with the old text."""
    r = results.select("doc_id", "page_index", F.struct("ok", "new_text").alias("_r"))
    rows = pages.join(r, ["doc_id", "page_index"], "left")
    hit = F.col("_r").isNotNull() & (F.col("kind") == "image") & F.col("ocr_status").isin("pending", "failed")
    status = F.when(hit & F.col("_r.ok"), "completed").when(hit, "failed").otherwise(F.col("ocr_status"))
    return rows.withColumns({"text": F.when(hit & F.col("_r.ok"), F.col("_r.new_text")).otherwise(F.col("text")), "ocr_status": status, "tried": hit}).drop("_r")


def orphans(stored: DataFrame, referenced: DataFrame) -> DataFrame:
    """Stored pictures (image_name) that no page refers to."""
    return stored.select("image_name").distinct().join(referenced.select("image_name"), "image_name", "left_anti")


def new_documents(asked: DataFrame) -> DataFrame:
    """doc_id, title, page_index, image_path, kind, ocr_status of ``asked`` (doc_id, title, paths): one pending page for each
    picture, or one empty text page that is complete; a title is cut to 120 characters, an empty one is Untitled."""
    title = F.substring(F.regexp_replace(F.coalesce("title", F.lit("")), r"^\s+|\s+$", ""), 1, TITLE)
    rows = asked.select("doc_id", F.when(title == "", "Untitled").otherwise(title).alias("title"), F.posexplode_outer("paths").alias("page_index", "image_path"))
    written = F.col("image_path").isNull()
    return rows.select("doc_id", "title", F.coalesce("page_index", F.lit(0)).alias("page_index"), "image_path", F.when(written, "text").otherwise("image").alias("kind"), F.when(written, "completed").otherwise("pending").alias("ocr_status"))


def title_verdict(title: Column) -> Column:
    n = F.length(F.regexp_replace(F.coalesce(title, F.lit("")), r"^\s+|\s+$", ""))
    return F.when(n == 0, "empty").when(n > TITLE, "too_long").otherwise("ok")


def tags_verdict(tags: Column) -> Column:
    return F.when(F.size(tags) > TAGS, "too_many").when(F.exists(tags, lambda t: F.length(t) > TAG), "too_long").otherwise("ok")
