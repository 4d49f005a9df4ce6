"""Archive manifests: safety, folders, totals, names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ENTRY_BYTES, RATIO = 128 * 1024 * 1024, 300
ARCHIVE_ENTRIES, ARCHIVE_BYTES = 4000, 512 * 1024 * 1024
BUILD_SOURCES, BUILD_BYTES = 500, 2 * 1024 * 1024 * 1024


def entry_safety(entries: DataFrame) -> DataFrame:
    """Each entry with ``safe``: its size and ratio are within bounds."""
    fine = F.when(F.col("size") > ENTRY_BYTES, False).when(F.col("compressed") <= 0, F.col("size") == 0).otherwise(F.expr("size div compressed") <= RATIO)
    return entries.withColumn("safe", fine)


def archive_safety(entries: DataFrame) -> DataFrame:
    """archive, n_entries, n_refused, bytes, accepted."""
    e = entry_safety(entries)
    out = e.groupBy("archive").agg(F.count("*").alias("n_entries"), F.count_if(~F.col("safe")).alias("n_refused"), F.coalesce(F.sum(F.when(F.col("safe"), F.col("size"))), F.lit(0)).alias("bytes"))
    return out.withColumn("accepted", (F.col("n_entries") <= ARCHIVE_ENTRIES) & (F.col("bytes") <= ARCHIVE_BYTES))


def folder_rollup(entries: DataFrame) -> DataFrame:
    """Every folder of every archive: bytes and files below it, and its direct children."""
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    e = entries.select("archive", "size", parts.alias("parts")).where(F.size("parts") > 0)
    up = e.select("archive", "size", "parts", F.explode(F.sequence(F.lit(0), F.size("parts") - 1)).alias("depth"))
    child = F.when(F.col("depth") == F.size("parts") - 1, F.concat(F.lit("f:"), F.element_at("parts", F.col("depth") + 1))).otherwise(F.concat(F.lit("d:"), F.element_at("parts", F.col("depth") + 1)))
    flat = up.select("archive", F.expr("array_join(slice(parts, 1, depth), '/')").alias("folder"), child.alias("child"), "size")
    by_child = flat.groupBy("archive", "folder", "child").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    return by_child.groupBy("archive", "folder").agg(F.sum("size").alias("bytes"), F.sum("n").alias("n_files"), F.count("*").alias("n_children"))


def running_totals(entries: DataFrame, limit: int) -> DataFrame:
    """Entries of each archive while their running size stays within ``limit``."""
    upto = Window.partitionBy("archive").orderBy("entry_no").rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("running", F.sum("size").over(upto)).where(F.col("running") <= limit)


def build_plan(entries: DataFrame, sources: int = BUILD_SOURCES, limit: int = BUILD_BYTES) -> DataFrame:
    """Every entry with its running size, ``taken`` and, where it is not, the reason: a build beyond a limit is refused as a whole."""
    own = Window.partitionBy("archive")
    upto = own.orderBy("entry_no").rowsBetween(Window.unboundedPreceding, 0)
    reason = F.when(F.count("*").over(own) > sources, "too many sources").when(F.sum("size").over(own) > limit, "too many bytes")
    return entries.withColumns({"running": F.sum("size").over(upto), "reason": reason}).withColumn("taken", F.col("reason").isNull())


IMPORTABLE = ("pdf", "text", "image")


def totals(entries: DataFrame) -> DataFrame:
    """archive, n_files, n_importable, bytes."""
    from pagewright.functions.text import entry_kind

    e = entries.withColumn("kind", entry_kind(F.col("path")))
    return e.groupBy("archive").agg(F.count("*").alias("n_files"), F.count_if(F.col("kind").isin(*IMPORTABLE)).alias("n_importable"), F.sum("size").alias("bytes"))


def listing(entries: DataFrame) -> DataFrame:
    """archive, folder, place, name, is_folder, bytes, n_children: what every folder shows, folders first, then by name."""
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    e = entries.select("archive", "size", parts.alias("parts")).where(F.size("parts") > 0)
    up = e.select("archive", "size", "parts", F.explode(F.sequence(F.lit(0), F.size("parts") - 1)).alias("depth"))
    last = F.col("depth") == F.size("parts") - 1
    below = F.when(~last, F.concat(F.element_at("parts", F.col("depth") + 2), F.when(F.col("depth") == F.size("parts") - 2, "\u0000f").otherwise("\u0000d")))
    flat = up.select("archive", F.expr("array_join(slice(parts, 1, depth), '/')").alias("folder"), F.element_at("parts", F.col("depth") + 1).alias("name"), (~last).alias("is_folder"), "size", below.alias("below"))
    one = flat.groupBy("archive", "folder", "name", "is_folder", "below").agg(F.sum("size").alias("size"))
    rows = one.groupBy("archive", "folder", "name", "is_folder").agg(F.sum("size").alias("bytes"), F.count("below").alias("n_children"))
    order = Window.partitionBy("archive", "folder").orderBy(F.desc("is_folder"), F.lower("name"), "name")
    return rows.withColumn("place", F.row_number().over(order))


def unique_names(entries: DataFrame) -> DataFrame:
    """``entries`` (archive, entry_no, name) with ``unique``: a name that is taken, letter case aside, gets the next free number.

    Names can only collide within one stem without numbers, so each such group of an archive is gone through on its own.
    Numbers of a stem are only ever taken, so the search for a free one goes on where the last one ended.
    """
    dot = F.length(F.regexp_extract("name", r"^(.+)\.[^.]*$", 1))
    e = entries.select("archive", "entry_no", "name").withColumn("stem", F.when(dot > 0, F.expr("substring(name, 1, length(regexp_extract(name, r'^(.+)\\.[^.]*$', 1)))")).otherwise(F.col("name")))
    e = e.withColumn("ext", F.expr("substring(name, length(stem) + 1)")).withColumns({"low_stem": F.lower("stem"), "low_ext": F.lower("ext")})
    base = F.concat(F.regexp_replace("low_stem", r"( \(\d+\))+$", ""), F.lit("\u0000"), F.col("low_ext"))

    def numbered(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("entry_no", kind="stable")
        taken, after, out = set(), {}, []
        for name, stem, ext, low_stem, low_ext in zip(group["name"], group["stem"], group["ext"], group["low_stem"], group["low_ext"]):
            low = low_stem + low_ext
            if low in taken:
                n = after.get((low_stem, low_ext), 2)
                while (low := f"{low_stem} ({n}){low_ext}") in taken:
                    n += 1
                after[low_stem, low_ext] = n + 1
                name = f"{stem} ({n}){ext}"
            taken.add(low)
            out.append(name)
        return group[["archive", "entry_no", "name"]].assign(unique=out)

    kinds = {f.name: f.dataType.simpleString() for f in e.schema}
    return e.groupBy("archive", base.alias("base")).applyInPandas(numbered, f"archive {kinds['archive']}, entry_no {kinds['entry_no']}, name string, unique string")


def import_outcomes(entries: DataFrame, stop_after: int | None = None) -> DataFrame:
    """archive, entry_no, status, reason: imported, unsupported, unreadable, or stopped beyond ``stop_after`` entries of an archive."""
    from pagewright.functions.text import entry_kind

    place = F.row_number().over(Window.partitionBy("archive").orderBy("entry_no"))
    e = entry_safety(entries).withColumns({"kind": entry_kind(F.col("path")), "place": place})
    stopped = F.col("place") > stop_after if stop_after is not None else F.lit(False)
    known = F.col("kind").isin(*IMPORTABLE)
    status = F.when(stopped, "stopped").when(~known, "unsupported").when(~F.col("safe"), "unreadable").otherwise("imported")
    reason = (
        F.when(stopped, "You stopped the import before this file.")
        .when(F.col("kind") == "archive", "An archive inside an archive is not opened.")
        .when(~known, "Only PDFs, Word files, text files and pictures are imported.")
        .when(~F.col("safe"), "The entry is too large.")
    )
    return e.select("archive", "entry_no", status.alias("status"), reason.alias("reason"))


def import_report(outcomes: DataFrame) -> DataFrame:
    """archive, a count for each status, is_complete: all entries arrived."""
    n = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    out = outcomes.groupBy("archive").agg(*map(n, ("imported", "unsupported", "unreadable", "stopped")), F.count("*").alias("n"))
    return out.withColumn("is_complete", F.col("n_imported") == F.col("n")).drop("n")


MERGED = 200


def merge_plan(sources: DataFrame, most: int = MERGED) -> DataFrame:
    """bundle, place, source_no, page_no, truncated of ``sources`` (bundle, source_no, page_no): their pages one after the
    other up to ``most``, which a bundle that reaches it counts as cut at; a bundle of one source is no merge."""
    own = Window.partitionBy("bundle")
    place = F.row_number().over(own.orderBy("source_no", "page_no"))
    several = F.min("source_no").over(own) < F.max("source_no").over(own)
    rows = sources.withColumns({"place": place, "several": several, "truncated": F.count("*").over(own) >= most})
    return rows.where(F.col("several") & (F.col("place") <= most)).select("bundle", "place", "source_no", "page_no", "truncated")
