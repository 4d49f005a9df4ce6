"""Folders that the driver and every executor can reach."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; only in a local session may that be unset."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="pagewright-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _at(spark, path)
    return files.exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, hidden ones left out; none where it does not exist."""
    files, at = _at(spark, path)
    return sorted(n for n in (s.getPath().getName() for s in files.listStatus(at)) if n[0] not in "._") if files.exists(at) else []


def create(spark: SparkSession, path: str) -> None:
    """Creates an empty file; FileExistsError where it is there already."""
    files, at = _at(spark, path)
    files.mkdirs(at.getParent())
    if not files.createNewFile(at):
        raise FileExistsError(path)


def delete(spark: SparkSession, path: str) -> None:
    files, at = _at(spark, path)
    files.delete(at, True)


#: rows that a Python worker gets at once
RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def kept(spark: SparkSession, rows: DataFrame, name: str, records: int | None = None) -> DataFrame:
    """``rows`` as a written table, which several plans may read; ``records`` are handed to Python at once meanwhile."""
    path, before = folder(spark, name), spark.conf.get(RECORDS)
    if records:
        spark.conf.set(RECORDS, str(min(records, int(before) if int(before) > 0 else records)))
    try:
        rows.write.parquet(path)
    finally:
        if records:
            spark.conf.set(RECORDS, before)
    return spark.read.schema(rows.schema).parquet(path)
