"""Web archives: WARC records written from pages, read back, and records in segments put together again.

A response is an HTTP message in chunked transfer framing. A block longer than ``SEGMENT_BYTES`` is cut into segments:
the first stays a response, the others are continuation records that name it as their origin. So a file of
``FILE_RECORDS`` records has a size bound, whatever the pages are. Segments are grouped by origin, put in the order of
their numbers, held against the total length, and their chunks are decoded. Records that aren't cut need no shuffle.

Of equal payloads of ``LEAST_REVISIT`` bytes or more that of the smallest page id is written, the others are revisits
of it. A payload of so many pages that it holds one in ``HOT_SHARE`` of all rows is looked up in a broadcast table,
which has at most that many rows; the others are joined.

Defined cases: a null html is an empty payload; a null url leaves its field out; a null page id sorts after all others,
and where all are null each is a response; a page that is there several times with one payload is written as often, and
is a revisit only of a smaller id; an empty table gives no records; extra columns are ignored. When reading, a record
that ends too early, lacks a segment, has another length than it says or broken chunks has no payload and a ``problem``.
"""

from __future__ import annotations

import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import Workspace

LEAST_REVISIT = 100
SEGMENT_BYTES, CHUNK_BYTES, FILE_RECORDS = 8192, 4096, 4096
HOT_SHARE = 200
BATCH_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
READ = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, segment_origin string, segment_number long, segment_total long, block binary, problem string"
PAYLOADS = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, n_segments long, problem string"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """What the chunks hold; ValueError where the framing is broken or does not end."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunks without an end")
        size = body[at:end].split(b";")[0].strip()
        if not size or size.strip(b"0123456789abcdefABCDEF"):
            raise ValueError("chunk size")
        n, at = int(size, 16), end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk length")
        out.append(body[at : at + n])
        at += n + 2


def _fields(pairs) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in pairs if v is not None) + b"\r\n"


def _address(url: str | None) -> str | None:
    """A url as one line of a header."""
    return None if url is None else "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record_id(page_id, copy: int, digest: str) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}:{copy}:{digest[:16]}>"


def records_of(page_id, url, payload: bytes, digest: str, first, copy: int, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES):
    """(kind, record) for one page; ``first`` is the page of which it is a revisit. Records lack their last line end."""
    own, address = record_id(page_id, copy, digest), _address(url)
    common = [("WARC-Target-URI", address), ("WARC-Date", DATE)]
    http = ("Content-Type", "application/http; msgtype=response")
    if first is not None:
        block = _HTTP + b"Content-Length: %d\r\n\r\n" % len(payload)
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, ("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(first, 0, digest)), ("WARC-Payload-Digest", f"sha256:{digest}"), http]
        yield "records", _fields([*fields, ("Content-Length", len(block))]) + block + b"\r\n"
        return
    block = _HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", f"sha256:{digest}"), http]
    if len(block) <= segment_bytes:
        yield "records", _fields([*fields, ("Content-Length", len(block))]) + block + b"\r\n"
        return
    cuts = range(0, len(block), segment_bytes)
    for k, at in enumerate(cuts, 1):
        part = block[at : at + segment_bytes]
        if k > 1:
            fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own[:-1]}:{k}>"), *common, ("WARC-Segment-Origin-ID", own)]
            if k == len(cuts):
                fields.append(("WARC-Segment-Total-Length", len(block)))
        yield "segments", _fields([*fields, ("WARC-Segment-Number", k), ("Content-Length", len(part))]) + part + b"\r\n"


def with_firsts(pages: DataFrame, work: Workspace) -> DataFrame:
    """page_id, url, payload, digest, ``first`` (the page of which a row is a revisit) and ``copy`` (its number among equal rows)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= LEAST_REVISIT
    shared = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    shared = work.keep(shared, "shared")
    total = pages.count()
    hot = shared.where(F.col("n") * HOT_SHARE >= total).select("digest", F.col("least").alias("hot"))  # at most HOT_SHARE rows
    rest = shared.where(F.col("n") * HOT_SHARE < total).select(F.col("digest").alias("key"), "least")
    rows = rows.join(F.broadcast(hot), "digest", "left")
    page = F.concat(F.lit("page "), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))
    rows = rows.withColumn("key", F.when(large & F.col("hot").isNull(), F.col("digest")).otherwise(page)).join(rest, "key", "left")
    least = F.coalesce("hot", "least")
    rows = rows.withColumn("first", F.when(F.coalesce(F.col("page_id") > least, least.isNotNull()), least))
    # the rows of one page and payload are together by the key already
    copy = F.row_number().over(Window.partitionBy("key", "page_id", "digest").orderBy("url"))
    return rows.select("page_id", "url", "payload", "digest", "first", (copy - 1).alias("copy"))


def write(pages: DataFrame, work: Workspace, name: str = "archives", segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> tuple[str, str]:
    """Writes archives of ``pages(page_id, url, html)``; the folders with the whole records and with those in segments."""

    def run(batches):
        for batch in batches:
            kinds, records, held = [], [], 0
            for page_id, url, payload, digest, first, copy in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "payload", "digest", "first", "copy"))):
                for kind, record in records_of(page_id, url, payload, digest, first, copy, segment_bytes, chunk_bytes):
                    kinds.append(kind)
                    records.append(record)
                    held += len(record)
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(records, pa.binary())], ["kind", "record"])
                    kinds, records, held = [], [], 0
            if records:
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(records, pa.binary())], ["kind", "record"])

    path = f"{work.root}/{name}"
    # a record ends with two line ends, of which the writer adds one
    records = with_firsts(pages, work).mapInArrow(run, "kind string, record binary").select("kind", F.col("record").cast("string").alias("record"))
    records.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).partitionBy("kind").text(path)
    return f"{path}/kind=records", f"{path}/kind=segments"


def parse(stream):
    """The records of an uncompressed archive: (fields by lower-cased name, block, problem)."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        fields = {}
        if not line.startswith(b"WARC/"):
            yield fields, None, "no record"
            return
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        length = fields.get("content-length", "")
        if not length.isdecimal():
            yield fields, None, "no length"
            return
        block = stream.read(int(length))
        if len(block) < int(length):
            yield fields, None, "ends too early"
            return
        yield fields, block, None


def _number(value):
    return int(value) if value and value.isdecimal() else None


def read(spark: SparkSession, *paths: str) -> DataFrame:
    """One row for each record of all archives below ``paths``, compressed or not."""

    def run(batches):
        schema = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for n, t in (c.split() for c in READ.split(", "))])
        rows, held = [], 0
        for batch in batches:
            for content in batch["content"]:
                data = pa.py_buffer(content.as_buffer()) if content.is_valid else pa.py_buffer(b"")
                stream = io.BytesIO(data)
                if bytes(data[:2]) == b"\x1f\x8b":
                    stream = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 16)
                for f, block, problem in _safely(parse(stream)):
                    digest = f.get("warc-payload-digest")
                    rows.append((f.get("warc-record-id"), f.get("warc-type"), f.get("warc-target-uri"), f.get("warc-refers-to"), digest, f.get("warc-segment-origin-id"), _number(f.get("warc-segment-number")), _number(f.get("warc-segment-total-length")), block, problem))
                    held += len(block or b"") + 500
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    there = [p for p in paths if _exists(spark, p)]
    if not there:
        return spark.createDataFrame([], READ)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(there)
    return files.select("content").mapInArrow(run, READ)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def _safely(records):
    """``records``, with a last one for what can't be decompressed."""
    try:
        yield from records
    except (EOFError, OSError) as error:
        yield {}, None, f"compression: {type(error).__name__}"


def payload_of(block: bytes) -> tuple[bytes, int | None]:
    """The payload of an HTTP message and the length that it states; ValueError where the framing is broken."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
    stated = fields.get(b"content-length", b"")
    if fields.get(b"transfer-encoding", b"").lower() == b"chunked":
        body = dechunked(body)
    return body, int(stated) if stated.isdigit() else None


def _assembled(parts: list[dict], total: int | None) -> bytes:
    """The block that the segments make; ValueError unless all are there, once, with the stated length."""
    if [p["number"] for p in parts] != list(range(1, len(parts) + 1)):
        raise ValueError("segment missing or repeated")
    if total is None:
        raise ValueError("last segment missing")
    block = b"".join(p["block"] or b"" for p in parts)
    if len(block) != total:
        raise ValueError("total length")
    return block


def payloads(records: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """One row for each response and revisit of ``read``'s rows, with its payload, and for each problem.

    ``segments`` has the archives with records in segments where those are apart, so that the others are read once.
    """
    whole = records.where("segment_number is null and segment_origin is null")
    cut = (records if segments is None else segments).where("segment_number is not null or segment_origin is not null")
    first = lambda c: F.max(F.when(F.col("segment_number") == 1, F.col(c))).alias(c)
    groups = cut.groupBy(F.coalesce("segment_origin", "record_id").alias("record_id")).agg(
        *map(first, ("record_type", "target_uri", "refers_to", "payload_digest")),
        F.max("segment_total").alias("total"),
        F.array_sort(F.collect_list(F.struct(F.col("segment_number").alias("number"), "block"))).alias("parts"),
        F.max("problem").alias("problem"),
    )
    names = ["record_id", "record_type", "target_uri", "refers_to", "payload_digest", "problem"]
    no_parts = F.lit(None).cast("array<struct<number:bigint,block:binary>>")
    every = whole.select(*names, "block", F.lit(None).cast("long").alias("total"), no_parts.alias("parts")).unionByName(groups.select(*names, F.lit(None).cast("binary").alias("block"), "total", "parts"))

    def run(batches):
        schema = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for n, t in (c.split() for c in PAYLOADS.split(", "))])
        for batch in batches:
            step = max(1, len(batch) * BATCH_BYTES // max(1, batch.nbytes))
            for low in range(0, len(batch), step):
                yield pa.RecordBatch.from_pylist([_decoded(r) for r in batch.slice(low, step).to_pylist()], schema)

    return every.where("record_type in ('response', 'revisit') or problem is not null or record_type is null").mapInArrow(run, PAYLOADS)


def _decoded(r: dict) -> dict:
    out = {"record_id": r["record_id"], "record_type": r["record_type"], "target_uri": r["target_uri"], "refers_to": r["refers_to"], "n_segments": len(r["parts"]) if r["parts"] else 1, "problem": r["problem"]}
    said = (r["payload_digest"] or "").removeprefix("sha256:") or None
    if out["problem"]:
        return out | {"payload_digest": said}
    try:
        block = _assembled(r["parts"], r["total"]) if r["parts"] else r["block"] or b""
        payload, length = payload_of(block)
        if r["record_type"] == "revisit":
            return out | {"payload_digest": said, "payload_bytes": length}
        digest = hashlib.sha256(payload).hexdigest()
        if said and said != digest:
            raise ValueError("payload digest")
        if length is not None and length != len(payload):
            raise ValueError("content length")
        return out | {"payload_digest": digest, "payload_bytes": len(payload), "payload": payload}
    except ValueError as error:
        return out | {"payload_digest": said, "problem": str(error)}


def catalogue(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of archives that ``write`` has written."""
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+):", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes an archive of the pages and describes what is read back from it."""
    spark = pages.sparkSession
    whole, cut = write(pages, Workspace(spark, "warc"))
    return catalogue(payloads(read(spark, whole), read(spark, cut)))
