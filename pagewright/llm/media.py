"""Texts kept as media columns: lossless WebP images in, pixel arrays and features out.

A payload is cut into images of ``SIDE`` rows of ``SIDE`` bytes, three to a pixel as red, green and blue (the last one is
as high as it needs to be), so one step's memory is bounded for any text. The stored form of a text is its list of files.

Defined cases: a null text counts as empty (a payload of 576 bytes of 255); repeated rows are stored each; a null
doc_id stays null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import webp
from .storage import Workspace

UNIT = 576
PAD = 255
SIDE = 96
#: payload bytes decoded together
STEP_BYTES = 24 << 20


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and ``files``: the text's payload as lossless WebP files."""

    def run(batches):
        for batch in batches:
            sizes, images, ends = [], [], []
            for text in batch["text"].cast(pa.large_binary()):
                data = text.as_py() or b""
                sizes.append(len(data))
                total = max(1, -(-len(data) // UNIT)) * UNIT
                payload = np.frombuffer(data + bytes([PAD]) * (total - len(data)), np.uint8)
                images += [payload[i : i + SIDE * SIDE].reshape(-1, SIDE // 3, 3) for i in range(0, total, SIDE * SIDE)]
                ends.append(len(images))
                if len(sizes) >= 1000:
                    yield _stored(batch["doc_id"], sizes, images, ends)
                    batch = batch.slice(len(sizes))
                    sizes, images, ends = [], [], []
            if sizes:
                yield _stored(batch["doc_id"], sizes, images, ends)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_bytes long, files array<binary>")


def _stored(ids, sizes, images, ends):
    written = webp.write_many(images)
    files = [written[a:b] for a, b in zip([0, *ends], ends)]
    return pa.RecordBatch.from_arrays([ids.slice(0, len(sizes)), pa.array(sizes, pa.int64()), pa.array(files, pa.list_(pa.binary()))], ["doc_id", "n_bytes", "files"])


def samples(image: np.ndarray) -> np.ndarray:
    """The bytes that an image holds: red, green and blue of each pixel."""
    return image.astype("<u4").view(np.uint8).reshape(-1, 4)[:, 2::-1].ravel()


def feature(payload: np.ndarray) -> str:
    """Counts of bytes by their upper four bits, and the mean byte in thousandths."""
    return ".".join(map(str, [*np.bincount(payload >> 4, minlength=16).tolist(), int(payload.sum(dtype=np.int64)) * 1000 // len(payload)]))


def read_back(stored: DataFrame, with_pixels: bool = False) -> DataFrame:
    """What the stored files hold: hashes and features of the pixels, and with ``with_pixels`` the payload itself."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for batch in batches:
            ids, sizes, lists = (batch[c].to_pylist() for c in ("doc_id", "n_bytes", "files"))
            low = 0
            while low < len(ids):
                high, held = low, 0
                while high < len(ids) and (high == low or held < STEP_BYTES):
                    held += sizes[high] + UNIT
                    high += 1
                flat = [f for files in lists[low:high] for f in files]
                images = [samples(image) for image in webp.read_many(flat)]
                at, rows = 0, []
                for k in range(low, high):
                    payload = np.concatenate(images[at : at + len(lists[k])])
                    at += len(lists[k])
                    media, data = hashlib.sha256(), payload.tobytes()
                    for f in lists[k]:
                        media.update(f)
                    rows.append((ids[k], sizes[k], len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), sum(map(len, lists[k])), media.hexdigest(), feature(payload), data))
                kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                if with_pixels:
                    columns.append(pa.array([r[-1] for r in rows], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names + ["pixels"] * with_pixels)
                low = high

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.mapInArrow(run, schema + ", pixels binary" * with_pixels)


def media_columns(docs: DataFrame) -> DataFrame:
    """Stores every text, reads the stored table again and describes what it holds."""
    return read_back(Workspace(docs.sparkSession, "media").keep(store(docs), "files"))
