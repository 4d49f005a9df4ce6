"""URL filters: host and path rules first, else a logistic regression on hashed character n-grams.

The model is trained on a small table of labelled URLs (``url_labels.tsv``), by Newton steps with a fixed ridge penalty. Its
features are the distinct hashed n-grams of the host and of the path.

Defined cases: a null url, or one without ``://``, has an empty host and path, meets no rule and goes to the model;
repeated rows are judged each; a null page_id stays null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import lru_cache
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 16
GRAMS = (3, 4, 5)
RIDGE = 0.02
PATH_WEIGHT = 0.3
#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))



def labelled() -> list[tuple[str, int]]:
    """The small labelled table: host and path, and 1 to block or 0 to allow."""
    text = files(__package__).joinpath("url_labels.tsv").read_text(encoding="utf-8")
    rows = [line.split("\t") for line in text.splitlines() if line and not line.startswith("#")]
    return [(url, int(label)) for label, url in rows]


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url column."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)\z", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null without one."""
    name = verdict = F.lit(None).cast("string")
    for kind, domain, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(start)
        name = F.when(fits, f"{domain}{start}").otherwise(name)
        verdict = F.when(fits, kind).otherwise(verdict)
    return name, verdict


def features(host: str, path: str) -> dict[int, float]:
    """Hashed n-grams of host and path; each of the two has a fixed length as a vector, the path a smaller one."""
    out: dict[int, float] = {}
    for kind, text, weight in (("h", f"^{host}$", 1.0), ("p", f"^{path}$", PATH_WEIGHT)):
        found = {zlib.crc32(f"{kind}{text[i : i + n]}".encode()) & ((1 << BITS) - 1) for n in GRAMS for i in range(len(text) - n + 1)}
        for f in found:
            out[f] = out.get(f, 0.0) + weight * len(found) ** -0.5
    return out


def fit(table: list[tuple[str, int]]) -> tuple[np.ndarray, float]:
    """Weights by hashed feature, and the intercept."""
    rows = [features(*u.partition("/")[::2]) for u, _ in table]
    y = np.array([label for _, label in table], float)
    used = np.array(sorted({f for r in rows for f in r}))
    x = np.zeros((len(rows), len(used)))
    for i, r in enumerate(rows):
        x[i, np.searchsorted(used, list(r))] = list(r.values())
    gram = x @ x.T + 1.0  # the intercept as one more feature
    a = np.zeros(len(rows))  # dual weights
    for _ in range(50):
        z = gram @ a
        p = 1 / (1 + np.exp(-z))
        w = np.maximum(p * (1 - p), 1e-6)
        a = np.linalg.solve(gram + RIDGE * np.diag(1 / w), z + (y - p) / w)
    weights = np.zeros(1 << BITS)
    weights[used] = x.T @ a
    return weights, float(a.sum())


@lru_cache(1)
def model() -> tuple[np.ndarray, float]:
    return fit(labelled())


def score(host: str, path: str, fitted: tuple[np.ndarray, float] | None = None) -> float:
    """Likelihood of a url to block."""
    weights, z = fitted or model()
    for f, value in features(host, path).items():
        z += weights[f] * value
    return float(1 / (1 + np.exp(-z)))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict, score."""

    def run(batches):
        for batch in batches:
            scores = [score(h, p) for h, p in zip(batch["host"].to_pylist(), batch["path"].to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    host, path = parts(F.col("url").cast("string"))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    scored = pages.mapInArrow(run, "page_id long, host string, path string, score double")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
