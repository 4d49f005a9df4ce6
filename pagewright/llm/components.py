"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Workspace


def connected(links: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, component) for every node of ``links(x, y)``; a component is named by its least node.

    Rounds end when the links no longer change; each round is a written table. A node without links has no row.
    """
    now = work.keep(links.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), f"{name}0")
    state, step = None, 0
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        step += 1
        then = work.keep(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"{name}{step}")
        found = then.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        work.drop(f"{name}{step - 1}")
        if (found.n, found.h) == state:
            break
        state, now = (found.n, found.h), then
    roots = then.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return then.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
