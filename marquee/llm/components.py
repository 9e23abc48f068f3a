"""Connected components over a table of links, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import drop, spool


def _fingerprint(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h


def connected(links: DataFrame) -> DataFrame:
    """(node, component): for each node of ``links`` (a, b), the smallest node reachable from it.

    Each round is two grouped minima (combined before the shuffle) and two joins; nothing is gathered
    by component. Rounds are written tables, each deleted when the next one is there; their number grows with the logarithm of the longest path.
    """
    edges = spool(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _fingerprint(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        last, edges = edges, spool(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        drop(last)
        after = _fingerprint(edges)
        if after == before:
            break
        before = after
    members = edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return members.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()) \
        .groupBy("node").agg(F.min("component").alias("component"))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In a task: for each of n nodes the smallest node linked to it through the pairs (a, b)."""
    root = np.arange(n)
    while True:
        m = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        np.minimum.at(new, root[a], m)
        np.minimum.at(new, root[b], m)
        new = new[new]
        if (new == root).all():
            return root
        root = new
