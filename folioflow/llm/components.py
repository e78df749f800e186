"""Connected components of an edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, store


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b); component is its smallest node.

    Large star: each node's larger neighbours move to the least of its neighbourhood. Small
    star: its smaller neighbours and itself do. Rounds go on until the edges no longer
    change, told by their count and two order-free sums; no edge reaches the driver. What a
    node's neighbours are joined to is stored first, so that Spark can split the join where
    one node has a great part of all edges. An empty list gives an empty result; edges from
    a node to itself keep it as a node; repeated edges count once.
    """
    own = edges.where("a = b").select(F.col("a").alias("node")).distinct()
    now, seen = _kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while seen["n"] and seen != before:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = store(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")), "stars")
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        large = store(large, "edges")
        discard(low)
        low = store(large.groupBy("a").agg(F.min("b").alias("low")), "stars")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
        before, old = seen, now
        now, seen = _kept(small.where("a <> b").select("a", "b").distinct())
        discard(old, large, low)
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    found = found.unionByName(roots)
    return found.unionByName(own.join(found, "node", "left_anti").select("node", F.col("node").alias("component")))


def _kept(edges: DataFrame) -> tuple[DataFrame, dict]:
    """``edges`` stored, and their count and two sums of hashes, seen while they are written."""
    sums = {k: F.sum(F.shiftrightunsigned(F.xxhash64(*pair), 20).cast("decimal(38,0)")) for k, pair in (("one", ("a", "b")), ("two", ("b", "a")))}
    seen = Observation()
    out = store(edges.observe(seen, F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in sums.items()]), "edges")
    return out, seen.get
