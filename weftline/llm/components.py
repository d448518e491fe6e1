"""Connected components by alternating star steps, each a join and a grouped minimum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import written


def _toward_smallest(arcs: DataFrame, keep_own: bool) -> DataFrame:
    """arcs (u, v): hang the neighbours of u, and u itself where asked, on the smallest of them."""
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = arcs.join(least, "u")
    hung = joined.where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if keep_own:
        hung = hung.unionByName(least.where("u != m").select(F.col("u").alias("a"), F.col("m").alias("b")))
    return hung.distinct()


def connected_components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """Rows (node, component) for each node with a link to another; component is the smallest node reachable.

    Self links, null ends and repeated edges are allowed and change nothing; no edges give an empty result.
    The edge set is written to the shared folder after each round, so lineage stays short. Raises if ``rounds`` are
    not enough (each round at least halves the longest path).
    """
    now = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = now.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    now, before = written(now, "edges"), None
    for _ in range(rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        small = _toward_smallest(large.select(F.col("a").alias("u"), F.col("b").alias("v")), keep_own=True)
        now = written(small, "edges")
        stamp = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if stamp == before:
            pairs = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return pairs.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        before = stamp
    raise RuntimeError(f"components did not settle in {rounds} rounds")
