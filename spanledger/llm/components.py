"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.session import cut_lineage


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))).first()
    return tuple(row)


def _star(arcs: DataFrame) -> DataFrame:
    """Arcs (u, v) with the least node among u and its v; the hot u is summed before the shuffle
    and met by an equi-join, never gathered."""
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return arcs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the least node reachable.

    Nodes are longs, not null. Loops and repeated edges change nothing. The number of rounds
    grows with the logarithm of the longest path; each round's edges are a written table.
    """
    now = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _mark(now)
    while seen[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        met = _star(large)
        small = met.select(F.col("v").alias("a"), F.col("m").alias("b")).union(met.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = cut_lineage(small.where("a > b").distinct())
        mark = _mark(now)
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    ).distinct()
