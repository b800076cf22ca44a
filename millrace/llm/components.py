"""Connected components of a graph whose edges do not fit one machine."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.session import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id in an edge; the component is its smallest id.

    Alternates large-star and small-star steps, after which every id points at its component's smallest one. Each step
    shuffles every edge once. A star's centre never gathers its neighbours: its smallest one is an aggregate, joined back to
    the edges (a hot centre is a skewed join side, which adaptive execution splits). The number of rounds grows with the
    logarithm of the longest path. Every round is written out, so a lost executor repeats one round at most.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    pairs = cut(pairs, "edges")
    before = None
    while True:
        pairs = cut(_small_star(_large_star(pairs)), "stars")
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    tops = pairs.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).union(tops)


def _large_star(pairs: DataFrame) -> DataFrame:
    """Links every larger neighbour of an id to the smallest of the id and its neighbours."""
    both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Links an id and its smaller neighbours to the smallest of them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    joined = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
