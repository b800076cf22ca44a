"""Mutual information of numbers with a discrete target by nearest neighbours (the estimator of Ross, 2014).

A row's distance to its k-th nearest neighbour of the same class, and the number of rows of any class that lie nearer, say how
much the class tells about the value. Both are questions about a line: distances come from the order of a class, which is cut
into ranges that take over ``k`` rows from both sides; numbers of rows are differences of running counts over ranges of
the whole column, asked at both ends of each distance. Equal values are one row with a count.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from millrace.operators.features import unpivot
from millrace.plans.ranks import LEAF
from millrace.plans.runs import running_sums
from millrace.session import cut

RADII = "column string, y string, x double, n long, low double, high double, k long"


def digamma(x: Column) -> Column:
    """The digamma function of a number from 1 on, exact to about 1e-14."""
    z = x.cast("double") + 10.0
    w = 1.0 / (z * z)
    series = F.log(z) - 0.5 / z - w * (1 / 12 - w * (1 / 120 - w * (1 / 252 - w * (1 / 240 - w * (1 / 132)))))
    return series - sum((1.0 / (x + float(j)) for j in range(1, 10)), 1.0 / x)


def ranged(rows: DataFrame, order: Sequence[str], leaf: int) -> DataFrame:
    """Adds ``_b``, a number that never falls along ``order``, shared by about ``leaf`` rows."""
    rows = cut(rows, "rows")
    parts = max(1, -(-rows.count() // leaf))
    return cut(rows.repartitionByRange(parts, *order).withColumn("_b", F.spark_partition_id()), "ranges")


def bounds(x: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers nearest to x on both sides whose computed distance from x is at least r; x itself where r is 0."""
    ends = []
    for side in (-1.0, 1.0):
        end = x + side * r
        for _ in range(4):  # rounding moves an end by a few places at most
            inner = np.nextafter(end, x)
            end = np.where((np.abs(inner - x) >= r) & (r > 0), inner, end)
        for _ in range(4):
            end = np.where(np.abs(end - x) < r, np.nextafter(end, side * np.inf), end)
        ends.append(end)
    return ends[0], ends[1]


def nearest_information(df: DataFrame, columns: Sequence[str], target: str, k: int = 3, leaf: int | None = None) -> DataFrame:
    """(column, mi): mutual information in nats, not below 0, best first.

    Rows without a value or a class are left out, and so are classes of one row. Rows nearer than the k-th neighbour count
    with the row itself; where that neighbour has the same value, the rows of that value do. No noise is added, so results
    do not change between runs.
    """
    leaf = leaf or LEAF
    long = unpivot(df.select(F.col(target).cast("string").alias("_y"), *columns), columns, ["_y"]).where("value is not null and not isnan(value) and _y is not null")
    counts = long.groupBy("column", F.col("_y").alias("y"), F.col("value").alias("x")).agg(F.count("*").alias("n"))
    own = ranged(counts, ["column", "y", "x"], leaf)
    classes = cut(own.groupBy("column", "y").agg(F.sum("n").alias("size")).where("size > 1"), "classes")
    own = own.join(classes, ["column", "y"])
    rank = lambda order: F.row_number().over(W.partitionBy("column", "y", "_b").orderBy(order))
    marked = own.withColumns({"_i": rank(F.asc("x")), "_j": rank(F.desc("x"))})
    group = ["column", "y", "_b"]
    some = lambda at: F.sort_array(F.collect_list(F.when(F.col(at) <= k, F.struct("x", "n"))))
    edges = marked.where((F.col("_i") <= k) | (F.col("_j") <= k)).groupBy(*group).agg(some("_i").alias("first"), some("_j").alias("last"), F.max("size").alias("size"))
    along = W.partitionBy("column", "y").orderBy("_b")
    before = F.flatten(F.collect_list("last").over(along.rowsBetween(-k, -1)))
    after = F.flatten(F.collect_list("first").over(along.rowsBetween(1, k)))
    around = edges.select(*group, "size", F.concat(F.slice(F.reverse(before), 1, k), F.slice(after, 1, k)).alias("e"))
    halo = around.select(*group, "size", F.explode("e").alias("e"))
    rows = own.select(*group, "x", "n", "size", F.lit(True).alias("own")).union(halo.select(*group, "e.x", "e.n", "size", F.lit(False)))

    def radii(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        x, n = pdf["x"].to_numpy(float), pdf["n"].to_numpy(np.int64)
        asked = min(k, int(pdf["size"].iloc[0]) - 1)
        copies = np.minimum(n, k + 1)
        z = np.concatenate([np.full(k, -np.inf), np.repeat(x, copies), np.full(k, np.inf)])
        first = k + np.cumsum(copies) - copies
        steps = np.arange(1, k + 1)
        near = np.sort(np.abs(np.column_stack([z[first[:, None] - steps], z[(first + copies - 1)[:, None] + steps]]) - x[:, None]), axis=1)
        left = np.maximum(asked - (copies - 1), 0)
        r = np.where(left > 0, near[np.arange(len(x)), np.maximum(left - 1, 0)], 0.0)
        low, high = bounds(x, r)
        out = pd.DataFrame({"column": pdf["column"], "y": pdf["y"], "x": x, "n": n, "low": low, "high": high, "k": asked})
        return out[pdf["own"].to_numpy()]

    asked = cut(rows.groupBy(*group).applyInPandas(radii, RADII), "radii")
    data = asked.select("column", F.col("x").alias("at"), F.lit(1).alias("kind"), "n", F.lit(None).cast("string").alias("y"), F.lit(None).cast("double").alias("x"), F.lit(0).alias("sign"))
    whole = F.col("low") == F.col("high")  # the k-th neighbour has the same value: its rows are counted
    upper = asked.select("column", F.col("high").alias("at"), F.when(whole, 2).otherwise(0).alias("kind"), F.lit(0).cast("long").alias("n"), "y", "x", F.lit(1).alias("sign"))
    lower = asked.select("column", F.col("low").alias("at"), F.when(whole, 0).otherwise(2).alias("kind"), F.lit(0).cast("long").alias("n"), "y", "x", F.lit(-1).alias("sign"))
    events = ranged(data.union(upper).union(lower), ["column", "at", "kind"], leaf)
    passed = running_sums(events, ["column"], ["at", "kind"], F.col("_b"), {"upto": F.col("n")}).where("sign <> 0")
    inside = passed.groupBy("column", "y", "x").agg(F.sum(F.col("sign") * F.col("upto")).alias("m"))
    scored = asked.join(inside, ["column", "y", "x"]).join(classes, ["column", "y"])
    share = F.sum(F.col("n") * (digamma(F.col("k")) - digamma(F.col("size")) - digamma(F.col("m")))) / F.sum("n")
    mi = scored.groupBy("column").agg(F.greatest(F.lit(0.0), digamma(F.sum("n")) + share).alias("mi"))
    return mi.orderBy(F.desc("mi"), "column")
