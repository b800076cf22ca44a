"""Exact order statistics without sorting a whole column or a whole group in one task.

The values of a group are first counted per distinct value (map-side combine collapses copies). Then pivots are refined: the
open interval of each wanted rank is cut at approximate quantiles, totals per piece give the exact number of rows before
it, and the piece that holds the rank is the next interval. Keys and ranks are refined together, and only rows of open
intervals are read again. A round ends the work when no interval has more than ``LEAF`` distinct values; those are ordered.
"""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from millrace.plans.joins import salted_join
from millrace.session import cut

BUCKETS = 64
LEAF = 1 << 16


def bucket_of(value: Column, splits: Column, buckets: int = BUCKETS) -> Column:
    """Number of split points below ``value``; binary search, so log2(buckets) steps per row."""
    steps, step = [], 1
    while step < buckets:
        steps.append(step)
        step *= 2
    size = F.size(splits)
    return F.aggregate(
        F.array(*[F.lit(s) for s in reversed(steps)]),
        F.lit(0),
        lambda low, s: F.when(
            (low + s <= size) & (F.get(splits, low + s - 1) < value), low + s
        ).otherwise(low),
    )


def split_points(value: Column, buckets: int = BUCKETS) -> Column:
    """Aggregate expression: at most ``buckets - 1`` approximate quantiles (a sketch of bounded size)."""
    points = [i / buckets for i in range(1, buckets)]
    return F.array_distinct(
        F.percentile_approx(value, F.array(*[F.lit(p) for p in points]), F.lit(buckets * 16))
    )


def refined(rows: DataFrame, wants: DataFrame, leaf: int | None = None, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame, list[int]]:
    """(rows, wants, sizes): distinct values narrowed to the intervals that hold a wanted rank.

    ``rows`` has _k, _iv (an interval of the key), _v and _c; ``wants`` has _k, _iv, _rank (a name) and _want, the rank within the
    interval. ``sizes`` lists the rows that each round started from.
    """
    leaf = leaf or LEAF
    sizes: list[int] = []
    while True:
        sizes.append(rows.count())
        interval = rows.groupBy("_k", "_iv").agg(F.count("*").alias("_n"))
        if sizes[-1] <= leaf or (interval.agg(F.max("_n")).first()[0] or 0) <= leaf:
            return rows, wants, sizes
        sketch = rows.groupBy("_k", "_iv").agg(split_points(F.col("_v"), buckets).alias("_splits"))
        bucket = F.coalesce(bucket_of(F.col("_v"), F.col("_splits"), buckets), F.lit(0))
        tagged = salted_join(rows, sketch, ["_k", "_iv"], ["_v"]).withColumn("_b", bucket).drop("_splits")
        totals = tagged.groupBy("_k", "_iv", "_b").agg(F.sum("_c").alias("_bc"))  # at most `buckets` rows an interval
        along = W.partitionBy("_k", "_iv").orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
        totals = totals.withColumn("_upto", F.sum("_bc").over(along))
        before = F.col("_upto") - F.col("_bc")
        hit = wants.join(totals, ["_k", "_iv"]).where((F.col("_want") > before) & (F.col("_want") <= F.col("_upto")))
        inner = (F.col("_iv") * buckets + F.col("_b")).alias("_iv")
        hit = cut(hit.select("_k", "_iv", "_b", "_rank", (F.col("_want") - before).alias("_want")), "ranks")
        rows = cut(tagged.join(hit.select("_k", "_iv", "_b").distinct(), ["_k", "_iv", "_b"], "left_semi").select("_k", inner, "_v", "_c"), "interval")
        wants = hit.select("_k", inner, "_rank", "_want")


def order_stats(
    df: DataFrame, value: str, ranks: Mapping[str, Callable[[Column], Column]], keys: Sequence[str] = (), buckets: int = BUCKETS
) -> DataFrame:
    """One row per key: ``n`` and, for each entry of ``ranks``, the value at that 1-based rank.

    A rank is a function of the row count ``n``. Nulls in ``value`` are left out.
    """
    keys = list(keys)
    # A struct key is never null, so null groups stay.
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))
    counts = df.where(F.col(value).isNotNull()).groupBy(key.alias("_k"), F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    counts = cut(counts.withColumn("_iv", F.lit(0).cast("long")), "counts")
    totals = counts.groupBy("_k").agg(F.sum("_c").alias("n"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("_rank"), fn(F.col("n")).cast("bigint").alias("_want")) for name, fn in ranks.items()]))
    wants = totals.select("_k", F.lit(0).cast("long").alias("_iv"), wanted.alias("_w")).select("_k", "_iv", "_w.*")
    rows, wants, _ = refined(counts, wants, buckets=buckets)
    inside = W.partitionBy("_k", "_iv").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    placed = rows.withColumn("_to", F.sum("_c").over(inside))
    asked = wants.groupBy("_k", "_iv").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_want"))).alias("_w"))
    placed = placed.join(asked, ["_k", "_iv"])
    here = lambda name: F.when((F.col("_w")[name] > F.col("_to") - F.col("_c")) & (F.col("_w")[name] <= F.col("_to")), F.col("_v"))
    found = placed.groupBy("_k").agg(*[F.max(here(name)).alias(name) for name in ranks])
    return found.join(totals, "_k").select(*[F.col(f"_k.{k}").alias(k) for k in keys], "n", *ranks)


def in_value_order(counts: DataFrame, sums: Mapping[str, Column], leaf: int | None = None) -> DataFrame:
    """Adds running totals of ``sums`` in the order of ``_v``; values that do not fit one task are cut into ranges first."""
    from millrace.plans.runs import running_sums

    rows = cut(counts, "counts")
    parts = -(-rows.count() // (leaf or LEAF))
    if parts > 1:
        rows = cut(rows.repartitionByRange(parts, "_v").withColumn("_b", F.spark_partition_id()), "ranges")
    else:
        rows = rows.withColumn("_b", F.lit(0))
    return running_sums(rows, [], ["_v"], F.col("_b"), sums).drop("_b")


def index_rank(p: float) -> Callable[[Column], Column]:
    """Rank of ``sorted[floor(n * p)]`` (0-based index, no interpolation)."""
    return lambda n: F.least(F.floor(n * F.lit(p)) + 1, n)


def index_quantiles(df: DataFrame, value: str, points: Mapping[str, float], keys: Sequence[str] = ()) -> DataFrame:
    return order_stats(df, value, {name: index_rank(p) for name, p in points.items()}, keys)


def linear_quantiles(df: DataFrame, value: str, points: Mapping[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles, the median being ``0.5``."""
    ranks: dict[str, Callable[[Column], Column]] = {}
    for name, p in points.items():
        ranks[f"_{name}_lo"] = lambda n, p=p: F.floor((n - 1) * F.lit(p)) + 1
        ranks[f"_{name}_hi"] = lambda n, p=p: F.ceil((n - 1) * F.lit(p)) + 1
    stats = order_stats(df, value, ranks, keys)
    out = []
    for name, p in points.items():
        pos = (F.col("n") - 1) * F.lit(p)
        lo, hi = F.col(f"_{name}_lo").cast("double"), F.col(f"_{name}_hi").cast("double")
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return stats.select(*keys, "n", *out)


def value_ranks(df: DataFrame, value: str, descending: bool = True) -> DataFrame:
    """Rows (value, rank) for the distinct values of a column: 1 + the rows that come strictly before."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    upto = in_value_order(counts, {"_to": F.col("_c")})
    total = df.where(F.col(value).isNotNull()).agg(F.count(F.lit(1)).alias("n")).scalar()
    rank = total - F.col("_to") + 1 if descending else F.col("_to") - F.col("_c") + 1
    return upto.select(F.col("_v").alias(value), rank.alias("rank"))
