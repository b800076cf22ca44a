"""Naive and seasonal-naive forecasts, one series per key."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from millrace.plans.topn import top_per_key

# Calendar step of a frequency code.
STEPS = {"H": "INTERVAL 1 HOUR", "D": "INTERVAL 1 DAY", "W": "INTERVAL 7 DAY", "M": "INTERVAL 1 MONTH", "Y": "INTERVAL 1 YEAR"}


def seasonal_naive(
    df: DataFrame, keys: Sequence[str], at: str, value: str, horizon: int, season: int | None = None,
    frequency: str = "D", tie: str | None = None,
) -> DataFrame:
    """Rows (keys, step, at, forecast): the last season repeated, or the last value without a full season.

    Only the newest ``season`` points of a series travel; a series of fewer than two points has no forecast.
    """
    if frequency not in STEPS:
        raise ValueError(f"unknown frequency {frequency!r}")
    keys, length = list(keys), max(season or 1, 1)
    rows = df.select(*keys, F.col(at).alias("_at"), F.col(value).cast("double").alias("_y"), *([tie] if tie else []))
    rows = rows.where(F.col("_at").isNotNull() & F.col("_y").isNotNull())
    order: list[Column] = [F.desc("_at"), *([F.desc(tie)] if tie else [])]
    newest = top_per_key(rows, keys, order, max(length, 2), [tie or "_at"])
    items = F.reverse(F.array_sort(F.collect_list(F.struct("_at", *([tie] if tie else []), "_y"))))
    base = newest.groupBy(*keys).agg(items.alias("_s")).where(F.size("_s") >= 2)
    used = F.when(F.size("_s") >= length, F.lit(length)).otherwise(F.lit(1))
    steps = F.sequence(F.lit(1), F.lit(horizon))
    out = base.withColumn("_len", used).select(*keys, "_s", "_len", F.explode(steps).alias("step"))
    pick = F.element_at("_s", (F.col("_len") - F.pmod(F.col("step") - 1, F.col("_len"))).cast("int"))["_y"]
    moved = F.col("_s")[0]["_at"] + F.expr(f"step * {STEPS[frequency]}")
    return out.select(*keys, "step", moved.alias("at"), pick.alias("forecast"))
