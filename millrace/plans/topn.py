"""First rows per key without gathering a key in one task."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from millrace.plans.joins import SALTS


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, spread: Sequence[str | Column], salts: int = SALTS) -> DataFrame:
    """The first ``n`` rows of each key: first within salted parts of the key, then among the survivors."""
    parted = df.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*spread), F.lit(salts)), F.lit(0)))
    part = W.partitionBy(*keys, "_salt").orderBy(*order)
    whole = W.partitionBy(*keys).orderBy(*order)
    rank = F.row_number()
    kept = parted.withColumn("_r", rank.over(part)).where(F.col("_r") <= n)
    return kept.withColumn("_r", rank.over(whole)).where(F.col("_r") <= n).drop("_r", "_salt")


def at_most(df: DataFrame, limit: int | None) -> DataFrame:
    """The first rows of an ordered frame, or all of them."""
    return df if limit is None else df.limit(limit)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], latest: bool = False) -> DataFrame:
    """One row per key, the first (or latest) in order: an aggregate, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    pick = (F.max_by if latest else F.min_by)(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(pick.alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)
