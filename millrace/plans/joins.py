"""Joins and grouped lookups that stay even when one key holds a large share of the rows."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

SALTS = 16


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    spread: Sequence[str | Column],
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join whose hot keys are cut into ``salts`` parts.

    ``spread`` must vary between the rows of one key on the big side. The small side is repeated once
    per salt, so it should hold few rows per key (aggregates, dictionaries). ``how`` is inner, left,
    left_semi or left_anti; every big row meets exactly one copy of each small row.

    The copies come from a cross join with the salts and not from ``explode``: Spark's size estimate multiplies the sides of
    a join, but takes exploded rows for one row each, and would broadcast sixteen times what it means to.
    """
    left = big.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"), F.lit(0)))
    right = small.crossJoin(small.sparkSession.range(0, salts, 1, 1).select(F.col("id").cast("int").alias("_salt")))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def one_row(stats: DataFrame) -> Column:
    """A one-row frame as a struct-valued scalar subquery: no join, no shuffle of the other side."""
    return stats.select(F.struct(*stats.columns).alias("s")).scalar()
