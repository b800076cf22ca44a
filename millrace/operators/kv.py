"""Document-store queries over a table of entries (key, doc, category, ts, ttl_seconds, tags)."""
from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.predicates import all_of, expired, has_any_tag, path_filter, store_filter

Clause = tuple[str, str, Any]


def kv_filter(
    df: DataFrame, clauses: Sequence[Clause] = (), category: str | None = None, tags: Sequence[str] = (),
    as_of: Column | None = None, include_expired: bool = False,
) -> DataFrame:
    """Category, any-of tags, comparisons (dotted names look into ``doc``) and TTL, all ANDed."""
    if category is not None:
        df = df.where(F.col("category") == category)
    if tags:
        df = df.where(has_any_tag("tags", tags))
    tests = []
    for name, op, value in clauses:
        if name.startswith("doc."):
            kind = "double" if isinstance(value, (int, float)) and not isinstance(value, bool) else "string"
            tests.append(path_filter(F.col("doc"), name[4:], op, value, kind))
        else:
            tests.append(store_filter(name, op, value))
    df = df.where(all_of(tests))
    if as_of is not None and not include_expired:
        df = df.where(~expired("ts", "ttl_seconds", as_of))
    return df


def kv_page(df: DataFrame, sort: Sequence[Column], offset: int = 0, limit: int = 0) -> DataFrame:
    """Nulls come first in an ascending sort; limit 0 means all rows."""
    df = df.orderBy(*sort)
    if offset:
        df = df.offset(offset)
    return df.limit(limit) if limit else df


def kv_aggregate(df: DataFrame, field: Column, op: str) -> DataFrame:
    """COUNT, SUM, AVG, MIN, MAX as one row, DISTINCT as one row per value.

    Only non-null values count. Over no rows COUNT and SUM give 0 and the rest null; AVG over rows that
    hold no value at all gives 0.
    """
    if op == "DISTINCT":
        return df.select(field.alias("result")).where("result IS NOT NULL").distinct()
    rows = F.count(F.lit(1))
    result = {
        "COUNT": F.count(field).cast("double"),
        "SUM": F.coalesce(F.sum(field).cast("double"), F.lit(0.0)),
        "AVG": F.when(rows > 0, F.coalesce(F.avg(field), F.lit(0.0))),
        "MIN": F.min(field).cast("double"),
        "MAX": F.max(field).cast("double"),
    }[op]
    return df.agg(result.alias("result"))
