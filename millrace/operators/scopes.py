"""Relational scopes and paging over user, login, activity, notification and audit tables."""
from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.predicates import all_of, any_of, chart_filter


def recent(col: str, days: int, as_of: Column) -> Column:
    return F.col(col) >= as_of - F.expr(f"INTERVAL {days} DAY")


def inactive(col: str, days: int, as_of: Column) -> Column:
    """Never seen, or last seen before the cut."""
    return F.col(col).isNull() | (F.col(col) < as_of - F.expr(f"INTERVAL {days} DAY"))


def unexpired(col: str, as_of: Column) -> Column:
    return F.col(col).isNull() | (F.col(col) > as_of)


def search_like(cols: Sequence[str], term: str) -> Column:
    """The term anywhere in any of the columns, ignoring case; the term is taken literally."""
    return any_of(F.lower(F.col(c)).contains(term.lower()) for c in cols)


def audit_query(
    df: DataFrame, operation: str | None = None, entity_type: str | None = None, user: str | None = None,
    since: Any = None, limit: int | None = None, ts: str = "ts", tie: str = "id",
) -> DataFrame:
    """Filters, then the newest ``limit`` rows in ascending order; ``since`` is exclusive."""
    for col, value in (("operation", operation), ("entity_type", entity_type), ("user", user)):
        if value is not None:
            df = df.where(F.col(col) == value)
    if since is not None:
        df = df.where(F.col(ts) > F.lit(since).cast("timestamp_ntz"))
    return (df if limit is None else df.orderBy(F.desc(ts), F.desc(tie)).limit(limit)).orderBy(ts, tie)


def history_page(df: DataFrame, filters: Sequence[dict], page: int, page_size: int, order: Sequence[str]) -> DataFrame:
    """Optional ``{col, opr, value}`` filters, ANDed, then one page (0-based) of a total order."""
    names = {"eq": "==", "neq": "!=", "gt": ">", "lt": "<", "in": "IN", "like": "LIKE"}
    df = df.where(all_of(chart_filter(f["col"], names.get(f["opr"], f["opr"]), f["value"]) for f in filters))
    return sorted_page(df, order, page + 1, page_size)


def sort_keys(order: Sequence[str]) -> list[Column]:
    """``"-created_at"`` sorts descending, ``"name"`` ascending."""
    return [F.col(o[1:]).desc() if o.startswith("-") else F.col(o).asc() for o in order]


def sorted_page(df: DataFrame, order: Sequence[str], page: int = 1, per_page: int = 15) -> DataFrame:
    return df.orderBy(*sort_keys(order)).offset((max(page, 1) - 1) * per_page).limit(per_page)


def capped_list(df: DataFrame, order: Sequence[str], cap: int, keep: Column | None = None) -> DataFrame:
    """Newest rows up to a cap, each carrying the number of matching rows before the cap."""
    kept = df if keep is None else df.where(keep)
    total = kept.agg(F.count(F.lit(1)).alias("n")).scalar()
    return kept.orderBy(*sort_keys(order)).limit(cap).withColumn("total", total)
