"""Filter predicates: chart filters, document-store comparisons, topic patterns, row-level rules."""
from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F


def all_of(parts: Iterable[Column]) -> Column:
    return reduce(and_, parts, F.lit(True))


def any_of(parts: Iterable[Column]) -> Column:
    return reduce(or_, parts, F.lit(False))


def chart_filter(col: str | Column, op: str, val: Any = None) -> Column:
    """One chart filter; unknown operators raise instead of silently matching nothing."""
    c = F.col(col) if isinstance(col, str) else col
    word = " ".join(op.upper().split())
    simple = {
        "==": lambda: c == val, "=": lambda: c == val, "!=": lambda: c != val, "<>": lambda: c != val,
        ">": lambda: c > val, ">=": lambda: c >= val, "<": lambda: c < val, "<=": lambda: c <= val,
        "IN": lambda: c.isin(list(val)), "NOT IN": lambda: ~c.isin(list(val)),
        "LIKE": lambda: c.like(val), "NOT LIKE": lambda: ~c.like(val), "ILIKE": lambda: c.ilike(val),
        "REGEX": lambda: c.rlike(val),
        "IS NULL": lambda: c.isNull(), "IS NOT NULL": lambda: c.isNotNull(),
        "BETWEEN": lambda: c.between(val[0], val[1]),
    }
    if word not in simple:
        raise ValueError(f"unknown filter operator {op!r}")
    return simple[word]()


def store_filter(col: str | Column, op: str, val: Any) -> Column:
    """Document-store comparison; never null, so it can be negated safely.

    Equality treats null as a value, ordering and membership are false on null, ``exists`` compares
    "not null" with the given flag.
    """
    c = F.col(col) if isinstance(col, str) else col
    if op == "eq":
        return c.eqNullSafe(F.lit(val))
    if op == "ne":
        return ~c.eqNullSafe(F.lit(val))
    if op == "exists":
        return c.isNotNull() == F.lit(bool(val))
    tests = {
        "gt": lambda: c > val, "gte": lambda: c >= val, "lt": lambda: c < val, "lte": lambda: c <= val,
        "in": lambda: c.isin(list(val)), "nin": lambda: ~c.isin(list(val)),
        "contains": lambda: c.contains(val), "regex": lambda: c.rlike(val),
    }
    if op not in tests:
        raise ValueError(f"unknown comparison {op!r}")
    return F.coalesce(tests[op](), F.lit(False))


def path_filter(doc: Column, path: str, op: str, val: Any, as_type: str = "string") -> Column:
    """``store_filter`` on a dotted path of a VARIANT; false when a step before the last is no object.

    The last step may be absent from its object: it then compares as null.
    """
    steps = path.split(".")
    parent = "$" + "".join(f".{s}" for s in steps[:-1])
    holder = F.try_variant_get(doc, parent, "variant") if len(steps) > 1 else doc
    is_object = F.coalesce(F.schema_of_variant(holder).startswith("OBJECT"), F.lit(False))
    leaf = F.try_variant_get(doc, "$" + "".join(f".{s}" for s in steps), as_type)
    return is_object & store_filter(leaf, op, val)


def has_any_tag(tags: str | Column, wanted: Sequence[str]) -> Column:
    return F.coalesce(F.arrays_overlap(tags, F.array(*[F.lit(w) for w in wanted])), F.lit(False))


def expired(ts: str | Column, ttl_seconds: str | Column, as_of: Column) -> Column:
    """True once more than ``ttl`` seconds have passed; a null or zero TTL never expires."""
    ttl = F.col(ttl_seconds) if isinstance(ttl_seconds, str) else ttl_seconds
    stamp = F.col(ts) if isinstance(ts, str) else ts
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(stamp.cast("timestamp"))
    return F.coalesce((ttl > 0) & (age > ttl.cast("bigint") * 1_000_000), F.lit(False))


_UNITS = {"second", "minute", "hour", "day", "week", "month", "quarter", "year"}


def time_range(col: str | Column, text: str, as_of: datetime | str | None = None) -> Column:
    """``"a : b"`` (end excluded, either side may be empty) or ``"Last N units"`` before ``as_of``."""
    c = F.col(col) if isinstance(col, str) else col
    text = text.strip()
    last = re.fullmatch(r"(?i)last\s+(?:(\d+)\s+)?([a-z]+?)s?", text)
    if last:
        unit = last.group(2).lower()
        if unit not in _UNITS:
            raise ValueError(f"unknown time unit in {text!r}")
        if as_of is None:
            raise ValueError("a relative time range needs as_of")
        n = int(last.group(1) or 1)
        months = {"month": n, "quarter": 3 * n, "year": 12 * n}.get(unit)
        end = F.lit(str(as_of)).cast("timestamp_ntz")
        step = f"INTERVAL {months} MONTH" if months else f"INTERVAL {n * (7 if unit == 'week' else 1)} {'DAY' if unit == 'week' else unit.upper()}"
        return (c >= end - F.expr(step)) & (c < end)
    if " : " in f" {text} ":
        start, end = (part.strip() for part in f" {text} ".split(" : ", 1))
        parts = []
        if start:
            parts.append(c >= F.lit(start).cast("timestamp_ntz"))
        if end:
            parts.append(c < F.lit(end).cast("timestamp_ntz"))
        return all_of(parts)
    raise ValueError(f"cannot read time range {text!r}")


_COMPARE = (">=", "<=", "==", "!=", ">", "<")
_APPLY = {
    ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b, ">": lambda a, b: a > b, "<": lambda a, b: a < b,
}


def condition(left: Column, op: str, right: Column) -> Column:
    """Two-operand condition on text: numeric when both sides read as numbers, else as strings."""
    a, b = F.trim(left), F.trim(right)
    x, y = a.try_cast("double"), b.try_cast("double")
    quotes = F.lit("'\"")
    text = _APPLY[op](F.btrim(a, quotes), F.btrim(b, quotes))
    return F.coalesce(F.when(x.isNotNull() & y.isNotNull(), _APPLY[op](x, y)).otherwise(text), F.lit(False))


def condition_text(expr: Column) -> Column:
    """A whole condition held in a column, e.g. ``"12 >= 3"``; two-character operators are found first.

    Without an operator, the words true, 1 and yes hold; everything else does not.
    """
    out = F.lower(F.trim(expr)).isin("true", "1", "yes")
    for op in reversed(_COMPARE):
        at = F.instr(expr, op)
        left = F.substring(expr, F.lit(1), at - 1)
        right = F.substring(expr, at + len(op), F.length(expr))
        out = F.when(at > 0, condition(left, op, right)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def topic_matches(topic: Column, pattern: str, loose_double_star: bool = False) -> Column:
    """Dotted topic against a pattern: ``*`` is one segment, ``**`` any number of segments.

    ``loose_double_star`` reproduces the looser rule in which any pattern holding ``**`` matches all.
    """
    if "**" in pattern and loose_double_star:
        return F.lit(True)
    if "*" not in pattern:
        return topic == pattern
    parts = []
    for segment in pattern.split("."):
        parts.append(r".+" if segment == "**" else r"[^.]+" if segment == "*" else re.escape(segment))
    return topic.rlike("^" + r"\.".join(parts) + "$")


@dataclass(frozen=True)
class RowRule:
    """A row-level rule. Regular rules bind the listed roles, Base rules bind everybody else."""

    clause: str
    tables: frozenset[str]
    roles: frozenset[str]
    group_key: str | None = None
    base: bool = False


def secured(df: DataFrame, table: str, roles: Iterable[str], rules: Sequence[RowRule]) -> DataFrame:
    """Rules with the same group key are alternatives; different groups must all hold."""
    held = set(roles)
    groups: dict[str, list[Column]] = {}
    for i, rule in enumerate(rules):
        if table not in rule.tables:
            continue
        binds = not (held & rule.roles) if rule.base else bool(held & rule.roles)
        if binds:
            groups.setdefault(rule.group_key or f"#{i}", []).append(F.expr(f"({rule.clause})"))
    return df.where(all_of(any_of(g) for g in groups.values())) if groups else df


def native_filter(frames: Mapping[str, DataFrame], targets: Mapping[str, str], value: Any, default: Any = None) -> dict[str, DataFrame]:
    """One dashboard control applied to every target: ``targets`` maps a frame name to its column."""
    chosen = default if value is None else value
    out = {}
    for name, df in frames.items():
        col = targets.get(name)
        if col is None or chosen is None:
            out[name] = df
        else:
            values = chosen if isinstance(chosen, (list, tuple, set)) else [chosen]
            out[name] = df.where(F.col(col).isin(list(values)))
    return out


def alert_state(df: DataFrame, scalar: Column, op: str, threshold: float | None = None) -> DataFrame:
    """One row: the scalar of an alert query and whether it fires. ``op`` may also be "not null"."""
    got = df.agg(scalar.alias("value"))
    if op.lower() == "not null":
        return got.withColumn("fires", F.col("value").isNotNull())
    return got.withColumn("fires", F.coalesce(_APPLY[op](F.col("value"), F.lit(threshold)), F.lit(False)))
