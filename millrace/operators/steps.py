"""Extension points: row functions, step lists, templates, text plugins, table functions, saved queries."""
from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from millrace.functions import text as X
from millrace.functions.predicates import condition_text


def map_rows(df: DataFrame, transform: Callable[[dict], dict | None], schema: T.StructType | str) -> DataFrame:
    """Row callback over Arrow batches; a row for which it returns None is dropped. Column functions are faster."""
    target = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = target.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = (transform(r) for r in pdf.to_dict("records"))
            yield pd.DataFrame([[r.get(n) for n in names] for r in rows if r is not None], columns=names)

    return df.mapInPandas(run, target)


def batch_validator(check: Callable[[pd.DataFrame], pd.Series], *columns: str) -> Column:
    """Boolean column from a vectorised check over the named columns."""

    @F.pandas_udf("boolean")
    def run(frame: pd.DataFrame) -> pd.Series:
        return check(frame)

    return run(F.struct(*columns))


# --- step lists ---------------------------------------------------------------------------------------


def run_steps(df: DataFrame, steps: Sequence[Mapping[str, Any]], when: Column | None = None) -> DataFrame:
    """Applies a list of steps to every row.

    transform: ``{input, operation, store_as}``; set: ``{name, value}`` with ``{{column}}`` marks; get:
    ``{name, store_as}``; condition: ``{condition, then, else}``; loop: ``{items, as, actions}``, which
    continues with one row per item. Steps under a condition keep the old value where it does not hold.
    """
    for step in steps:
        df = _STEPS[step["type"]](df, step, when)
    return df


def _store(df: DataFrame, name: str, value: Column, when: Column | None) -> DataFrame:
    if when is None:
        return df.withColumn(name, value)
    old = F.col(name) if name in df.columns else F.lit(None)
    return df.withColumn(name, F.when(when, value).otherwise(old))


def _marks(df: DataFrame) -> dict[str, Column]:
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StructType):
            out |= {f"{f.name}.{g.name}": F.col(f"{f.name}.{g.name}") for g in f.dataType.fields}
        elif not isinstance(f.dataType, (T.ArrayType, T.MapType)):
            out[f.name] = F.col(f.name)
    return out


def _transform(df, step, when):
    name = step["input"]
    is_list = isinstance(df.schema[name].dataType, T.ArrayType)
    return _store(df, step.get("store_as", "result"), X.apply_operation(F.col(name), step["operation"], is_list), when)


def _set(df, step, when):
    value = step["value"]
    return _store(df, step["name"], X.fill_template(value, _marks(df)) if isinstance(value, str) else F.lit(value), when)


def _get(df, step, when):
    return _store(df, step.get("store_as", "result"), F.col(step["name"]), when)


def _condition(df, step, when):
    flag = f"_c{len(df.columns)}"
    holds = condition_text(X.fill_template(step["condition"], _marks(df)))
    df = df.withColumn(flag, holds if when is None else when & holds)
    other = ~F.col(flag) if when is None else when & ~F.col(flag)
    df = run_steps(df, step.get("then", ()), F.col(flag))
    return run_steps(df, step.get("else", ()), other).drop(flag)


def _loop(df, step, when):
    items = F.col(step["items"]) if when is None else F.when(when, F.col(step["items"]))
    looped = df.withColumn(step.get("as", "item"), F.explode(items))
    return run_steps(looped, step["actions"])


_STEPS = {"transform": _transform, "set": _set, "get": _get, "condition": _condition, "loop": _loop}


def fill_spec(spec: Any, params: Mapping[str, Any]) -> Any:
    """A step list with ``{{param}}`` marks filled in; marks of other names stay for the rows."""
    if isinstance(spec, str):
        return re.sub(r"\{\{\s*([\w.]+)\s*\}\}", lambda m: str(params.get(m.group(1), m.group(0))), spec)
    if isinstance(spec, Mapping):
        return {k: fill_spec(v, params) for k, v in spec.items()}
    return [fill_spec(v, params) for v in spec] if isinstance(spec, (list, tuple)) else spec


# --- text plugins -------------------------------------------------------------------------------------


@dataclass
class TextPlugins:
    """Text functions by name with a priority; the lowest priority runs first."""

    known: dict[str, tuple[int, Callable[[Column], Column]]] = field(default_factory=dict)

    def register(self, name: str, apply: Callable[[Column], Column], priority: int = 500) -> TextPlugins:
        self.known[name] = (priority, apply)
        return self

    def apply(self, col: Column, enabled: Sequence[str] | None = None) -> Column:
        chosen = [(p, n, f) for n, (p, f) in self.known.items() if enabled is None or n in enabled]
        for _, _, fn in sorted(chosen, key=lambda x: x[:2]):
            col = fn(col)
        return col


def standard_plugins() -> TextPlugins:
    return TextPlugins().register("autolink", X.auto_link, 100).register("emoji", X.replace_emoji, 200).register("smartquotes", X.smart_quotes, 900)


# --- table functions ----------------------------------------------------------------------------------


@F.udtf(returnType="position int, role string, ref string")
class RoleMarks:
    """Rows of the ``{role}`` marks of a text, in order."""

    PATTERN = re.compile(r"\{(\w+)\}`([^`]+)`")

    def eval(self, text: str):
        for i, m in enumerate(self.PATTERN.finditer(text or "")):
            yield i, m.group(1), m.group(2)


def role_marks(df: DataFrame, text: str = "text") -> DataFrame:
    return df.lateralJoin(RoleMarks(F.col(text).outer()))


# --- saved queries ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class SavedQuery:
    name: str
    sql: str
    params: Mapping[str, Any] = field(default_factory=dict)
    limit: int = 1000


def run_saved(spark: SparkSession, query: SavedQuery, overrides: Mapping[str, Any] | None = None, **views: DataFrame) -> DataFrame:
    """Runs a saved query with named parameters (call values over saved ones), capped, with an ``is_limited`` flag.

    Parameters are bound by Spark, not pasted into the text. One row more than the cap is asked for, so the
    flag does not need a count of the whole result.
    """
    merged = {**query.params, **(overrides or {})}
    result = spark.sql(query.sql, args=merged, **views)
    probe = result.limit(query.limit + 1)
    more = probe.agg((F.count(F.lit(1)) > query.limit).alias("m")).scalar()
    return probe.limit(query.limit).withColumn("is_limited", more)
