"""Chart-style query builder: one immutable description, turned into one DataFrame plan."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.functions.predicates import chart_filter, time_range
from millrace.plans.ranks import linear_quantiles

ROW_LIMIT = 0


@dataclass(frozen=True)
class ChartQuery:
    """Columns, calculated columns, metrics, filters, time range and grain, ordering and paging.

    ``named_metrics`` is the registry of SQL metric expressions that ``metric(name)`` looks up.
    A row limit of 0 means no limit. Paging needs ``order_by`` to name a total order.
    """

    selected: tuple[str, ...] = ()
    calculated_columns: tuple[tuple[str, str], ...] = ()
    metric_list: tuple[tuple[str, str], ...] = ()
    filter_list: tuple[tuple[str, str, Any], ...] = ()
    group_columns: tuple[str, ...] = ()
    order: tuple[tuple[str, bool], ...] = ()
    row_limit: int = ROW_LIMIT
    row_offset: int = 0
    time_col: str | None = None
    range_text: str | None = None
    grain: str | None = None
    named_metrics: Mapping[str, str] = field(default_factory=dict)

    def columns(self, *names: str) -> ChartQuery:
        return replace(self, selected=self.selected + names)

    def calculated(self, name: str, expression: str) -> ChartQuery:
        return replace(self, calculated_columns=(*self.calculated_columns, (name, expression)))

    def metric(self, expression: str, label: str | None = None) -> ChartQuery:
        """A registered metric by name, or a free SQL aggregate."""
        text = self.named_metrics.get(expression, expression)
        return replace(self, metric_list=(*self.metric_list, (label or expression, text)))

    def count(self, column: str = "*", label: str | None = None) -> ChartQuery:
        return self.metric(f"count({column})", label or f"count_{column}")

    def sum(self, column: str, label: str | None = None) -> ChartQuery:
        return self.metric(f"sum({column})", label or f"sum_{column}")

    def avg(self, column: str, label: str | None = None) -> ChartQuery:
        return self.metric(f"avg({column})", label or f"avg_{column}")

    def where(self, column: str, op: str, value: Any = None) -> ChartQuery:
        return replace(self, filter_list=(*self.filter_list, (column, op, value)))

    def group_by(self, *names: str) -> ChartQuery:
        return replace(self, group_columns=names)

    def order_by(self, column: str, ascending: bool = True) -> ChartQuery:
        return replace(self, order=(*self.order, (column, ascending)))

    def limit(self, rows: int) -> ChartQuery:
        return replace(self, row_limit=rows)

    def offset(self, rows: int) -> ChartQuery:
        return replace(self, row_offset=rows)

    def time(self, column: str, range_text: str | None = None, grain: str | None = None) -> ChartQuery:
        return replace(self, time_col=column, range_text=range_text, grain=grain)

    def last(self, value: int, unit: str) -> ChartQuery:
        return replace(self, range_text=f"Last {value} {unit}")

    def apply(self, df: DataFrame, as_of: str | None = None) -> DataFrame:
        for name, text in self.calculated_columns:
            df = df.withColumn(name, F.expr(text))
        for name, op, value in self.filter_list:
            df = df.where(chart_filter(name, op, value))
        if self.range_text:
            df = df.where(time_range(self.time_col, self.range_text, as_of))
        groups = [F.col(c) for c in self.group_columns]
        if self.grain:
            groups.append(time_grain(F.col(self.time_col), self.grain).alias(f"{self.time_col}_{self.grain}"))
        if self.metric_list:
            metrics = [F.expr(text).alias(label) for label, text in self.metric_list]
            df = df.groupBy(*groups).agg(*metrics) if groups else df.agg(*metrics)
        elif groups:
            df = df.select(*groups).distinct()
        elif self.selected:
            df = df.select(*self.selected)
        if self.order:
            df = df.orderBy(*[F.col(c).asc() if up else F.col(c).desc() for c, up in self.order])
        if self.row_offset:
            df = df.offset(self.row_offset)
        if self.row_limit:
            df = df.limit(self.row_limit)
        return df


def time_grain(col: Column, grain: str) -> Column:
    return F.date_trunc(grain, col)


ROLE_TYPES = {
    "temporal": (T.DateType, T.TimestampType, T.TimestampNTZType),
    "numeric": (T.NumericType,),
    "groupable": (T.StringType, T.BooleanType, T.DateType, T.IntegerType),
    "filterable": (T.AtomicType,),
}


def columns_by_role(df: DataFrame, role: str) -> list[str]:
    """Columns whose type plays a role; a ``roles`` list in the column metadata overrides the type."""
    names = []
    for f in df.schema.fields:
        marked = (f.metadata or {}).get("roles")
        if (role in marked) if marked is not None else isinstance(f.dataType, ROLE_TYPES[role]):
            names.append(f.name)
    return names


def pivot_frame(df: DataFrame, rows: Sequence[str], column: str, values: Sequence[Any], metric: Column) -> DataFrame:
    """Pivot table; the pivot values are given, so no extra job looks for them."""
    return df.groupBy(*rows).pivot(column, list(values)).agg(metric)


def box_plot_frame(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Five-number summary per key with interpolated quartiles."""
    stats = linear_quantiles(df, value, {"low": 0.0, "q1": 0.25, "mid": 0.5, "q3": 0.75, "high": 1.0}, keys)
    return stats.withColumnRenamed("n", "rows")


def heatmap_frame(df: DataFrame, x: Column, y: Column, metric: Column) -> DataFrame:
    return df.groupBy(x.alias("x"), y.alias("y")).agg(metric.alias("value"))


def funnel_frame(df: DataFrame, actor: str, step: str, steps: Sequence[str]) -> DataFrame:
    """Actors that did step 1, steps 1 and 2, and so on (in any order of time)."""
    flags = [F.max((F.col(step) == s).cast("int")).alias(f"s{i}") for i, s in enumerate(steps)]
    seen = df.groupBy(actor).agg(*flags)
    reach = [
        F.count_if(F.greatest(F.lit(0), F.least(F.lit(1), *[F.col(f"s{j}") for j in range(i + 1)])) == 1)
        for i in range(len(steps))
    ]
    wide = seen.agg(*[r.alias(f"r{i}") for i, r in enumerate(reach)])
    pairs = F.array(
        *[F.struct(F.lit(i + 1).alias("position"), F.lit(s).alias("step"), F.col(f"r{i}").alias("actors")) for i, s in enumerate(steps)]
    )
    return wide.select(F.explode(pairs).alias("p")).select("p.*")


def treemap_frame(df: DataFrame, levels: Sequence[str], metric: Column) -> DataFrame:
    """Totals at every level of a hierarchy; ``depth`` counts the levels that are set."""
    rolled = df.rollup(*levels).agg(metric.alias("value"), F.grouping_id().alias("_g"))
    depth = F.lit(len(levels)) - F.bit_count("_g")
    return rolled.withColumn("depth", depth.cast("int")).drop("_g")


def sankey_frame(df: DataFrame, source: Column, target: Column, metric: Column) -> DataFrame:
    return df.groupBy(source.alias("source"), target.alias("target")).agg(metric.alias("value"))
