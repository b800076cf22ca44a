"""Ordered computations over long keys, cut into chunks along the order so that no task sees a whole key.

``chunk`` is always an expression that never decreases along the order (an hour, a block of turn
numbers). Work inside a chunk is a window over (key, chunk); what a chunk passes on is one small row,
so the second window, over the chunks of a key, holds one row per chunk and not one per input row.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from millrace.session import cut


def _chunked(df: DataFrame, keys: Sequence[str], chunk: Column) -> DataFrame:
    """Adds ``_chunk`` and ``_g``, the struct of keys and chunk.

    A struct is never null, so rows with null keys meet their own group in the joins below; windows and
    joins share the one partitioning by ``_g``.
    """
    rows = df.withColumn("_chunk", chunk)
    return rows.withColumn("_g", F.struct(*keys, "_chunk"))


def _along(keys: Sequence[str]):
    return W.partitionBy(*(keys or [F.lit(0)])).orderBy("_chunk")


def _with_keys(keys: Sequence[str]) -> list[Column]:
    return [*[F.col(f"_g.{k}").alias(k) for k in keys], F.col("_g._chunk").alias("_chunk")]


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence, chunk: Column, sums: Mapping[str, Column]
) -> DataFrame:
    """Adds, for each entry of ``sums``, the running total up to and including the row."""
    keys = list(keys)
    rows = _chunked(df, keys, chunk)
    inside = W.partitionBy("_g").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    totals = rows.groupBy("_g").agg(*[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()]).select("*", *_with_keys(keys))
    before = _along(keys).rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select("_g", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    local = rows.withColumns({n: F.sum(e).over(inside) for n, e in sums.items()})
    joined = local.join(carried, "_g")
    return joined.withColumns({n: F.col(n) + F.col(f"_o_{n}") for n in sums}).drop("_chunk", "_g", *[f"_o_{n}" for n in sums])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence, chunk: Column, name: str = "n") -> DataFrame:
    """Exact 1-based row number per key."""
    return running_sums(df, keys, order, chunk, {name: F.lit(1).cast("bigint")})


def in_order(df: DataFrame, order: str, chunk: Column, parts: int, name: str = "n") -> DataFrame:
    """Exact 1-based row number over a whole table, dealt out over ``parts`` tasks.

    Consecutive chunks share a task, which sorts its rows by the one column alone; a row's number is its place there plus the
    rows of earlier tasks. Chunks are counted first and should be many more than ``parts``.
    """
    rows = df.withColumn("_chunk", chunk)
    counts = rows.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(_along([]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shares = counts.select("_chunk", before.alias("_from"), F.sum("_n").over(W.partitionBy(F.lit(0))).alias("_all"))
    shares = shares.withColumn("_part", F.floor(F.col("_from") / F.col("_all") * parts).cast("int"))
    earlier = F.min("_from").over(W.partitionBy("_part")).alias("_earlier")
    shares = cut(shares.select(F.col("_chunk").alias("_c"), "_part", earlier), "shares")
    dealt = rows.join(shares, F.col("_chunk").eqNullSafe(F.col("_c"))).drop("_chunk", "_c")
    dealt = dealt.repartitionById(parts, F.col("_part")).sortWithinPartitions(order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the upper bits are the task
    return dealt.withColumn(name, place + F.col("_earlier") + 1).drop("_part", "_earlier")


def neighbours(
    df: DataFrame, keys: Sequence[str], order: Sequence, chunk: Column,
    previous: Mapping[str, str] | None = None, following: Mapping[str, str] | None = None,
) -> DataFrame:
    """Adds lag (``previous``) and lead (``following``) columns, each mapping a new name to a column."""
    keys, previous, following = list(keys), dict(previous or {}), dict(following or {})
    rows = _chunked(df, keys, chunk)
    inside = W.partitionBy("_g").orderBy(*order)
    rows = rows.withColumn("_i", F.row_number().over(inside))
    rows = rows.withColumns({n: F.lag(c).over(inside) for n, c in previous.items()})
    rows = rows.withColumns({n: F.lead(c).over(inside) for n, c in following.items()})
    edge = rows.groupBy("_g").agg(
        F.max("_i").alias("_last"),
        *[F.max_by(c, "_i").alias(f"_p_{n}") for n, c in previous.items()],
        *[F.min_by(c, "_i").alias(f"_f_{n}") for n, c in following.items()],
    ).select("*", *_with_keys(keys))
    along = _along(keys)
    edge = edge.select(
        "_g", "_last",
        *[F.lag(f"_p_{n}").over(along).alias(f"_p_{n}") for n in previous],
        *[F.lead(f"_f_{n}").over(along).alias(f"_f_{n}") for n in following],
    )
    out = rows.join(edge, "_g")
    out = out.withColumns({n: F.when(F.col("_i") == 1, F.col(f"_p_{n}")).otherwise(F.col(n)) for n in previous})
    out = out.withColumns(
        {n: F.when(F.col("_i") == F.col("_last"), F.col(f"_f_{n}")).otherwise(F.col(n)) for n in following}
    )
    return out.drop("_chunk", "_g", "_i", "_last", *[f"_p_{n}" for n in previous], *[f"_f_{n}" for n in following])


def last_known(df: DataFrame, keys: Sequence[str], order: Sequence, chunk: Column, fills: Mapping[str, str]) -> DataFrame:
    """Adds the latest non-null value at or before the row (forward fill, as-of lookup)."""
    keys = list(keys)
    rows = _chunked(df, keys, chunk)
    inside = W.partitionBy("_g").orderBy(*order)
    rows = rows.withColumn("_i", F.row_number().over(inside))
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({n: F.last(c, ignorenulls=True).over(upto) for n, c in fills.items()})
    tail = rows.groupBy("_g").agg(*[F.max_by(n, "_i").alias(f"_c_{n}") for n in fills]).select("*", *_with_keys(keys))
    before = _along(keys).rowsBetween(W.unboundedPreceding, -1)
    tail = tail.select("_g", *[F.last(f"_c_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in fills])
    out = rows.join(tail, "_g")
    return out.withColumns({n: F.coalesce(n, f"_c_{n}") for n in fills}).drop("_chunk", "_g", "_i", *[f"_c_{n}" for n in fills])


def with_context(df: DataFrame, keys: Sequence[str], at: str, width: float, span: float | None = None) -> DataFrame:
    """Rows cut into time spans, each span repeated with the ``width`` seconds before it.

    ``at`` is in seconds. Adds ``_span`` and ``_own`` (false on the repeated context rows). A trailing
    frame over (keys, _span) then sees everything it needs, and a key is spread over its spans.
    """
    span = max(float(span or width), float(width))
    t = F.col(at)
    first, last = F.floor(t / span), F.floor((t + F.lit(float(width))) / span)
    return (
        df.withColumn("_home", first.cast("bigint"))
        .withColumn("_span", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))
        .withColumn("_own", F.col("_span") == F.col("_home"))
        .drop("_home")
    )
