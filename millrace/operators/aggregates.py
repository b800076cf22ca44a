"""Grouped reports: audit counts, facets, shares, histograms, counters, statistics bundles, batches."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from millrace.plans.joins import one_row, salted_join
from millrace.plans.ranks import index_rank, linear_quantiles, order_stats, value_ranks
from millrace.plans.runs import numbered
from millrace.session import cut

# Default upper bounds of a latency histogram.
BUCKET_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10)


def grouped_counts(df: DataFrame, cuts: Mapping[str, Column], measures: Mapping[str, Column] | None = None) -> DataFrame:
    """Independent group counts in one pass: rows (cut, key, n, ...)."""
    measures = dict(measures or {"n": F.count(F.lit(1))})
    items = F.array(*[F.struct(F.lit(name).alias("cut"), col.cast("string").alias("key")) for name, col in cuts.items()])
    return (
        df.withColumn("_e", F.explode(items)).groupBy("_e.cut", "_e.key").agg(*[m.alias(n) for n, m in measures.items()])
    )


def audit_report(log: DataFrame, newest: int, order: Sequence[Column]) -> DataFrame:
    """Counts by operation, entity type and outcome over the newest entries."""
    last = log.orderBy(*order).limit(newest)
    sets = last.groupingSets([["operation"], ["entity_type"], ["success"]], "operation", "entity_type", "success")
    out = sets.agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    cut = F.when(F.col("_g") == 3, "operation").when(F.col("_g") == 5, "entity_type").otherwise("success")
    return out.select(cut.alias("cut"), F.coalesce("operation", "entity_type", F.col("success").cast("string")).alias("key"), "n")


def facets(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows (field, value, n); a list counts each of its values, null and '' count as absent."""

    def pairs(name: str) -> Column:
        col = F.col(name)
        values = col.cast("array<string>") if df.schema[name].dataType.typeName() == "array" else F.array(col.cast("string"))
        named = F.transform(values, lambda v: F.struct(F.lit(name).alias("field"), v.alias("value")))
        return F.coalesce(named, F.array().cast(FACET_PAIRS))

    long = df.select(F.explode(F.concat(*[pairs(f) for f in fields])).alias("e")).select("e.*")
    return long.where("value IS NOT NULL AND value <> ''").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


FACET_PAIRS = "array<struct<field:string,value:string>>"


def share_rollup(df: DataFrame, key: str, size: str, lines: str, known: Column | None = None) -> DataFrame:
    """Files, bytes, lines per key and the share of the bytes of all known keys, in percent."""
    grouped = df.where(F.col(key).isNotNull() if known is None else known).groupBy(key).agg(
        F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes"), F.sum(lines).alias("lines")
    )
    total = grouped.agg(F.sum("bytes").alias("b")).scalar()
    return grouped.withColumn("percent", F.col("bytes") * 100.0 / total)


def primary_key_by(df: DataFrame, groups: Sequence[str], key: str, size: str) -> DataFrame:
    """The key with the largest total size per group, the smaller key on ties."""
    totals = df.groupBy(*groups, key).agg(F.sum(size).alias("_b"))
    return totals.groupBy(*groups).agg(F.min_by(key, F.struct(-F.col("_b"), F.col(key))).alias(f"primary_{key}"))


def histogram(df: DataFrame, keys: Sequence[str], value: str, bounds: Sequence[float] = BUCKET_BOUNDS) -> DataFrame:
    """Cumulative buckets: rows (keys, le, n), with the count, sum and mean of the group on every row."""
    wide = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        *[F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(bounds)],
        F.count(F.lit(1)).alias("total"), F.sum(value).alias("sum"), F.avg(value).alias("mean"),
    )
    rows = [F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"_b{i}").alias("n")) for i, b in enumerate(bounds)]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("total").alias("n")))
    return wide.select(*keys, F.explode(F.array(*rows)).alias("e"), "total", "sum", "mean").select(
        *keys, "e.le", "e.n", "total", "sum", "mean"
    )


def outcome_rates(df: DataFrame, keys: Sequence[str], success: Column) -> DataFrame:
    """Successes, failures and their rates per key; a key without rows does not appear."""
    n = F.count(F.lit(1))
    return df.groupBy(*keys).agg(
        n.alias("total"), F.count_if(success).alias("succeeded"), F.count_if(~success).alias("failed"),
        (F.count_if(success) / n).alias("success_rate"), (F.count_if(~success) / n).alias("failure_rate"),
    )


def conditional_counts(df: DataFrame, keys: Sequence[str], tests: Mapping[str, Column]) -> DataFrame:
    aggs = [F.count_if(test).alias(name) for name, test in tests.items()]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def stats_bundle(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean, median, min, max, sample deviation and variance, index percentiles, and the MAD.

    Order statistics follow `plans.ranks`; the MAD takes a second round over absolute deviations. The
    result of the first round, one row per key, is written out, or the second would plan and run it anew.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull())
    ranks = {"p50": index_rank(0.5), "p95": index_rank(0.95), "p99": index_rank(0.99)}
    ranks["_lo"] = lambda n: F.floor((n - 1) / 2) + 1
    ranks["_hi"] = lambda n: F.ceil((n - 1) / 2) + 1
    order = order_stats(rows, value, ranks, keys)
    order = cut(order.withColumn("median", (F.col("_lo") + F.col("_hi")) / 2).drop("_lo", "_hi", "n"), "order")
    moments = rows.groupBy(*keys).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.stddev_samp(value).alias("stdev"), F.var_samp(value).alias("variance"),
    )
    if keys:
        # Null keys are groups too: joins go over the struct of the keys, which is never null.
        group = F.struct(*keys).alias("_k")
        centred = salted_join(rows.select(group, *keys, value), order.select(group, F.col("median").alias("_m")), ["_k"], [value])
    else:
        centred = rows.select(value, one_row(order)["median"].alias("_m"))
    off = centred.withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    mad = linear_quantiles(off, "_d", {"mad": 0.5}, keys).drop("n")
    if keys:
        sides = [side.select(group, *[c for c in side.columns if c not in keys]) for side in (order, mad)]
        out = moments.withColumn("_k", F.struct(*keys))
        for side in sides:
            out = out.join(side, "_k")
        return out.drop("_k")
    o, d = one_row(order), one_row(mad)
    return moments.withColumns({**{c: o[c] for c in order.columns}, "mad": d["mad"]})


def in_batches(df: DataFrame, keys: Sequence[str], order: Sequence, chunk: Column, size: int = 100) -> DataFrame:
    """Adds ``batch``: consecutive runs of at most ``size`` rows per key."""
    return numbered(df, keys, order, chunk, "_n").withColumn("batch", F.ceil(F.col("_n") / size).cast("bigint")).drop("_n")


def aggregate_similar(df: DataFrame, groups: Sequence[str], event: str, payload: str, at: str, priority: str) -> DataFrame:
    """Merges events of one batch with the same groups and event type.

    ``groups`` must include a batch number, so an item list holds at most one batch. A single event keeps
    its type; a merged one is named ``<type>.batch`` and takes the earliest time and highest priority.
    """
    items = F.sort_array(F.collect_list(F.struct(at, payload)))
    out = df.groupBy(*groups, event).agg(
        F.count(F.lit(1)).alias("count"), F.transform(items, lambda x: x[payload]).alias("items"),
        F.min(at).alias(at), F.max(priority).alias(priority),
    )
    return out.withColumn(event, F.when(F.col("count") > 1, F.concat(event, F.lit(".batch"))).otherwise(F.col(event)))


def ranked_share(df: DataFrame, value: str) -> DataFrame:
    """Adds the share of the total and the rank by value, equal values sharing the better rank."""
    total = df.agg(F.sum(value).alias("t")).scalar()
    spread = [c for c in df.columns if c != value] or [value]
    return salted_join(df, value_ranks(df, value), [value], spread, "left").withColumn("share", F.col(value) / total)


def exposition_lines(counters: DataFrame | None = None, gauges: DataFrame | None = None, histograms: DataFrame | None = None) -> DataFrame:
    """Metric tables as text lines (name, seq, line): a TYPE header per metric, then its samples.

    counters and gauges: (name, value); histograms: (name, le, n, total, sum).
    """
    frames = []
    for table, kind in ((counters, "counter"), (gauges, "gauge")):
        if table is not None:
            head = F.struct(F.lit(0).alias("seq"), F.concat(F.lit("# TYPE "), "name", F.lit(f" {kind}")).alias("line"))
            body = F.struct(F.lit(1).alias("seq"), F.concat_ws(" ", "name", F.col("value").cast("string")).alias("line"))
            frames.append(table.select("name", F.explode(F.array(head, body)).alias("e")).select("name", "e.*"))
    if histograms is not None:
        at = F.when(F.col("le") == "+Inf", F.lit(float("inf"))).otherwise(F.col("le").cast("double"))
        position = F.rank().over(W.partitionBy("name").orderBy(at))
        rows = histograms.withColumn("seq", position)
        line = F.concat("name", F.lit('_bucket{le="'), "le", F.lit('"} '), "n")
        frames.append(rows.select("name", "seq", line.alias("line")))
        tails = histograms.where("le = '+Inf'").select("name", F.explode(F.array(
            F.struct(F.lit(0).alias("seq"), F.concat(F.lit("# TYPE "), "name", F.lit(" histogram")).alias("line")),
            F.struct(F.lit(100000).alias("seq"), F.concat("name", F.lit("_sum "), "sum").alias("line")),
            F.struct(F.lit(100001).alias("seq"), F.concat("name", F.lit("_count "), "total").alias("line")),
        )).alias("e")).select("name", "e.*")
        frames.append(tails)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
