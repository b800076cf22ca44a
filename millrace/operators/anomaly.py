"""Anomaly detection over metric points, alerts with a cooldown, and delivery health.

Points are rows with a metric key, a time in seconds and a value. Every detector looks at the trailing
window of the same metric, the current point included.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from millrace.plans.joins import salted_join
from millrace.plans.runs import numbered, running_sums, with_context
from millrace.plans.silences import firings
from millrace.plans.topn import at_most
from millrace.plans.wavelet import sliding_stats
from millrace.plans.windows import block_prefixes, sliding_moments, sliding_sums

SEVERITIES = ("critical", "high", "medium", "low", "info")


def resource_severity(col: Column) -> Column:
    """Position in the order critical, high, medium, low, info; unknown words come last."""
    at = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), col)
    return F.when(at > 0, at).otherwise(len(SEVERITIES) + 1)


def _grade(score: Column, critical: float, high: float, medium: float) -> Column:
    return F.when(score > critical, "critical").when(score > high, "high").when(score > medium, "medium").otherwise("low")


def _found(df: DataFrame, method: str, kind: Column, severity: Column, deviation: Column, confidence: Column) -> DataFrame:
    return df.withColumns(
        {"method": F.lit(method), "kind": kind, "severity": severity, "deviation": deviation, "confidence": confidence}
    )


def zscore_anomalies(df: DataFrame, keys: Sequence[str], at: str, value: str, width: float = 300, threshold: float = 3.0, min_samples: int = 10) -> DataFrame:
    """Points more than ``threshold`` sample deviations from the window mean."""
    rows = sliding_moments(df, keys, at, value, width)
    z = F.abs((F.col(value) - F.col("win_mean")) / F.when(F.col("win_std") > 0, F.col("win_std")))
    rows = rows.withColumn("_z", z).where((F.col("win_n") >= min_samples) & (F.col("_z") > threshold))
    kind = F.when(F.col(value) > F.col("win_mean"), "spike").otherwise("drop")
    sure = F.least(F.lit(0.99), 0.5 + (F.col("_z") - threshold) * 0.1)
    return _found(rows, "zscore", kind, _grade(F.col("_z"), 5, 4, 3.5), F.col("_z"), sure).drop("_z")


def window_order_stats(df: DataFrame, keys: Sequence[str], at: str, value: str, width: float, tie: str) -> DataFrame:
    """Adds win_n, index quartiles win_q1 and win_q3, win_median and win_mad of the trailing window.

    One Python task per key and time span; it holds that span and the window before it as a wavelet matrix, which all
    windows query together, so the work grows with the points and not with the points of a window.
    """
    rows = with_context(df, keys, at, width)
    extra = ["win_q1", "win_q3", "win_median", "win_mad"]
    schema = T.StructType(
        [*df.schema.fields, T.StructField("win_n", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in extra]]
    )
    names, given = schema.names, df.columns

    def slide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([at, tie], kind="stable").reset_index(drop=True)
        own = np.flatnonzero(pdf["_own"].to_numpy())
        stats = sliding_stats(pdf[at].to_numpy(), pdf[value].to_numpy(dtype=float), width, own)
        pdf = pdf.loc[own, given]
        pdf["win_n"] = stats[:, 0].astype("int64")
        for j, name in enumerate(extra):
            pdf[name] = stats[:, j + 1]
        return pdf[names]

    return rows.groupBy(*keys, "_span").applyInPandas(slide, schema)


def _verdict(method: str, kind: Column, severity: Column, deviation: Column, confidence: Column) -> Column:
    return F.struct(
        F.lit(method).alias("method"), kind.alias("kind"), severity.alias("severity"), deviation.alias("deviation"), confidence.alias("confidence")
    )


def _iqr_verdict(value: str, min_samples: int) -> Column:
    """Beyond 1.5 interquartile ranges of the window, quartiles taken by index; null where not."""
    iqr = F.col("win_q3") - F.col("win_q1")
    above = F.col(value) - (F.col("win_q3") + 1.5 * iqr)
    below = F.col("win_q1") - 1.5 * iqr - F.col(value)
    off = F.greatest(above, below) / F.when(iqr != 0, iqr)
    kind = F.when(above > 0, "spike").otherwise("drop")
    verdict = _verdict("iqr", kind, _grade(off, 3, 2, 1), off, F.least(F.lit(0.95), 0.6 + off * 0.1))
    return F.when((F.col("win_n") >= min_samples) & (off > 0), verdict)


def _mad_verdict(value: str, threshold: float, min_samples: int) -> Column:
    """Modified z-score (0.6745 times the deviation over the MAD) above the threshold; null where not."""
    score = F.lit(0.6745) * F.abs(F.col(value) - F.col("win_median")) / F.when(F.col("win_mad") != 0, F.col("win_mad"))
    kind = F.when(F.col(value) > F.col("win_median"), "spike").otherwise("drop")
    verdict = _verdict("mad", kind, _grade(score, 5, 4, 3.5), score, F.least(F.lit(0.97), 0.55 + (score - threshold) * 0.1))
    return F.when((F.col("win_n") >= min_samples) & (score > threshold), verdict)


def order_anomalies(
    df: DataFrame, keys: Sequence[str], at: str, value: str, tie: str, width: float = 300, threshold: float = 3.0, min_samples: int = 10,
    methods: Sequence[str] = ("iqr", "mad"),
) -> DataFrame:
    """The detectors that need order statistics, both from one pass over the sorted windows."""
    known = {"iqr": _iqr_verdict(value, min_samples), "mad": _mad_verdict(value, threshold, min_samples)}
    rows = window_order_stats(df, keys, at, value, width, tie)
    hits = F.explode(F.array_compact(F.array(*[known[m] for m in methods])))
    return rows.withColumn("_e", hits).select("*", "_e.*").drop("_e")


def iqr_anomalies(df: DataFrame, keys: Sequence[str], at: str, value: str, tie: str, width: float = 300, min_samples: int = 10) -> DataFrame:
    return order_anomalies(df, keys, at, value, tie, width, min_samples=min_samples, methods=["iqr"])


def mad_anomalies(df: DataFrame, keys: Sequence[str], at: str, value: str, tie: str, width: float = 300, threshold: float = 3.0, min_samples: int = 10) -> DataFrame:
    return order_anomalies(df, keys, at, value, tie, width, threshold, min_samples, ["mad"])


def half_means(df: DataFrame, keys: Sequence[str], at: str, tie: str, value: str, width: float) -> DataFrame:
    """Adds win_n, first_mean and second_mean: means of the older and newer half of the window's points.

    Prefix sums at the three borders of a window, within blocks as wide as the window, give both means: no window is ever
    copied, and nothing but the cells of a block is gathered.
    """
    keys = list(keys)
    if "win_n" not in df.columns:
        df = sliding_sums(df, keys, at, width, {"win_n": F.lit(1).cast("bigint")})
    rows = block_prefixes(df, keys, at, tie, value, width)
    # The struct key is never null, so points of a metric without a name keep their window.
    key = F.struct(*keys, F.lit(0).alias("_all"))
    block = F.col("_block")
    totals = rows.groupBy(key.alias("_w"), (block + 1).alias("_next")).agg(F.max("_total").alias("_earlier"))
    own = rows.withColumns({"_w": key, "_lo": F.col("_hi") - F.col("win_n"), "_half": F.floor(F.col("win_n") / 2), "_next": block})
    own = own.withColumn("_mid", F.col("_lo") + F.col("_half")).join(totals, ["_w", "_next"], "left")
    prefix = rows.select(key.alias("_w"), F.col("_i").alias("_at"), F.struct(block.alias("b"), F.col("_s").alias("s")).alias("_p"))
    for border in ("_lo", "_mid"):
        own = own.join(prefix.select("_w", F.col("_at").alias(border), F.col("_p").alias(f"_p{border}")), ["_w", border], "left")
    earlier = F.coalesce("_earlier", F.lit(0.0))
    # sums from the start of the block before the row's own, nothing lying further back in the window
    upto = lambda p: F.when(p["b"] == block, earlier + p["s"]).when(p["b"] == block - 1, p["s"]).otherwise(0.0)
    low, mid, high = upto(F.col("_p_lo")), upto(F.col("_p_mid")), earlier + F.col("_shi")
    first = (mid - low) / F.when(F.col("_half") > 0, F.col("_half"))
    second = (high - mid) / (F.col("win_n") - F.col("_half"))
    return own.withColumns({"first_mean": first, "second_mean": second}).select(*df.columns, "first_mean", "second_mean")


def trend_anomalies(df: DataFrame, keys: Sequence[str], at: str, value: str, tie: str, width: float = 600, threshold: float = 1.5, min_samples: int = 20) -> DataFrame:
    """Windows whose halves differ by more than ``threshold`` sample deviations.

    The difference cannot exceed about two deviations, so a threshold of 3 finds nothing.
    """
    rows = half_means(sliding_moments(df, keys, at, value, width), keys, at, tie, value, width)
    ratio = F.abs(F.col("second_mean") - F.col("first_mean")) / F.when(F.col("win_std") > 0, F.col("win_std"))
    rows = rows.withColumn("_r", ratio).where((F.col("win_n") >= min_samples) & (F.col("_r") > threshold))
    severity = F.when(F.col("_r") > 5, "high").otherwise("medium")
    sure = F.least(F.lit(0.9), 0.5 + F.col("_r") * 0.05)
    return _found(rows, "trend_change", F.lit("trend_change"), severity, F.col("_r"), sure).drop("_r")


def detect(df: DataFrame, keys: Sequence[str], at: str, value: str, tie: str, width: float = 300, trend_width: float = 600, trend_threshold: float = 1.5) -> DataFrame:
    """Union of all detectors: one row per point and method that flags it."""
    keep = [*df.columns, "method", "kind", "severity", "deviation", "confidence"]
    found = [
        zscore_anomalies(df, keys, at, value, width),
        order_anomalies(df, keys, at, value, tie, width),
        trend_anomalies(df, keys, at, value, tie, trend_width, trend_threshold),
    ]
    out = found[0].select(*keep)
    for f in found[1:]:
        out = out.unionByName(f.select(*keep))
    return out


METHOD_ORDER = ("zscore", "iqr", "mad", "trend_change")


def first_anomaly(anomalies: DataFrame, point: Sequence[str]) -> DataFrame:
    """One row per point: kind of its first method, number of methods, and the worst severity."""
    order = F.array_position(F.array(*[F.lit(m) for m in METHOD_ORDER]), F.col("method"))
    return anomalies.groupBy(*point).agg(
        F.min_by("kind", order).alias("kind"), F.count(F.lit(1)).alias("methods"),
        F.min_by("severity", resource_severity(F.col("severity"))).alias("severity"),
    )


def with_cooldown(df: DataFrame, keys: Sequence[str], at: str, cooldown: float = 300, chunk_seconds: float = 86400) -> DataFrame:
    """Times (keys, at) that fire when a firing silences the key for ``cooldown`` seconds; a key may be busy throughout.

    A task holds the distinct times of one key in one chunk, so ``chunk_seconds`` sets its size; it changes no result.
    """
    return firings(df, keys, at, cooldown, F.floor(F.col("_at") / chunk_seconds))


def alert_list(alerts: DataFrame, severity: str | None = None, since: float | None = None, at: str = "t", only_open: bool = False, limit: int | None = None) -> DataFrame:
    """Alerts newest first, by severity, time and whether they are still unacknowledged."""
    if severity is not None:
        alerts = alerts.where(F.col("severity") == severity)
    if since is not None:
        alerts = alerts.where(F.col(at) > since)
    if only_open:
        alerts = alerts.where(~F.col("acknowledged"))
    return at_most(alerts.orderBy(F.desc(at), *[c for c in alerts.columns if c != at]), limit)


def final_ema(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, value: str, alpha: float = 0.3, start: float = 0.0) -> DataFrame:
    """Exponential moving average after the last row of each key.

    A run of rows acts on the average as ``x -> a*x + b``. Each chunk is reduced to its (a, b); folding
    those in order is the whole history, and a key holds one pair per chunk.
    """
    keys = list(keys)
    rows = df.withColumn("_chunk", chunk)
    inside = W.partitionBy(*keys, "_chunk")
    rows = rows.withColumns({"_i": F.row_number().over(inside.orderBy(*order)), "_m": F.count(F.lit(1)).over(inside)})
    weight = F.lit(alpha) * F.pow(F.lit(1.0 - alpha), F.col("_m") - F.col("_i"))
    pairs = rows.groupBy(*keys, "_chunk").agg(
        F.pow(F.lit(1.0 - alpha), F.max("_m")).alias("a"), F.sum(weight * F.col(value)).alias("b")
    )
    steps = F.array_sort(F.collect_list(F.struct("_chunk", "a", "b")))
    fold = F.aggregate(steps, F.lit(float(start)), lambda x, s: x * s["a"] + s["b"])
    return pairs.groupBy(*keys).agg(fold.alias("ema"))


def failure_score(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, failed: Column) -> DataFrame:
    """Score that rises by 1 per failure and falls by 1 per success, never below 0, after the last row.

    A run of rows acts on the score as ``x -> max(x + a, b)``, which again composes over chunks.
    """
    keys = list(keys)
    rows = df.withColumns({"_chunk": chunk, "_d": F.when(failed, 1).otherwise(-1)})
    upto = W.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_p", F.sum("_d").over(upto))
    pairs = rows.groupBy(*keys, "_chunk").agg(F.sum("_d").alias("a"), (F.sum("_d") - F.min("_p")).alias("b"))
    steps = F.array_sort(F.collect_list(F.struct("_chunk", "a", "b")))
    fold = F.aggregate(steps, F.lit(0).cast("bigint"), lambda x, s: F.greatest(x + s["a"], s["b"]))
    return pairs.groupBy(*keys).agg(fold.alias("failure_score"))


def endpoint_health(log: DataFrame, endpoint: str, order: Sequence[str], chunk: Column, success: Column, latency: str, limit: int = 5) -> DataFrame:
    """Latency average over successes, failure score, health, and rank by latency among healthy endpoints."""
    ema = final_ema(log.where(success), [endpoint], order, chunk, latency)
    score = failure_score(log, [endpoint], order, chunk, ~success)
    ema = ema.withColumnRenamed(endpoint, "_e")
    out = score.join(ema, F.col(endpoint).eqNullSafe(F.col("_e")), "left").drop("_e").withColumns(
        {"ema": F.coalesce("ema", F.lit(0.0)), "healthy": F.col("failure_score") < limit}
    )
    rank = F.rank().over(W.partitionBy("healthy").orderBy("ema"))  # one row per endpoint
    return out.withColumn("latency_rank", F.when(F.col("healthy"), rank))


def streaks(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, failed: Column) -> DataFrame:
    """Adds ``streak``: failures in a row up to and including the row (0 on a success)."""
    keys = list(keys)
    rows = running_sums(df, keys, order, chunk, {"_island": F.when(failed, 0).otherwise(1)})
    out = running_sums(rows, [*keys, "_island"], order, chunk, {"streak": F.when(failed, 1).otherwise(0)})
    return out.drop("_island")


def outage_intervals(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, at: str, failed: Column, threshold: int = 5) -> DataFrame:
    """Runs of at least ``threshold`` failures: opened at the failure that reached it, last failure, length."""
    keys = list(keys)
    rows = running_sums(df, keys, order, chunk, {"_island": F.when(failed, 0).otherwise(1)})
    rows = rows.where(failed)
    rows = numbered(rows, [*keys, "_island"], order, chunk, "_k")
    out = rows.groupBy(*keys, "_island").agg(
        F.count(F.lit(1)).alias("failures"), F.min(F.when(F.col("_k") == threshold, F.col(at))).alias("opened_at"),
        F.max(at).alias("last_failure"),
    )
    return out.where(F.col("failures") >= threshold).drop("_island")


def failure_rate_breaches(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, failed: Column, rate: float, min_throughput: int) -> DataFrame:
    """Rows at which the running failure rate of the key is at least ``rate`` with enough requests seen."""
    rows = running_sums(df, keys, order, chunk, {"requests": F.lit(1), "failures": F.when(failed, 1).otherwise(0)})
    return rows.where((F.col("requests") >= min_throughput) & (F.col("failures") / F.col("requests") >= rate))


def frequent_failures(df: DataFrame, keys: Sequence[str], at: str, failed: Column, width: float = 3600, threshold: int = 5) -> DataFrame:
    """Failures that make at least ``threshold`` failures of the key within the trailing ``width`` seconds."""
    return sliding_sums(df.where(failed), keys, at, width, {"recent_failures": F.lit(1).cast("bigint")}).where(F.col("recent_failures") >= threshold)


def rate_breaches(df: DataFrame, keys: Sequence[str], at: str, limit: int = 100, width: float = 60) -> DataFrame:
    """Requests that bring the offered rate of a client above ``limit`` per ``width`` seconds."""
    return sliding_sums(df, keys, at, width, {"offered": F.lit(1).cast("bigint")}).where(F.col("offered") > limit)


def rolling_means(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, columns: Sequence[str], rows: int = 30) -> DataFrame:
    """Adds ``<c>_mean`` over the current and the previous ``rows - 1`` rows of the key."""
    keys = list(keys)
    placed = numbered(df, keys, order, chunk, "_n")
    framed = with_context(placed, keys, "_n", rows - 1, span=64 * rows)
    w = W.partitionBy(*keys, "_span").orderBy("_n").rangeBetween(-(rows - 1), 0)
    out = framed.withColumns({f"{c}_mean": F.avg(c).over(w) for c in columns})
    return out.where("_own").drop("_n", "_span", "_own")


def recommendations(means: DataFrame, pool_size: int = 10, batch_size: int = 100, latency_target: float = 100.0, batch_target: float = 1000.0) -> DataFrame:
    """Advice per row of rolling means (memory, connections, latency): rows (category, priority, suggested)."""
    memory, conn, lat = F.col("memory_mean"), F.col("connections_mean"), F.col("latency_mean")

    def item(category: str, priority: Column, suggested: Column) -> Column:
        return F.struct(F.lit(category).alias("category"), priority.alias("priority"), suggested.cast("int").alias("suggested"))

    nothing = F.lit(0)
    items = F.array_compact(F.array(
        F.when(memory > 0.7, item("memory", F.when(memory > 0.8, "high").otherwise("medium"), nothing)),
        F.when(conn > pool_size * 0.8, item("connections", F.lit("medium"), F.lit(int(pool_size * 1.5)))),
        F.when(lat > latency_target * 2, item("performance", F.lit("high"), nothing)),
        F.when(lat > batch_target * 1.5, item("batch_size", F.lit("medium"), F.lit(int(batch_size * 0.8))))
        .when(lat < batch_target * 0.5, item("batch_size", F.lit("low"), F.lit(int(batch_size * 1.2)))),
    ))
    return means.withColumn("_e", F.explode(items)).select("*", "_e.*").drop("_e")



def delivery_report(log: DataFrame, keys: Sequence[str], success: Column, latency: str, retries: Column) -> DataFrame:
    """Deliveries, success rate, retries and latency figures per key."""
    n = F.count(F.lit(1))
    return log.groupBy(*keys).agg(
        n.alias("deliveries"), (F.count_if(success) / n).alias("success_rate"), F.sum(retries).alias("retries"),
        F.avg(latency).alias("mean_latency"), F.max(latency).alias("max_latency"),
    )


def acknowledge(alerts: DataFrame, ids: DataFrame, key: str = "alert_id") -> DataFrame:
    done = ids.select(key).distinct().withColumn("_done", F.lit(True))
    spread = [c for c in alerts.columns if c != key] or [key]
    out = salted_join(alerts, done, [key], spread, "left")
    return out.withColumn("acknowledged", F.col("acknowledged") | F.coalesce("_done", F.lit(False))).drop("_done")


def count_by(df: DataFrame, tests: Mapping[str, Column]) -> DataFrame:
    return df.agg(*[F.count_if(t).alias(n) for n, t in tests.items()])
