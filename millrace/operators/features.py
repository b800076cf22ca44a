"""Feature engineering: date parts, encoders, scalers, interactions, selection."""
from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.plans.joins import one_row, salted_join
from millrace.plans.ranks import linear_quantiles

MISSING = "<NA>"


def date_parts(col: Column, prefix: str, sep: str = "_", weekend: bool = False) -> dict[str, Column]:
    """Year, month, day, hour, weekday (Monday 0) and quarter, named ``prefix + sep + part``."""
    parts = {
        "year": F.year(col), "month": F.month(col), "day": F.day(col), "hour": F.hour(col),
        "dayofweek": F.weekday(col), "quarter": F.quarter(col),
    }
    if weekend:
        parts["is_weekend"] = (F.weekday(col) >= 5).cast("int")
    return {f"{prefix}{sep}{k}": v for k, v in parts.items()}


def datetime_features(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Parts of every column whose name holds "date" or "time", as ``<c>__dt_<part>``."""
    if columns is None:
        columns = [c for c in df.columns if "date" in c.lower() or "time" in c.lower()]
    for c in columns:
        stamp = F.col(c) if not isinstance(df.schema[c].dataType, T.StringType) else F.try_to_timestamp(F.col(c))
        df = df.withColumns(date_parts(stamp, c, "__dt_", weekend=True))
    return df


def one_hot(df: DataFrame, col: str, values: Sequence[str], dummy_na: bool = False, drop: bool = False) -> DataFrame:
    """Indicator columns for the given values, optionally one for null."""
    flags = {f"{col}_{v}": F.coalesce(F.col(col) == v, F.lit(False)).cast("int") for v in values}
    if dummy_na:
        flags[f"{col}_nan"] = F.col(col).isNull().cast("int")
    out = df.withColumns(flags)
    return out.drop(col) if drop else out


def category_levels(df: DataFrame, col: str, at_most: int = 10) -> list[str] | None:
    """Sorted levels of a low-cardinality column, or None beyond ``at_most``; reads at most one row more."""
    rows = df.select(F.col(col).cast("string").alias("v")).where("v IS NOT NULL").distinct().limit(at_most + 1).collect()
    return sorted(r.v for r in rows) if len(rows) <= at_most else None


def label_encode(df: DataFrame, col: str, at: str | None = None) -> DataFrame:
    """Adds ``<c>_encoded``: position of the value in sorted order, null counted as ''.

    The codes are a table joined back (broadcast only if Spark measures it small), so the vocabulary is
    not limited by the driver. Numbering runs per four-character prefix, not in one sorted task.
    """
    from millrace.plans.runs import numbered

    name = at or f"{col}_encoded"
    text = F.coalesce(F.col(col).cast("string"), F.lit(""))
    levels = df.select(text.alias("_level")).distinct()
    codes = numbered(levels, [], ["_level"], F.substring("_level", 1, 4), name)
    codes = codes.withColumn(name, F.col(name) - 1)
    spread = [c for c in df.columns if c != col] or [col]
    return salted_join(df.withColumn("_level", text), codes, ["_level"], spread, "left").drop("_level")


def frequency_encode(df: DataFrame, col: str, at: str | None = None) -> DataFrame:
    """Adds the share of rows that hold the same value; null counts as its own value."""
    value = F.coalesce(F.col(col).cast("string"), F.lit(MISSING))
    counts = df.groupBy(value.alias("_level")).agg(F.count(F.lit(1)).alias("_c"))
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    shares = counts.select("_level", (F.col("_c") / total).alias(at or f"{col}__freq"))
    spread = [c for c in df.columns if c != col] or [col]
    return salted_join(df.withColumn("_level", value), shares, ["_level"], spread, "left").drop("_level")


def target_mapping(df: DataFrame, col: str, target: str, problem: str) -> DataFrame:
    """Encoding table (level, encoding, global): mean target, or share of the modal class, per level."""
    level = F.coalesce(F.col(col).cast("string"), F.lit(MISSING)).alias("level")
    if problem == "classification":
        classes = df.where(F.col(target).isNotNull()).groupBy(F.col(target).alias("_y")).agg(F.count(F.lit(1)).alias("_n"))
        top = classes.agg(F.min_by("_y", F.struct(-F.col("_n"), F.col("_y"))).alias("y")).scalar()
        score = (F.col(target) == top).cast("double")
    else:
        score = F.col(target).cast("double")
    base = df.select(level, score.alias("_s"))
    everywhere = base.agg(F.avg("_s").alias("g")).scalar()
    return base.groupBy("level").agg(F.avg("_s").alias("encoding")).withColumn("global", everywhere)


def target_encode(df: DataFrame, mapping: DataFrame, col: str, at: str | None = None) -> DataFrame:
    """Applies a mapping; a level the mapping lacks gets the global mean."""
    name = at or f"{col}__te"
    fallback = mapping.agg(F.max("global").alias("g")).scalar()
    value = F.coalesce(F.col(col).cast("string"), F.lit(MISSING))
    table = mapping.select(F.col("level").alias("_level"), F.col("encoding").alias(name))
    spread = [c for c in df.columns if c != col] or [col]
    out = salted_join(df.withColumn("_level", value), table, ["_level"], spread, "left").drop("_level")
    return out.withColumn(name, F.coalesce(name, fallback))


def map_encode(df: DataFrame, table: DataFrame, col: str, value: str, default: Column, at: str) -> DataFrame:
    """Lookup of a value in an encoding table (level, value) with a fallback."""
    lookup = table.select(F.col("level").alias(col), F.col(value).alias(at))
    spread = [c for c in df.columns if c != col] or [col]
    return salted_join(df, lookup, [col], spread, "left").withColumn(at, F.coalesce(at, default))


def ordinal_encode(df: DataFrame, col: str, sequence: str, at: str | None = None) -> DataFrame:
    """Codes in order of first appearance along ``sequence``, a column of increasing numbers."""
    from millrace.plans.runs import numbered

    name = at or f"{col}__ord"
    value = F.coalesce(F.col(col).cast("string"), F.lit(MISSING))
    firsts = df.groupBy(value.alias("_level")).agg(F.min(sequence).alias("_first"))
    codes = numbered(firsts, [], ["_first"], F.floor(F.col("_first") / 100000), name)
    codes = codes.select("_level", (F.col(name) - 1).alias(name))
    return salted_join(df.withColumn("_level", value), codes, ["_level"], [sequence], "left").drop("_level")


def scale(df: DataFrame, columns: Sequence[str], method: str = "standard") -> DataFrame:
    """Scales in place; nulls become 0 first. Methods: standard, minmax, robust (all columns in one pass)."""
    df = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    if method == "robust":
        long = unpivot(df, columns)
        q = linear_quantiles(long, "value", {"q1": 0.25, "mid": 0.5, "q3": 0.75}, ["column"])
        picks = [F.max(F.when(F.col("column") == c, F.col(s))).alias(f"{c}|{s}") for c in columns for s in ("q1", "mid", "q3")]
        s = one_row(q.agg(*picks))
        shift = {c: s[f"{c}|mid"] for c in columns}
        width = {c: s[f"{c}|q3"] - s[f"{c}|q1"] for c in columns}
    else:
        aggs = []
        for c in columns:
            aggs += [F.min(c).alias(f"{c}|lo"), F.max(c).alias(f"{c}|hi"), F.avg(c).alias(f"{c}|mean"), F.stddev_pop(c).alias(f"{c}|std")]
        s = one_row(df.agg(*aggs))
        shift = {c: s[f"{c}|lo"] if method == "minmax" else s[f"{c}|mean"] for c in columns}
        width = {c: s[f"{c}|hi"] - s[f"{c}|lo"] if method == "minmax" else s[f"{c}|std"] for c in columns}
    return df.withColumns({c: (F.col(c) - shift[c]) / F.when(width[c] == 0, 1.0).otherwise(width[c]) for c in columns})


def quantile_normal(df: DataFrame, col: str, at: str, bound: float = 1e-7) -> DataFrame:
    """Maps the mid-rank share of each value through the inverse normal distribution.

    Ranks come from counts per distinct value with running totals over ranges of values, so neither the
    rows nor the distinct values are ordered in one task.
    """
    from millrace.plans.ranks import in_value_order

    df = df.withColumn(col, F.coalesce(F.col(col).cast("double"), F.lit(0.0)))
    counts = df.groupBy(F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ranked = in_value_order(counts, {"_to": F.col("_c")})
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    share = (F.col("_to") - (F.col("_c") + 1) / 2) / F.greatest(total - 1, F.lit(1))
    p = F.least(F.greatest(share, F.lit(bound)), F.lit(1 - bound))
    table = ranked.select(F.col("_v").alias(col), inverse_normal(p).alias(at))
    spread = [c for c in df.columns if c != col] or [col]
    return salted_join(df, table, [col], spread)


def normal(x: Column) -> Column:
    """The standard normal distribution function, by the series x + x^3/3 + x^5/(3*5) + ... (absolute error below 1e-12 up to 6)."""
    step = lambda s, k: F.struct((s["term"] * x * x / (2 * k + 1)).alias("term"), (s["sum"] + s["term"] * x * x / (2 * k + 1)).alias("sum"))
    start = F.struct(x.cast("double").alias("term"), x.cast("double").alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(120)), start, step)["sum"]
    return 0.5 + series * F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


# Coefficients of Acklam's published rational approximation of the inverse normal CDF.
_CENTRE_NUM = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_CENTRE_DEN = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_TAIL_NUM = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_TAIL_DEN = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def inverse_normal(p: Column) -> Column:
    """Inverse of the standard normal distribution function, relative error below 1.2e-9."""

    def poly(coefs: Sequence[float], x: Column) -> Column:
        out = F.lit(coefs[0])
        for c in coefs[1:]:
            out = out * x + F.lit(c)
        return out

    low = F.least(p, 1 - p)
    t = F.sqrt(-2 * F.log(low))
    tail = poly(_TAIL_NUM, t) / poly(_TAIL_DEN, t)
    q = p - 0.5
    r = q * q
    centre = poly(_CENTRE_NUM, r) * q / poly(_CENTRE_DEN, r)
    return F.when(low < 0.02425, F.when(p < 0.5, tail).otherwise(-tail)).otherwise(centre)


def unpivot(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form (column, value) of numeric columns."""
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keep, F.explode(items).alias("_e")).select(*keep, "_e.column", "_e.value")


def interactions(df: DataFrame, columns: Sequence[str], max_pairs: int) -> DataFrame:
    """Products of the first ``max_pairs`` pairs in column order; null counts as 0."""
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    pairs = list(combinations(columns, 2))[:max_pairs]
    return df.withColumns({f"{a}__x__{b}": zero(a) * zero(b) for a, b in pairs})


def column_variances(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Population variance per column, nulls as 0, in one pass: rows (column, variance)."""
    wide = df.agg(*[F.var_pop(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in columns])
    return unpivot(wide, columns).withColumnRenamed("value", "variance")


def drop_near_constant(df: DataFrame, columns: Sequence[str], threshold: float = 1e-12) -> DataFrame:
    """Drops the columns whose variance is at most ``threshold``; needs one small job for the column list."""
    flat = column_variances(df, columns).where(F.coalesce(F.col("variance") <= threshold, F.lit(True)))
    return df.drop(*[r["column"] for r in flat.collect()])


def mutual_information(df: DataFrame, columns: Sequence[str], target: str, bins: int = 16) -> DataFrame:
    """Binned mutual information of each numeric column with a discrete target, in nats, best first.

    Values fall into equal-width bins of the column's range; one grouped count over all columns feeds
    the estimate. An approximation of the neighbour-based estimator.
    """
    wide = df.agg(*[f(c).alias(f"{c}|{n}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    s = one_row(wide)
    cell = []
    for c in columns:
        lo, hi = s[f"{c}|lo"].cast("double"), s[f"{c}|hi"].cast("double")
        b = F.floor((F.col(c).cast("double") - lo) / F.when(hi > lo, hi - lo).otherwise(1.0) * bins)
        cell.append(F.struct(F.lit(c).alias("column"), F.least(b, F.lit(bins - 1)).alias("bin")))
    pairs = df.select(F.col(target).cast("string").alias("y"), F.explode(F.array(*cell)).alias("e"))
    joint = pairs.groupBy("e.column", "e.bin", "y").agg(F.count(F.lit(1)).alias("n")).where("bin IS NOT NULL AND y IS NOT NULL")
    from pyspark.sql import Window as W

    joint = joint.withColumns({
        "nx": F.sum("n").over(W.partitionBy("column", "bin")), "ny": F.sum("n").over(W.partitionBy("column", "y")),
        "total": F.sum("n").over(W.partitionBy("column")),
    })
    part = F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("nx") * F.col("ny")))
    return joint.groupBy("column").agg(F.sum(part).alias("mi")).orderBy(F.desc("mi"), "column")


def select_by_information(df: DataFrame, columns: Sequence[str], target: str, threshold: float = 0.0, top: int | None = None) -> list[str]:
    scores = mutual_information(df, columns, target).where(F.col("mi") >= threshold)
    return [r["column"] for r in (scores.limit(top) if top else scores).collect()]


def engineer(
    df: DataFrame, target: str, problem: str, categorical: Mapping[str, str], numeric: Sequence[str], scaler: str = "standard",
    max_pairs: int = 3, sequence: str = "row_id", high_cardinality: int = 10, least_information: float | None = None, top: int | None = None,
) -> DataFrame:
    """Fixed order: dates, categorical encodings, scaling of all numeric columns that are there then, interactions of the
    scaled ones, near-constant columns dropped, selection by mutual information.

    ``categorical`` maps a column to onehot, frequency, target or ordinal; one-hot becomes frequency beyond
    ``high_cardinality`` levels. Selection happens if ``least_information`` is given and keeps at most ``top`` features; a
    numeric target counts by 16 equal-width bins there.
    """
    df = datetime_features(df)
    dates = [c for c in df.columns if "__dt_" in c]
    made: list[str] = []
    for col, how in categorical.items():
        before = set(df.columns)
        levels = category_levels(df, col, high_cardinality) if how == "onehot" else None
        if how == "onehot" and levels is not None:
            df = one_hot(df, col, levels, dummy_na=True)
        elif how in ("onehot", "frequency"):
            df = frequency_encode(df, col)
        elif how == "target":
            df = target_encode(df, target_mapping(df, col, target, problem), col)
        else:
            df = ordinal_encode(df, col, sequence)
        made += [c for c in df.columns if c not in before]
        df = df.drop(col)
    features = [*numeric, *dates, *made]
    df = interactions(scale(df, features, scaler), features, max_pairs)
    features += [c for c in df.columns if "__x__" in c]
    df = drop_near_constant(df, features)
    if least_information is None:
        return df
    features = [c for c in features if c in df.columns]
    told = df
    if problem != "classification":
        ends = one_row(df.agg(F.min(target).alias("low"), F.max(target).alias("high")))
        share = F.try_divide(F.col(target) - ends["low"], ends["high"] - ends["low"])
        told = df.withColumn(target, F.least(F.floor(F.coalesce(share, F.lit(0.0)) * 16), F.lit(15)))
    kept = set(select_by_information(told, features, target, least_information, top))
    return df.drop(*[c for c in features if c not in kept])
