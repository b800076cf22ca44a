"""Cleaning of row tables: inferred types, conversion, missing values, outliers, text, normalising."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.functions import text as X, values as V
from millrace.operators import features
from millrace.operators.quality import numeric_columns, value_counts
from millrace.plans.joins import one_row
from millrace.plans.ranks import index_quantiles, order_stats
from millrace.plans.runs import last_known
from millrace.session import cut


def infer_types(df: DataFrame, columns: Sequence[str] | None = None, infer_dates: bool = True) -> DataFrame:
    """Rows (column, inferred, unique_ratio): datetime, int, float, boolean, categorical, string or unknown.

    All values vote, from one grouped count. Text that reads as numbers is float; int needs a whole-number
    column. Under 50 % distinct values makes text categorical.
    """
    columns = list(columns or df.columns)
    counts = value_counts(df, columns, empty_is_missing=True).where("value IS NOT NULL")
    v = F.col("value")
    votes = counts.groupBy("column").agg(
        F.every(V.looks_like_date(v)).alias("dates"), F.every(V.is_number(v)).alias("numbers"),
        F.every(F.coalesce(F.floor(v.try_cast("double")) == v.try_cast("double"), F.lit(False))).alias("whole"),
        F.every(F.lower(v).isin(*V.BOOLEAN_WORDS)).alias("booleans"),
        (F.count(F.lit(1)) / F.sum("n")).alias("unique_ratio"),
    )
    kinds = {
        f.name: "text" if isinstance(f.dataType, T.StringType) else "time" if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
        else "flag" if isinstance(f.dataType, T.BooleanType) else "number"
        for f in df.schema.fields if f.name in columns
    }
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("column")]
    inferred = (
        F.when(F.lit(infer_dates) & ((kind == "time") | ((kind == "text") & F.col("dates"))), "datetime")
        .when(F.col("numbers") & (kind != "flag"), F.when((kind == "number") & F.col("whole"), "int").otherwise("float"))
        .when(F.col("booleans"), "boolean")
        .when((kind == "text") & (F.col("unique_ratio") < 0.5), "categorical")
        .otherwise("string")
    )
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(votes.select("column", inferred.alias("inferred"), "unique_ratio"), "column", "left").withColumn(
        "inferred", F.coalesce("inferred", F.lit("unknown"))
    )


def type_map(inferred: DataFrame) -> dict[str, str]:
    """The inferred types on the driver: one row per column."""
    return {r["column"]: r["inferred"] for r in inferred.collect()}


def auto_convert(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Columns cast to their inferred type; text that does not convert moves to ``<c>__raw``."""
    to = {
        "int": lambda c: c.try_cast("double").cast("bigint"), "float": lambda c: c.try_cast("double"),
        "boolean": lambda c: V.to_bool(c.cast("string")), "datetime": lambda c: F.try_to_timestamp(V.parse_date(c)),
    }
    for name, kind in types.items():
        if kind not in to or (kind == "datetime" and not isinstance(df.schema[name].dataType, T.StringType)):
            continue
        col = F.col(name)
        is_text = isinstance(df.schema[name].dataType, T.StringType)
        converted = to[kind](col)
        if is_text:
            df = df.withColumn(f"{name}__raw", F.when(converted.isNull() & col.isNotNull() & (col != ""), col))
        df = df.withColumn(name, converted)
    return df


def missing_counts(df: DataFrame) -> DataFrame:
    """Rows (column, missing) and nothing else: what the automatic strategy does."""
    wide = df.agg(*[F.count_if(V.is_missing(F.col(f.name), f.dataType)).alias(f.name) for f in df.schema.fields])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("missing")) for c in df.columns])
    return wide.select(F.explode(pairs).alias("e")).select("e.*")


def fill_missing(df: DataFrame, strategy: str, columns: Sequence[str] | None = None, constant=0, order: Sequence[str] = (), chunk: Column | None = None) -> DataFrame:
    """auto (no change), drop, mean, median (upper of two middles), mode, constant or forward_fill.

    mean, median and mode touch numeric columns; constant touches all; drop removes rows with a gap.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    gap = {f.name: V.is_missing(F.col(f.name), f.dataType) for f in fields}
    if strategy == "auto":
        return df
    if strategy == "drop":
        out = F.lit(False)
        for g in gap.values():
            out = out | g
        return df.where(~out)
    if strategy == "constant":
        return df.withColumns({f.name: F.when(gap[f.name], F.lit(constant).try_cast(f.dataType.simpleString())).otherwise(F.col(f.name)) for f in fields})
    if strategy == "forward_fill":
        if not order or chunk is None:
            raise ValueError("forward_fill needs an order and a chunk expression")
        masked = df.withColumns({f"_g_{c}": F.when(~g, F.col(c)) for c, g in gap.items()})
        filled = last_known(masked, [], list(order), chunk, {f"_f_{c}": f"_g_{c}" for c in gap})
        return filled.withColumns({c: F.col(f"_f_{c}") for c in gap}).select(*df.columns)
    numeric = [c for c in numeric_columns(df) if c in gap]
    if not numeric:
        return df
    long = features.unpivot(df.select(*[F.when(~gap[c], F.col(c)).alias(c) for c in numeric]), numeric)
    if strategy == "mean":
        per = long.groupBy("column").agg(F.avg("value").alias("fill"))
    elif strategy == "median":
        per = order_stats(long, "value", {"fill": lambda n: F.floor(n / 2) + 1}, ["column"])
    elif strategy == "mode":
        counts = long.where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        per = counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("fill"))
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    fills = one_row(per.agg(*[F.max(F.when(F.col("column") == c, F.col("fill"))).alias(c) for c in numeric]))
    return df.withColumns({c: F.when(gap[c], fills[c]).otherwise(F.col(c).cast("double")) for c in numeric})


def iqr_bounds(df: DataFrame, columns: Sequence[str], min_values: int = 10) -> DataFrame:
    """Rows (column, n, low, high): 1.5 interquartile ranges around the index quartiles; columns with fewer values drop out."""
    q = index_quantiles(features.unpivot(df, columns), "value", {"q1": 0.25, "q3": 0.75}, ["column"]).where(F.col("n") >= min_values)
    reach = (F.col("q3") - F.col("q1")) * 1.5
    return q.select("column", "n", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))


def outliers_iqr(df: DataFrame, columns: Sequence[str], action: str = "clip", min_values: int = 10) -> DataFrame:
    """clip into the bounds, remove rows, or flag with ``<c>_outlier`` = true (null otherwise)."""
    b = iqr_bounds(df, columns, min_values)
    picks = [F.max(F.when(F.col("column") == c, F.col(s))).alias(f"{c}|{s}") for c in columns for s in ("low", "high")]
    bounds = one_row(b.agg(*picks))
    low, high = ({c: bounds[f"{c}|{s}"] for c in columns} for s in ("low", "high"))
    if action == "clip":
        return df.withColumns({
            c: F.when(F.col(c) < low[c], low[c]).when(F.col(c) > high[c], high[c]).otherwise(F.col(c).cast("double")) for c in columns
        })
    outside = {c: F.coalesce((F.col(c) < low[c]) | (F.col(c) > high[c]), F.lit(False)) for c in columns}
    if action == "flag":
        return df.withColumns({f"{c}_outlier": F.when(outside[c], F.lit(True)) for c in columns})
    keep = F.lit(True)
    for c in columns:
        keep = keep & ~outside[c]
    return df.where(keep)


def date_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    for c in columns:
        df = df.withColumns(features.date_parts(F.col(c), c))
    return df


def text_features(df: DataFrame, columns: Sequence[str], lower: bool = True, strip_special: bool = False) -> DataFrame:
    """Cleans text columns in place and adds ``<c>_length`` and ``<c>_word_count`` of the text before trimming."""
    for c in columns:
        cleaned = X.clean_text(F.col(c), lower, strip_special)
        df = df.withColumns({f"{c}_length": F.length(cleaned), f"{c}_word_count": X.word_count(cleaned), c: F.trim(cleaned)})
    return df


def encode(df: DataFrame, columns: Sequence[str], method: str = "label") -> DataFrame:
    """label adds ``<c>_encoded``; onehot adds ``<c>_<value>`` for columns of at most 10 values; both keep the column."""
    for c in columns:
        if method == "label":
            df = features.label_encode(df, c)
        elif method == "onehot":
            levels = features.category_levels(df, c)
            if levels is not None:
                df = features.one_hot(df, c, levels)
        elif method != "none":
            raise ValueError(f"unknown encoding {method!r}")
    return df


def normalise(df: DataFrame, columns: Sequence[str], method: str = "minmax") -> DataFrame:
    """Adds ``<c>_normalized`` by range or by population deviation; a column without spread gives 0."""
    s = one_row(df.agg(*[f(F.col(c).cast("double")).alias(f"{c}|{n}") for c in columns
                         for n, f in (("lo", F.min), ("hi", F.max), ("mean", F.avg), ("std", F.stddev_pop))]))
    out = {}
    for c in columns:
        x = F.col(c).cast("double")
        base, width = (s[f"{c}|lo"], s[f"{c}|hi"] - s[f"{c}|lo"]) if method == "minmax" else (s[f"{c}|mean"], s[f"{c}|std"])
        out[f"{c}_normalized"] = F.when(x.isNotNull(), F.when(width > 0, (x - base) / width).otherwise(0.0))
    return df.withColumns(out)


@dataclass(frozen=True)
class CleanConfig:
    missing: str = "auto"
    constant: float = 0
    outliers: str | None = "clip"
    encoding: str = "label"
    normalisation: str | None = None
    lower: bool = True
    strip_special: bool = False
    deduplicate: bool = True
    skip: tuple[str, ...] = field(default=())


def clean(df: DataFrame, config: CleanConfig = CleanConfig()) -> DataFrame:
    """The fixed order: types, missing values, duplicates, outliers, dates, text, categories, normalising.

    Types are inferred once (one row per column reaches the driver) and steer the later steps. The rows are
    written to the shared folder before and after the outlier step: the passes that follow read statistics
    of these rows, and would each repeat everything above.
    """
    types = {c: t for c, t in type_map(infer_types(df, [c for c in df.columns if c not in config.skip])).items()}
    by = lambda *kinds: [c for c, t in types.items() if t in kinds]
    out = auto_convert(df, types)
    out = fill_missing(out, config.missing, constant=config.constant)
    if config.deduplicate:
        out = out.distinct()
    numeric = by("int", "float")
    if numeric and (config.outliers or config.normalisation):
        out = cut(out, "clean")
    if config.outliers and numeric:
        out = outliers_iqr(out, numeric, config.outliers)
        if by("categorical") or config.normalisation:
            out = cut(out, "clean")
    out = date_features(out, by("datetime"))
    out = text_features(out, by("string"), config.lower, config.strip_special)
    out = encode(out, by("categorical"), config.encoding)
    if config.normalisation and numeric:
        out = normalise(out, numeric, config.normalisation)
    return out
