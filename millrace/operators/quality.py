"""Profiles, completeness, consistency, outliers, validation of rows and records."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.functions.values import is_missing
from millrace.operators.features import unpivot
from millrace.plans.joins import one_row
from millrace.plans.ranks import linear_quantiles
from millrace.plans.topn import top_per_key

# Names that mark a target column, in the order they are tried.
TARGET_HINTS = ("label", "target", "class", "y", "output", "prediction")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def value_counts(df: DataFrame, columns: Sequence[str], empty_is_missing: bool = False) -> DataFrame:
    """Rows (column, value, n) for all columns from one scan and one shuffle; missing cells have a null value.

    Every per-column figure that needs distinct values is read from here, which spares a job (or an
    expanded copy of the rows) per column. Copies of a value collapse before the shuffle.
    """
    cells = []
    for c in columns:
        dtype = df.schema[c].dataType
        text = F.col(c).cast("string") if not isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)) else F.to_json(c)
        shown = F.when(~is_missing(F.col(c), dtype, empty_is_missing), text)
        cells.append(F.struct(F.lit(c).alias("column"), shown.alias("value")))
    return df.select(F.explode(F.array(*cells)).alias("e")).groupBy("e.column", "e.value").agg(F.count(F.lit(1)).alias("n"))


def profile(df: DataFrame, columns: Sequence[str] | None = None, empty_is_missing: bool = False) -> DataFrame:
    """One row per column: type, missing and distinct counts and shares, then min, max, mean, sample
    deviation and median of numeric columns, or the mode (smallest on ties) of the others."""
    columns = list(columns or df.columns)
    counts = value_counts(df, columns, empty_is_missing)
    missing = F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0))
    per_column = counts.groupBy("column").agg(
        F.sum("n").alias("rows"), missing.alias("null_count"), F.count("value").alias("unique_count"),
        F.min_by("value", F.when(F.col("value").isNotNull(), F.struct(-F.col("n"), F.col("value")))).alias("mode"),
    )
    numeric = [c for c in numeric_columns(df) if c in columns]
    dtypes = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(df.schema[c].dataType.simpleString()))])
    out = per_column.withColumns({
        "dtype": dtypes[F.col("column")], "null_pct": F.col("null_count") * 100.0 / F.col("rows"),
        "unique_pct": F.col("unique_count") * 100.0 / F.col("rows"),
    })
    if not numeric:
        return out
    wide = df.agg(*[f(F.col(c).cast("double")).alias(f"{c}|{n}") for c in numeric for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_samp))])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{c}|{n}").alias(n) for n in ("min", "max", "mean", "std")]) for c in numeric])
    moments = wide.select(F.explode(rows).alias("e")).select("e.*")
    medians = linear_quantiles(unpivot(df, numeric), "value", {"median": 0.5}, ["column"]).select("column", "median")
    out = out.join(moments, "column", "left").join(medians, "column", "left")
    return out.withColumn("mode", F.when(~F.col("column").isin(numeric), F.col("mode")))


def column_samples(df: DataFrame, columns: Sequence[str], sequence: str, n: int = 5) -> DataFrame:
    """First ``n`` non-missing values of each column along ``sequence``: rows (column, position, value)."""
    from pyspark.sql import Window as W

    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    long = df.select(F.col(sequence).alias("_s"), F.explode(cells).alias("e")).select("_s", "e.*").where("value IS NOT NULL")
    top = top_per_key(long, ["column"], [F.col("_s")], n, ["_s"])
    return top.select("column", F.row_number().over(W.partitionBy("column").orderBy("_s")).alias("position"), "value")


def top_values(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(n)


def completeness(df: DataFrame) -> DataFrame:
    """One row: cells, missing cells (null, NaN or empty) and the completeness; ``low`` below 0.7."""
    gaps = [F.count_if(is_missing(F.col(f.name), f.dataType)) for f in df.schema.fields]
    cells = F.count(F.lit(1)) * len(df.columns)
    out = df.agg(cells.alias("cells"), sum(gaps[1:], gaps[0]).alias("missing"))
    share = F.when(F.col("cells") > 0, 1 - F.col("missing") / F.col("cells")).otherwise(0.0)
    return out.withColumn("completeness", share).withColumn("low", F.col("completeness") < 0.7)


def json_type(cell: Column) -> Column:
    """numeric, string, boolean, array or object for a JSON cell; null for null and for unreadable text."""
    kind = F.schema_of_variant(F.try_parse_json(cell))
    return (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean").when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), "numeric")
    )


def type_consistency(df: DataFrame, columns: Sequence[str], sequence: str | None = None, sample: int | None = None) -> DataFrame:
    """Per column of JSON cells: majority type (of the first ``sample`` rows along ``sequence``, or of
    all), cells present, cells of that type and their share; ``low`` below 0.8."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), json_type(F.col(c)).alias("type")) for c in columns])

    def counted(rows: DataFrame) -> DataFrame:
        long = rows.select(F.explode(cells).alias("e")).select("e.*").where("type IS NOT NULL")
        return long.groupBy("column", "type").agg(F.count(F.lit(1)).alias("n"))

    counts = counted(df)
    voters = counts if sequence is None or sample is None else counted(df.orderBy(sequence).limit(sample))
    major = voters.groupBy("column").agg(F.min_by("type", F.struct(-F.col("n"), F.col("type"))).alias("majority"))
    joined = counts.join(major, "column")
    out = joined.groupBy("column", "majority").agg(
        F.sum("n").alias("present"), F.coalesce(F.sum(F.when(F.col("type") == F.col("majority"), F.col("n"))), F.lit(0)).alias("matching")
    )
    return out.withColumn("consistency", F.col("matching") / F.col("present")).withColumn("low", F.col("consistency") < 0.8)


def sigma_outliers(df: DataFrame, columns: Sequence[str], sigmas: float = 3.0, min_values: int = 10) -> DataFrame:
    """Per numeric column: values, outliers beyond ``sigmas`` population deviations, their share, 3 examples."""
    stats = one_row(df.agg(*[f(F.col(c).cast("double")).alias(f"{c}|{n}") for c in columns for n, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_pop))]))
    cells = []
    for c in columns:
        x = F.col(c).cast("double")
        out = (stats[f"{c}|n"] >= min_values) & (stats[f"{c}|s"] > 0) & (F.abs(x - stats[f"{c}|m"]) > sigmas * stats[f"{c}|s"])
        cells.append(F.struct(F.lit(c).alias("column"), x.alias("value"), F.coalesce(out, F.lit(False)).alias("out")))
    long = df.select(F.explode(F.array(*cells)).alias("e")).select("e.*").where("value IS NOT NULL")
    per = long.groupBy("column").agg(F.count(F.lit(1)).alias("values"), F.count_if("out").alias("outliers"))
    shown = top_per_key(long.where("out").select("column", "value").distinct(), ["column"], [F.desc("value")], 3, ["value"])
    examples = shown.groupBy("column").agg(F.sort_array(F.collect_list("value"), False).alias("examples"))
    return per.join(examples, "column", "left").withColumn("outlier_pct", F.col("outliers") * 100.0 / F.col("values"))


def quality_score(complete: DataFrame, consistent: DataFrame, duplicates: DataFrame, null_shares: DataFrame, outliers: DataFrame) -> DataFrame:
    """One row: mean of completeness and consistency, verdict, and the suggestions that apply."""
    c = one_row(complete)["completeness"]
    k = one_row(consistent.agg(F.avg("consistency").alias("v")))["v"]
    d = one_row(duplicates.select("duplicates"))["duplicates"]
    nulls = one_row(null_shares.agg(F.count_if(F.col("null_pct") > 20).alias("n")))["n"]
    outs = one_row(outliers.agg(F.sum("outliers").alias("n")))["n"]
    score = (c + k) / 2
    advice = F.array_compact(F.array(
        F.when(d > 0, "remove duplicates"), F.when(nulls > 0, "fill or drop sparse columns"), F.when(outs > 0, "check outliers"),
    ))
    base = complete.select("cells")
    return base.select(score.alias("score"), (score >= 0.7).alias("valid"), advice.alias("suggestions"))


def validate_rows(df: DataFrame, target: str | None = None, constant_share: float = 0.999) -> DataFrame:
    """Findings (check, column, value): duplicates, nulls per column, null target, near-constant columns."""
    counts = value_counts(df, df.columns)
    per = counts.groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        (F.max("n") / F.sum("n")).alias("top"),
    )
    checks = F.array_compact(F.array(
        F.when(F.col("nulls") > 0, F.struct(F.lit("nulls").alias("check"), F.col("nulls").cast("double").alias("value"))),
        F.when(F.col("top") >= constant_share, F.struct(F.lit("quasi_constant").alias("check"), F.col("top").alias("value"))),
        F.when((F.col("column") == F.lit(target)) & (F.col("nulls") > 0), F.struct(F.lit("null_target").alias("check"), F.col("nulls").cast("double").alias("value"))),
    ))
    findings = per.select("column", F.explode(checks).alias("e")).select("e.check", "column", "e.value")
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") - 1).cast("double").alias("value"))
    return findings.unionByName(copies.select(F.lit("duplicates").alias("check"), F.lit("*").alias("column"), "value").where("value > 0"))


def check_bounds(df: DataFrame, required: Sequence[str] = (), low: int = 10, high: int = 100_000) -> DataFrame:
    """Rows (check, ok, detail): row count within bounds, required columns present."""
    counted = df.agg(F.count(F.lit(1)).alias("n"))
    rows = F.array(
        F.struct(F.lit("min_rows").alias("check"), (F.col("n") >= low).alias("ok"), F.col("n").alias("detail")),
        F.struct(F.lit("max_rows").alias("check"), (F.col("n") <= high).alias("ok"), F.col("n").alias("detail")),
        *[F.struct(F.lit(f"column:{c}").alias("check"), F.lit(c in df.columns).alias("ok"), F.lit(0).cast("bigint").alias("detail")) for c in required],
    )
    return counted.select(F.explode(rows).alias("e")).select("e.*")


def infer_target(columns: Sequence[str]) -> str | None:
    return next((h for h in TARGET_HINTS if h in columns), None)


def infer_problem(df: DataFrame, target: str, limit: int = 20, share: float | None = None) -> DataFrame:
    """One row: distinct target values and the problem; ``share`` also asks for few values per row."""
    counts = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    out = counts.agg(F.count(F.lit(1)).alias("unique_values"), F.sum("n").alias("rows"))
    few = F.col("unique_values") <= limit
    if share is not None:
        few = few | (F.col("unique_values") < F.col("rows") * share)
    return out.withColumn("problem", F.when(few, "classification").otherwise("regression"))


def split_valid(df: DataFrame, rule: Column, reason: Column | str = "validation failed") -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejects with an ``error`` column; a rule that is null rejects."""
    ok = F.coalesce(rule, F.lit(False))
    why = F.lit(reason) if isinstance(reason, str) else reason
    return df.where(ok), df.where(~ok).withColumn("error", why)


def has_content(columns: Sequence[str]) -> Column:
    """False for a record in which every field is null."""
    return F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull()


def record_errors(required: Sequence[str], allowed: Mapping[str, Sequence[str]] | None = None, typed: Mapping[str, str] | None = None, json: str = "record") -> Column:
    """List of errors of a JSON record: missing fields, values outside a list, fields of the wrong type."""
    doc = F.try_parse_json(F.col(json))
    fields = F.try_variant_get(doc, "$", "map<string,variant>")
    tests = [F.when(~F.map_contains_key(fields, F.lit(n)), F.lit(f"Missing required field: {n}")) for n in required]
    for name, options in (allowed or {}).items():
        value = F.try_variant_get(doc, f"$.{name}", "string")
        tests.append(F.when(F.map_contains_key(fields, F.lit(name)) & ~F.coalesce(value.isin(list(options)), F.lit(False)),
                            F.concat(F.lit(f"Invalid {name}: "), F.coalesce(value, F.lit("null")))))
    for name, kind in (typed or {}).items():
        is_kind = F.schema_of_variant(F.try_variant_get(doc, f"$.{name}", "variant")).startswith(kind.upper())
        tests.append(F.when(F.map_contains_key(fields, F.lit(name)) & ~F.coalesce(is_kind, F.lit(False)), F.lit(f"{name} must be an {kind}")))
    checked = F.array_compact(F.array(*tests))
    return F.when(fields.isNull(), F.array(F.lit("Record is not an object"))).otherwise(checked)


# Minimum scores of an evaluation.
METRIC_THRESHOLDS = {"accuracy": 0.7, "f1": 0.6, "r2": 0.5}


def metric_gate(metrics: DataFrame, thresholds: Mapping[str, float] | None = None) -> DataFrame:
    """Adds the threshold of each metric and whether it is reached; metrics without one pass."""
    table = F.create_map(*[F.lit(x) for kv in (thresholds or METRIC_THRESHOLDS).items() for x in kv])
    out = metrics.withColumn("threshold", F.try_element_at(table, F.col("metric")))
    return out.withColumn("passed", F.coalesce(F.col("value") >= F.col("threshold"), F.lit(True)))


