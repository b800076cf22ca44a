"""Sinks: NDJSON, CSV, run folders with logs and manifests, upserts, tables, text lines."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from millrace.operators.joins import merge_rows
from millrace.operators.quality import split_valid

NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).json(path)


def flat_for_csv(df: DataFrame) -> DataFrame:
    """Columns in sorted order, nested cells as JSON text."""
    cols = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, NESTED) else F.col(f.name) for f in df.schema.fields]
    return df.select(*cols).select(*sorted(df.columns))


def write_csv(df: DataFrame, path: str) -> None:
    flat_for_csv(df).write.option("header", True).option("escape", '"').csv(path)


def write_run(df: DataFrame, rule: Column, root: str, run_id: str, started: str, reason: str = "validation failed") -> DataFrame:
    """Writes raw, processed, failed and log folders of one run below ``root`` and returns the log row.

    The input is computed once, by the raw write; the other folders are filled from it, and the counts come
    from the footers of the written files.
    """
    spark = df.sparkSession
    folder = lambda name: f"{root}/{name}/run_id={run_id}"
    df.write.parquet(folder("raw"))
    raw = spark.read.schema(df.schema).parquet(folder("raw"))
    good, bad = split_valid(raw, rule, reason)
    counts = []
    for rows, name in ((good, "processed"), (bad, "failed")):
        rows.write.parquet(folder(name))
        counts.append(spark.read.schema(rows.schema).parquet(folder(name)).count())
    n_good, n_bad = counts
    log = spark.createDataFrame(
        [(run_id, started, n_good + n_bad, n_good, n_bad)],
        "run_id string, timestamp string, items_processed bigint, items_stored bigint, items_failed bigint",
    )
    log.write.json(folder("logs"))
    return log


def run_manifest(spark: SparkSession, root: str, table: DataFrame) -> DataFrame:
    """One row per artifact below ``root``: (path, bytes, sha256), with the table's row count and sorted columns."""
    rows = table.agg(F.count(F.lit(1)).alias("n")).scalar()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(
        "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), rows.alias("rows"), F.lit(",".join(sorted(table.columns))).alias("columns")
    )


def upsert_by_key(current: DataFrame, incoming: DataFrame, keys: Sequence[str], path: str) -> DataFrame:
    """Writes the merged table to a new folder and returns created and updated counts.

    Plain files cannot be changed in place: readers move to the new folder once it is complete. With a
    table format that knows MERGE, use that instead.
    """
    merge_rows(current, incoming, keys).drop("status").write.parquet(path)
    held = current.select(*keys).withColumn("_held", F.lit(True))
    known = incoming.select(*keys).join(held, list(keys), "left")  # keys only
    return known.agg(F.count_if(F.col("_held").isNull()).alias("created"), F.count_if("_held").alias("updated"))


def create_table_as(df: DataFrame, name: str, temporary: bool = True, path: str | None = None) -> DataFrame:
    """A query's result as a temporary view or as a stored table of the catalog, in the warehouse or in the folder ``path``."""
    if temporary:
        df.createOrReplaceTempView(name)
    else:
        writer = df.write.mode("overwrite").format("parquet")
        (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def write_lines(lines: DataFrame, order: Sequence[str], path: str, column: str = "line") -> None:
    """Text lines in a total order; meant for small reports such as a metrics page."""
    lines.orderBy(*order).coalesce(1).select(column).write.text(path)


def fan_out(events: DataFrame, targets: DataFrame, body: str = "body", target: str = "target") -> DataFrame:
    """A copy of each event for each target; a target's size cap drops bodies that are longer.

    ``targets`` (target, max_bytes) becomes one array in a scalar subquery, and each event is exploded by it, so there is no join;
    targets without a name are left out.
    """
    listed = F.sort_array(F.collect_list(F.struct(F.col(target).alias(target), F.col("max_bytes").cast("bigint").alias("_cap"))))
    items = targets.where(F.col(target).isNotNull()).agg(listed.alias("items")).scalar()
    out = events.withColumn("_e", F.explode(items)).select("*", "_e.*").drop("_e")
    return out.where(F.col("_cap").isNull() | (F.octet_length(body) <= F.col("_cap"))).drop("_cap")
