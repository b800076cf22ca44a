"""Parallelism of CPU-heavy narrow work over inputs that arrive in too few partitions."""
from __future__ import annotations

from pyspark.sql import DataFrame

BYTES_PER_CORE = 64 * 1024 * 1024
UNKNOWN_BYTES = 2**50
BYTES_PER_PIECE = 8 * 1024 * 1024  # of compressed files


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan; no job is run."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def widen(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partitions a small input over all cores; an input that fills the cluster is left as it is read.

    A few files of text can hide hours of tokenising behind a handful of tasks. Beyond 64 MB per core the
    scan has enough partitions of its own and a shuffle of the raw text would only cost.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if estimated_bytes(df) < cores * BYTES_PER_CORE else df


def pieces(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partitions texts by key into pieces of a bounded size, however many that are.

    The text is shuffled once, so that what is grouped by the key afterwards needs no shuffle of its many words, and a task
    groups the words of one piece only. Rows whose size Spark does not know (not read from files) are left as they come.
    """
    cores, size = df.sparkSession.sparkContext.defaultParallelism, estimated_bytes(df)
    return df if size >= UNKNOWN_BYTES else df.repartition(max(cores, -(-size // BYTES_PER_PIECE)), *keys)


def dealt(df: DataFrame) -> DataFrame:
    """The rows of a small table dealt out evenly over all cores, whatever the files it is read from; a large one as it is read.

    For work that passes over the rows many times. Rows come in one order, so that draws that go row by row repeat.
    """
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant", "struct", "array")]
    wide = widen(df)
    return df if wide is df else wide.sortWithinPartitions(*plain) if plain else wide
