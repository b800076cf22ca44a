"""Set operations, deduplication, ids and fingerprints."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from millrace.plans.joins import salted_join
from millrace.plans.topn import first_per_key


def deduplicate(df: DataFrame, subset: Sequence[str] | None = None, order: Sequence[str] | None = None) -> DataFrame:
    """Whole-row duplicates, or the first row per subset along ``order``."""
    if subset is None:
        return df.distinct()
    return first_per_key(df, list(subset), list(order or [c for c in df.columns if c not in subset]))


def duplicate_count(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """One row: rows, distinct rows, duplicates. Copies collapse before the shuffle."""
    groups = df.groupBy(*(subset or df.columns)).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("distinct_rows"), (F.sum("_n") - F.count(F.lit(1))).alias("duplicates")
    )


def duplicate_members(df: DataFrame, content: Column, path: str, size: Column, min_size: int = 0) -> DataFrame:
    """Rows (content_hash, path, copies, first_path) of every content held by more than one path.

    Members stay one row each, however many copies a content has; only the group's count is joined back.
    """
    hashed = df.where(size >= min_size).select(F.sha2(content, 256).alias("content_hash"), F.col(path).alias("path"))
    groups = hashed.groupBy("content_hash").agg(F.count(F.lit(1)).alias("copies"), F.min("path").alias("first_path")).where("copies > 1")
    return salted_join(hashed, groups, ["content_hash"], ["path"])


def canonical_json(cols: Sequence[str]) -> Column:
    """The columns as JSON text with sorted keys and explicit nulls."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(cols)]), {"ignoreNullFields": "false"})


def canonical_text(json_text: Column) -> Column:
    """JSON text with keys in a fixed (sorted) order and no spaces; null when it does not parse."""
    return F.to_json(F.try_parse_json(json_text))


def payload_dedup(df: DataFrame, payload: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keeps the first row per distinct payload (by canonical JSON) within ``keys``; adds ``payload_hash``."""
    digest = F.sha2(F.coalesce(canonical_text(F.col(payload)), F.col(payload), F.lit("")), 256)
    return first_per_key(df.withColumn("payload_hash", digest), [*keys, "payload_hash"], order)


def ragged_union(*frames: DataFrame) -> DataFrame:
    """Union over the union of the columns, which come out sorted."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.select(*sorted(out.columns))


def merge_import(current: DataFrame, incoming: DataFrame, keys: Sequence[str], replace: bool = False) -> DataFrame:
    """Imported rows win over current ones with the same key; ``replace`` drops the current rows."""
    if replace:
        return incoming
    both = current.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    return first_per_key(both, list(keys), ["_side"], latest=True).drop("_side")


def delete_keys(df: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    spread = [c for c in df.columns if c not in keys] or list(keys)
    return salted_join(df, gone.select(*keys).distinct(), list(keys), spread, "left_anti")


def prune_older(df: DataFrame, ts: str, cut: Column) -> DataFrame:
    return df.where(F.col(ts) >= cut)


def row_id(candidates: Sequence[str], cols: Sequence[str]) -> Column:
    """First non-empty candidate key, else 16 hex digits of the hash of the canonical row."""
    present = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in candidates]
    return F.coalesce(*present, F.substring(F.sha2(canonical_json(cols), 256), 1, 16))


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free fingerprint of a table: row count and two sums over row hashes."""
    first = F.xxhash64(*df.columns).cast("decimal(20,0)")
    second = F.hash(*df.columns).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(first).cast("string").alias("hash_sum"), F.bit_xor(second).alias("hash_xor"))
