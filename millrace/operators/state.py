"""Versioned key-value state as an append-only change table: puts, deletes, history, rollback, expiry, queues.

A change has key, seq (its place in time), op (put or delete), value, ts and ttl_seconds.
"""
from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.functions.predicates import expired
from millrace.functions.values import RETRY_STATUS
from millrace.plans.joins import salted_join
from millrace.plans.runs import neighbours, numbered
from millrace.plans.topn import first_per_key, top_per_key

CHUNK = 1_000_000


def current(changes: DataFrame, keys: Sequence[str] = ("key",), order: Sequence[str] = ("seq",)) -> DataFrame:
    """The latest change per key; deleted keys are gone. An aggregate, so a key written all the time costs one row."""
    latest = first_per_key(changes, list(keys), list(order), latest=True)
    return latest.where(F.col("op") != "delete")


def live(changes: DataFrame, as_of: Column) -> DataFrame:
    """Current entries whose time to live has not run out."""
    return current(changes).where(~expired("ts", "ttl_seconds", as_of))


def classify(changes: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Adds ``operation``: create when the key does not exist at that moment, update, or delete."""
    chunk = F.floor(F.col("seq") / CHUNK) if chunk is None else chunk
    rows = neighbours(changes, ["key"], ["seq"], chunk, {"_before": "op"})
    kind = F.when(F.col("op") == "delete", "delete").when(F.coalesce("_before", F.lit("delete")) == "delete", "create").otherwise("update")
    return rows.withColumn("operation", kind).drop("_before")


def history(changes: DataFrame, keep: int | None = 50, chunk: Column | None = None) -> DataFrame:
    """Versions 1, 2, 3 ... per key, one per change and never reused; of each key the newest ``keep`` stay."""
    chunk = F.floor(F.col("seq") / CHUNK) if chunk is None else chunk
    out = numbered(classify(changes, chunk), ["key"], ["seq"], chunk, "version")
    return out if keep is None else top_per_key(out, ["key"], [F.desc("seq")], keep, ["seq"])


def rollback(changes: DataFrame, wanted: DataFrame, at_seq: Column, chunk: Column | None = None) -> DataFrame:
    """Appends, for each (key, version) wanted, a put of that version's value; a version that is a delete restores nothing.

    ``at_seq`` numbers the new changes and must lie after the existing ones.
    """
    versions = history(changes, None, chunk)
    restored = versions.join(wanted.select("key", "version"), ["key", "version"], "left_semi").where(F.col("op") != "delete")
    return changes.unionByName(restored.withColumn("seq", at_seq).select(*changes.columns))


def audit_rows(changes: DataFrame, entity: str = "entry") -> DataFrame:
    """Audit records of changes, partitioned by day when written."""
    return changes.select(
        F.sha2(F.concat_ws("|", "key", F.col("seq").cast("string")), 256).alias("id"), "ts", F.col("op").alias("operation"), F.lit(entity).alias("entity_type"),
        F.col("key").alias("entity_id"), F.lit(True).alias("success"), F.to_date("ts").alias("day"),
    )


def write_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("day").parquet(path)


def upsert_counts(merged: DataFrame) -> DataFrame:
    return merged.agg(F.count_if(F.col("status") == "created").alias("created"), F.count_if(F.col("status") == "updated").alias("updated"))


def tag_index(entries: DataFrame, key: str = "key", tags: str = "tags") -> DataFrame:
    """Rows (tag, key): written partitioned or sorted by tag, it prunes a tag lookup."""
    return entries.select(F.explode(F.array_distinct(tags)).alias("tag"), key)


def by_tag(entries: DataFrame, index: DataFrame, wanted: Sequence[str], key: str = "key") -> DataFrame:
    hits = index.where(F.col("tag").isin(list(wanted))).select(key).distinct()
    return salted_join(entries, hits, [key], [c for c in entries.columns if c != key], "left_semi")


# --- queues -------------------------------------------------------------------------------------------


def due_messages(messages: DataFrame, as_of: Column) -> DataFrame:
    """Messages whose time has come and that have not expired."""
    come = F.col("scheduled_at").isNull() | (F.col("scheduled_at") <= as_of)
    fresh = F.col("expires_at").isNull() | (F.col("expires_at") > as_of)
    return messages.where(come & fresh)


def priority_order(messages: DataFrame, limit: int | None = None) -> DataFrame:
    """Highest priority first, then oldest, then by id."""
    out = messages.orderBy(F.desc("priority"), "ts", "message_id")
    return out if limit is None else out.limit(limit)


def delivery_split(messages: DataFrame) -> DataFrame:
    """Adds ``outcome``: delivered, retry or dead. A failure is retried while attempts remain and its status allows it."""
    ok = F.col("status_code").between(200, 299)
    again = F.col("status_code").isin(*RETRY_STATUS) & (F.col("attempts") < F.col("max_attempts"))
    return messages.withColumn("outcome", F.when(ok, "delivered").when(F.coalesce(again, F.lit(False)), "retry").otherwise("dead"))


def purge_dead(dead: DataFrame, as_of: Column, days: int) -> DataFrame:
    return dead.where(F.col("ts") >= as_of - F.expr(f"INTERVAL {days} DAY"))


def sliding_limit(requests: DataFrame, client: str, at: str, limit: int, width: int) -> DataFrame:
    """Accepted and rejected requests per client and second under a sliding-window limit.

    Only accepted requests count against the limit, so the decision is sequential. Requests of one second
    are interchangeable and are counted first; a pause of ``width`` seconds forgets everything and starts
    an independent run, and each run folds over its distinct seconds, not over its requests.
    """

    def fresh() -> Callable[[int | None, int], int]:
        held: deque[tuple[int, int]] = deque()
        used = 0

        def taken(t: int | None, n: int) -> int:
            nonlocal used
            while held and held[0][0] <= t - width:
                used -= held.popleft()[1]
            now = min(n, max(limit - used, 0))
            if now:
                held.append((t, now))
                used += now
            return now

        return taken

    return _folded(requests, client, at, width, fresh)


def token_bucket(requests: DataFrame, client: str, at: str, capacity: float, per_second: float) -> DataFrame:
    """Accepted and rejected requests per client and second under a token bucket that starts full.

    A pause long enough to fill the bucket starts an independent run.
    """
    full = int(-(-capacity // per_second))

    def fresh() -> Callable[[int | None, int], int]:
        tokens, last = float(capacity), None

        def taken(t: int | None, n: int) -> int:
            nonlocal tokens, last
            if last is not None:
                tokens = min(float(capacity), tokens + (t - last) * float(per_second))
            now = min(n, math.floor(tokens))
            tokens, last = tokens - now, t
            return now

        return taken

    return _folded(requests, client, at, full, fresh)


def _folded(requests: DataFrame, client: str, at: str, pause: int, fresh: Callable[[], Callable[[int | None, int], int]]) -> DataFrame:
    """Per client, its busy seconds in order, decided one after the other; a pause starts afresh.

    Runs are dealt out and sorted by Spark and pass through a task in batches, so a task holds one decision's state and
    not a run; the work grows with the seconds.
    """
    from millrace.plans.runs import running_sums

    busy = requests.groupBy(client, F.floor(at).cast("bigint").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    chunk = F.floor(F.col("t") / 86400)
    gaps = neighbours(busy, [client], ["t"], chunk, {"_b": "t"})
    gaps = gaps.withColumn("_breaks", F.when(F.col("_b").isNull() | (F.col("t") - F.col("_b") >= pause), 1).otherwise(0))
    runs = running_sums(gaps, [client], ["t"], chunk, {"_run": F.col("_breaks")}).select(client, "_run", "_breaks", "t", "n")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = fresh()
        for batch in batches:
            accepted, rejected = [], []
            for breaks, t, n in zip(*(batch[c].to_pylist() for c in ("_breaks", "t", "n"))):
                if breaks:
                    taken = fresh()
                accepted.append(taken(t, n))
                rejected.append(n - accepted[-1])
            counts = (pa.array(c, pa.int64()) for c in (accepted, rejected))
            yield pa.RecordBatch.from_arrays([batch[client], batch["t"], *counts], [client, "second", "accepted", "rejected"])

    number = T.LongType()
    schema = T.StructType([busy.schema[client], *[T.StructField(c, number) for c in ("second", "accepted", "rejected")]])
    return runs.repartition(client, "_run").sortWithinPartitions(client, "_run", "t").mapInArrow(decide, schema)


def tumbling(df: DataFrame, at: Column, width: str, keys: Sequence[str], aggs: Sequence[Column], slide: str | None = None) -> DataFrame:
    """Tumbling, or with ``slide`` sliding, time windows: the same expression serves tables and streams."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    out = df.groupBy(w.alias("w"), *keys).agg(*aggs)
    return out.withColumns({"window_start": F.col("w.start"), "window_end": F.col("w.end")}).drop("w")


def sessions(df: DataFrame, keys: Sequence[str], at: str, gap_seconds: float, chunk: Column, aggs: Sequence[Column]) -> DataFrame:
    """Sessions of a table: runs of rows per key with pauses below ``gap_seconds``.

    On a table the pauses are found chunk by chunk and the aggregates combine before the shuffle, where a
    session window would gather and sort a whole key in one task. Adds session_start and session_end.
    """
    from millrace.plans.runs import running_sums

    keys = list(keys)
    gaps = neighbours(df, keys, [at], chunk, {"_b": at})
    breaks = F.when(F.col("_b").isNull() | (F.col(at) - F.col("_b") >= gap_seconds), 1).otherwise(0)
    parted = running_sums(gaps, keys, [at], chunk, {"session": breaks})
    return parted.groupBy(*keys, "session").agg(F.min(at).alias("session_start"), (F.max(at) + gap_seconds).alias("session_end"), *aggs)
