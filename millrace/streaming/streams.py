"""Event streams: reading, topic filters, deduplication, windows, late data, stateful operators, sinks.

A streaming frame flows through the same functions as a table where the semantics allow. Results go to
files or to a batch function; nothing gathers on the driver.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from millrace.functions.predicates import topic_matches
from millrace.operators.aggregates import aggregate_similar
from millrace.operators.state import delivery_split
from millrace.session import scratch_path


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def event_time(stream: DataFrame, col: str = "ts") -> DataFrame:
    """Zone-less times read as UTC instants, which watermarks need."""
    return stream.withColumn(col, F.col(col).cast("timestamp"))


def land(stream: DataFrame, label: str, partition_by: Sequence[str] = (), out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Runs an append stream over what is available now and returns the written table; with the folders of an earlier run it goes
    on from there."""
    spark = stream.sparkSession
    out, marks = out or scratch_path(spark, label), checkpoint or scratch_path(spark, f"{label}-checkpoint")
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", marks)
        .partitionBy(*partition_by).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], label: str, checkpoint: str | None = None, output: str = "append") -> None:
    """Runs ``work`` on every micro-batch of what is available now. It must give the same files when a batch is repeated."""
    marks = checkpoint or scratch_path(stream.sparkSession, f"{label}-checkpoint")
    query = stream.writeStream.foreachBatch(work).outputMode(output).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()


def topic_stream(stream: DataFrame, topic: Column, pattern: str) -> DataFrame:
    return stream.where(topic_matches(topic, pattern))


def deduplicate(stream: DataFrame, keys: Sequence[str], at: str = "ts", within: str = "5 minutes") -> DataFrame:
    """Drops repeats of the keys that arrive within the window; memory is bounded by the watermark."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark(list(keys))


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stateful(stream: DataFrame, keys: Sequence[str], at: str, late: str, processor: StatefulProcessor, schema: T.StructType) -> DataFrame:
    """Runs a processor per key in event time; ``at`` is in seconds. Rows older than the watermark are late and left out."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    timed = stream.withColumn("_t", F.timestamp_micros((F.col(at) * 1_000_000).cast("bigint"))).withWatermark("_t", late)
    return timed.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime")


class _Quiet(StatefulProcessor):
    """Lets a row pass unless one of its key passed less than ``window`` seconds before.

    A group is a slot of many keys. Its state, one (key, at) for each key that is not silent yet, is read and written at once;
    keys whose window the watermark has passed are forgotten.
    """

    def __init__(self, at: str, tie: str, window: float, names: list[str]) -> None:
        self.at, self.tie, self.window, self.names = at, tie, window, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getListState("last", "key string, at double")

    def _ends(self, at: float) -> int:
        return int(np.ceil((at + self.window) * 1000))

    def _hold(self, held: dict[str, float], timerValues) -> None:
        now = timerValues.getCurrentWatermarkInMs()
        kept = [(key, at) for key, at in held.items() if self._ends(at) > now]
        if kept:
            self.last.put(kept)
            self.handle.registerTimer(min(self._ends(at) for _, at in kept))
        else:
            self.last.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values([self.at, self.tie], kind="stable")
        held = dict(self.last.get())
        passed = np.zeros(len(pdf), bool)
        for i, (name, at) in enumerate(zip(pdf["quiet_key"], pdf[self.at].to_numpy(float).tolist())):
            if at >= held.get(name, float("-inf")) + self.window:  # no time: never
                held[name], passed[i] = at, True
        self._hold(held, timerValues)
        yield pdf[passed][self.names]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._hold(dict(self.last.get()), timerValues)
        yield pd.DataFrame(columns=self.names)

    def close(self) -> None:
        pass


def first_in_window(
    stream: DataFrame, keys: Sequence[str], at: str, tie: str, window: float, late: str = "0 seconds", slots: int = 1024
) -> DataFrame:
    """Drops rows whose keys passed less than ``window`` seconds before, also in earlier micro-batches.

    ``at`` is in seconds; rows of one trigger are taken in the order of (at, tie). A row that passes starts the window anew,
    one that is dropped does not; rows without a time are left out. The state is one number a key, and goes when the
    watermark has passed its window. Keys share ``slots`` groups, because a call to the state costs more than many rows.
    Columns of the stream stay as they are.
    """
    named = stream.withColumn("quiet_key", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    slotted = named.withColumn("_slot", F.pmod(F.xxhash64("quiet_key"), F.lit(slots)))
    return _stateful(slotted, ["_slot"], at, late, _Quiet(at, tie, window, stream.columns), stream.schema)


def payload_hash(payload: Column) -> Column:
    return F.sha2(F.coalesce(F.to_json(F.try_parse_json(payload)), payload), 256)


def windowed(stream: DataFrame, at: str, late: str, width: str, keys: Sequence[str], aggs: Sequence[Column], slide: str | None = None) -> DataFrame:
    """Event-time windows; a window appears once the watermark has passed it."""
    from millrace.operators.state import tumbling

    return tumbling(stream.withWatermark(at, late), F.col(at), width, keys, aggs, slide)


def session_windows(stream: DataFrame, at: str, late: str, gap: str, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    out = stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(*aggs)
    return out.withColumns({"session_start": F.col("w.start"), "session_end": F.col("w.end")}).drop("w")


def retained(stream: DataFrame, at: str = "ts", keep: str = "1 hour") -> DataFrame:
    """Watermark of a retention period: later aggregates and deduplication ignore points older than that."""
    return stream.withWatermark(at, keep)


def route(stream: DataFrame, subscriptions: DataFrame, topic: str, pattern: str = "pattern") -> DataFrame:
    """Stream-static join of events to subscribers by the shapes of their patterns (an equi-join)."""
    from millrace.operators.joins import routed

    return routed(stream, subscriptions, topic, pattern)


def batch_deliveries(stream: DataFrame, root: str, size: int = 100, checkpoint: str | None = None, window: float = 300) -> None:
    """Payload duplicates of ``window`` seconds go, whatever micro-batch their first copy came in; then, per micro-batch, similar
    events of one endpoint merge in runs of ``size``.

    Writes one folder per batch id, so a repeated batch replaces its own output.
    """
    from millrace.operators.aggregates import in_batches

    timed = stream.withColumns({"payload_hash": payload_hash(F.col("payload")), "sent_at": F.unix_micros(F.col("ts").cast("timestamp")) / 1e6})
    fresh = first_in_window(timed, ["endpoint", "event", "payload_hash"], "sent_at", "message_id", window).drop("payload_hash", "sent_at")

    def work(batch: DataFrame, batch_id: int) -> None:
        parted = in_batches(batch, ["endpoint", "event"], ["ts", "message_id"], F.to_date("ts"), size)
        merged = aggregate_similar(parted, ["endpoint", "batch"], "event", "payload", "ts", "priority")
        merged.write.mode("overwrite").parquet(f"{root}/batch_id={batch_id}")

    each_batch(fresh, work, "deliveries", checkpoint)


def dead_letters(stream: DataFrame, root: str, checkpoint: str | None = None) -> None:
    """Per micro-batch: delivered, retry and dead messages to folders of their own."""

    def work(batch: DataFrame, batch_id: int) -> None:
        split = delivery_split(batch)
        split.write.mode("overwrite").partitionBy("outcome").parquet(f"{root}/batch_id={batch_id}")

    each_batch(stream, work, "dead", checkpoint)


def scheduled_alerts(stream: DataFrame, scalar: Column, op: str, threshold: float | None, root: str, checkpoint: str | None = None) -> None:
    """Evaluates an alert condition on every micro-batch and keeps one row per evaluation."""
    from millrace.functions.predicates import alert_state

    def work(batch: DataFrame, batch_id: int) -> None:
        alert_state(batch, scalar, op, threshold).write.mode("overwrite").parquet(f"{root}/batch_id={batch_id}")

    each_batch(stream, work, "alerts", checkpoint)


def ingest(stream: DataFrame, rule: Column, root: str, checkpoint: str) -> None:
    """Incremental ingest: every new file is validated once; rows land under processed or failed."""
    from millrace.operators.quality import split_valid

    def work(batch: DataFrame, batch_id: int) -> None:
        good, bad = split_valid(batch, rule)
        good.write.mode("overwrite").parquet(f"{root}/processed/batch_id={batch_id}")
        bad.write.mode("overwrite").parquet(f"{root}/failed/batch_id={batch_id}")

    each_batch(stream, work, "ingest", checkpoint)


def limiter(stream: DataFrame, client: str, at: str, limit: int, width: float) -> DataFrame:
    """Accepts at most ``limit`` requests of a client in ``width`` seconds; only accepted ones count.

    ``at`` is in seconds; rows of one trigger are decided in time order and returned as they came. The state of a client is
    the times of its accepted requests within the window, at most ``limit`` numbers. A task holds one copy of a client's rows
    of one trigger; the rest are arrays of one number a row.
    """
    schema = T.StructType([*stream.schema.fields, T.StructField("accepted", T.BooleanType())])

    def decide(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        frames = list(batches)  # stay as they came; only the times are put in order
        times = np.concatenate([f[at].to_numpy(float) for f in frames])
        order = np.argsort(times, kind="stable")
        times, accepted = times[order], np.zeros(len(order), bool)
        i = 0
        while i < len(times):
            held = [h for h in held if h > times[i] - width]
            if len(held) < limit:
                accepted[order[i]] = True
                held.append(float(times[i]))
                i += 1
            elif held:  # nothing passes until the oldest has left the window
                first = min(held)
                i = max(i + 1, int(np.searchsorted(times, first + width)) - 1)
                while i < len(times) and times[i] - width < first:
                    i += 1
            else:
                break
        state.update((held,))
        del order, times
        rows = 0
        for k, frame in enumerate(frames):
            frames[k] = None
            rows += len(frame)
            yield frame.assign(accepted=accepted[rows - len(frame):rows])

    return stream.groupBy(client).applyInPandasWithState(decide, schema, "held array<double>", "append", GroupStateTimeout.NoTimeout)


class _Watch(StatefulProcessor):
    """Scores the points of a metric; the state is the points of one window, and goes when they have left it."""

    def __init__(self, at: str, value: str, width: float, threshold: float, least: int, names: list[str]) -> None:
        self.at, self.value, self.width, self.threshold, self.least, self.names = at, value, width, threshold, least, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.points = handle.getValueState("points", "at array<double>, value array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(self.at, kind="stable")
        held = [np.array(x, float) for x in self.points.get()] if self.points.exists() else [np.zeros(0), np.zeros(0)]
        t, v = np.concatenate([held[0], pdf[self.at].to_numpy(float)]), np.concatenate([held[1], pdf[self.value].to_numpy(float)])
        order = np.argsort(t, kind="stable")  # a late point takes its place
        t, v = t[order], v[order]
        own_t, own_v = pdf[self.at].to_numpy(float), pdf[self.value].to_numpy(float)
        first, last = np.searchsorted(t, own_t - self.width, "left"), np.searchsorted(t, own_t, "right")
        x = v - v.mean()
        sums, squares = (np.concatenate([[0], np.cumsum(a)]) for a in (x, x * x))
        n = last - first
        mean = (sums[last] - sums[first]) / n
        spread = squares[last] - squares[first] - n * mean * mean
        with np.errstate(divide="ignore", invalid="ignore"):
            scores = np.abs(own_v - v.mean() - mean) / np.sqrt(spread / (n - 1))
        found = (n >= self.least) & (spread > 1e-13 * squares[-1]) & (scores > self.threshold)
        keep = t >= t[-1] - self.width
        self.points.update((t[keep].tolist(), v[keep].tolist()))
        self.handle.registerTimer(int(np.ceil((t[-1] + self.width) * 1000)))
        yield pdf.assign(zscore=scores)[found][self.names]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.points.exists() and int(np.ceil((self.points.get()[0][-1] + self.width) * 1000)) <= expiredTimerInfo.getExpiryTimeInMs():
            self.points.clear()
        yield pd.DataFrame(columns=self.names)

    def close(self) -> None:
        pass


def live_anomalies(
    stream: DataFrame, metric: str, at: str, value: str, width: float = 300, threshold: float = 3.0, min_samples: int = 10, late: str = "0 seconds"
) -> DataFrame:
    """Points beyond ``threshold`` sample deviations of their metric's trailing window; ``at`` is in seconds.

    Windows are differences of running sums over the points of one window and those that arrived. Rows of a trigger are
    taken in time order.
    """
    schema = T.StructType([*stream.schema.fields, T.StructField("zscore", T.DoubleType())])
    return _stateful(stream, [metric], at, late, _Watch(at, value, width, threshold, min_samples, schema.names), schema)


def delayed(stream: DataFrame, key: str, at: str, due: str, late: str = "0 seconds", bucket: float = 3600, slots: int = 16) -> DataFrame:
    """Holds scheduled messages until event time passes their due time (both in seconds).

    Messages wait together by due hour and a hash of their id, so one state holds a slice of one hour
    whoever sends the messages, and a firing hands out a whole batch. Delivered messages leave no state.
    """
    schema = stream.schema
    names = schema.names
    held = ", ".join(f"`{f.name}` array<{f.dataType.simpleString()}>" for f in schema.fields)
    timed = stream.withColumn("_t", F.timestamp_micros((F.col(at) * 1_000_000).cast("bigint"))).withWatermark("_t", late)
    parted = timed.withColumns({"_bucket": F.floor(F.col(due) / bucket), "_slot": F.pmod(F.xxhash64(key), F.lit(slots))})

    def hold(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = [pd.DataFrame(dict(zip(names, state.get)))] if state.exists else []
        if not state.hasTimedOut:
            waiting += [b[names] for b in batches]
        pdf = pd.concat(waiting, ignore_index=True)
        ready = pdf[due] * 1000 <= state.getCurrentWatermarkMs()
        rest = pdf[~ready]
        if len(rest):
            state.update(tuple(rest[n].tolist() for n in names))
            state.setTimeoutTimestamp(int(rest[due].min() * 1000))
        elif state.exists:
            state.remove()
        yield pdf[ready]

    return parted.groupBy("_bucket", "_slot").applyInPandasWithState(hold, schema, held, "append", GroupStateTimeout.EventTimeTimeout)
