"""Streams give what the same operator gives on the table."""
from pyspark.sql import functions as F

from millrace.operators import anomaly as N, state as S
from millrace.session import scratch_path
from millrace.streaming import streams as R


def seconds():
    return F.unix_micros(F.col("ts").cast("timestamp")) / 1e6


def stream(spark, data):
    table = spark.read.parquet(f"{data}/events.parquet")
    return table, R.event_time(R.read_stream(spark, data, table.schema, "events.parquet"))


def test_live_anomalies_equal_table(spark, data):
    table, s = stream(spark, data)
    pick = lambda d: d.select("event_id", "event_type", seconds().alias("t"), "value")
    live = R.land(R.live_anomalies(pick(s), "event_type", "t", "value", 3 * 86400), "live")
    batch = N.zscore_anomalies(pick(table), ["event_type"], "t", "value", 3 * 86400)
    assert {r.event_id for r in live.collect()} == {r.event_id for r in batch.collect()}


def test_limiter_equals_table(spark, data):
    table, s = stream(spark, data)
    pick = lambda d: d.select("event_id", (F.col("user_id") % 2).alias("c"), F.floor(seconds()).cast("double").alias("t"))
    live = R.land(R.limiter(pick(s), "c", "t", 2, 7200), "limit").where("accepted").groupBy("c").count()
    batch = S.sliding_limit(pick(table), "c", "t", 2, 7200).groupBy("c").agg(F.sum("accepted").alias("count"))
    assert {(r.c, r["count"]) for r in live.collect()} == {(r.c, r["count"]) for r in batch.collect()}


def test_state_survives_between_runs(spark, data):
    """Files that arrive later continue the state: split the table over two runs of one query."""
    table, _ = stream(spark, data)
    folder, out, marks = scratch_path(spark, "in"), scratch_path(spark, "out"), scratch_path(spark, "marks")
    rows = table.select("event_id", F.lit("c").alias("c"), seconds().alias("t"))
    cut = rows.agg(F.percentile_approx("t", 0.5)).first()[0]
    for part in (rows.where(F.col("t") <= cut), rows.where(F.col("t") > cut)):
        part.coalesce(1).write.mode("append").parquet(folder)
        limited = R.limiter(R.read_stream(spark, folder, rows.schema), "c", "t", 3, 50000)
        q = limited.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
        q.awaitTermination()
    accepted = spark.read.parquet(out).where("accepted").count()
    times = sorted(r.t for r in rows.collect())
    held, want = [], 0
    for t in times:
        held = [h for h in held if h > t - 50000]
        if len(held) < 3:
            held.append(t)
            want += 1
    assert accepted == want


def test_delayed_messages_keep_every_sender(spark, data):
    table, s = stream(spark, data)
    pick = lambda d: d.select("event_id", seconds().alias("t"), (seconds() + 5 * 86400).alias("due"))
    got = {r.event_id for r in R.land(R.delayed(pick(s), "event_id", "t", "due", bucket=86400, slots=2), "due").collect()}
    newest = pick(table).agg(F.max("t")).first()[0]
    assert got == {r.event_id for r in pick(table).where(F.col("due") < newest - 0.001).collect()}


def test_ingest_takes_files_once(spark, data):
    _, s = stream(spark, data)
    root, marks = scratch_path(spark, "ingest"), scratch_path(spark, "marks")
    for _ in range(2):
        R.ingest(s, F.col("value") > 5, root, marks)
    total = spark.read.parquet(f"{root}/processed").count() + spark.read.parquet(f"{root}/failed").count()
    assert total == spark.read.parquet(f"{data}/events.parquet").count()


def test_repeats_pass_again_after_their_window(spark):
    """Over four micro-batches: repeats of earlier batches are dropped, late rows too, and a silent key's state goes."""
    folder, out, marks = (scratch_path(spark, label) for label in ("in", "quiet", "quiet-marks"))
    parts = [
        [("a", 1000.0, 1), ("a", 1005.0, 2), ("b", 1006.0, 3), ("b", 1006.0, 4)],
        [("a", 1009.5, 5), ("a", 1012.0, 6), ("c", 1013.0, 7)],
        [("a", 1021.9, 8), ("b", 1100.0, 9), ("late", 1002.0, 10)],
        [("a", 1101.0, 11), ("b", 1109.0, 12), ("b", 1110.0, 13), ("late", 1003.0, 14)],
    ]
    schema = "k string, t double, id int"
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = R.read_stream(spark, folder, spark.createDataFrame([], schema).schema)
        R.land(R.first_in_window(stream, ["k"], "t", "id", 10.0), "quiet", out=out, checkpoint=marks)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 3, 6, 7, 9, 11, 13]
    state = spark.read.format("statestore").option("path", marks).option("stateVarName", "last").load()
    assert state.count() == 2  # a and b; c and the late key are forgotten


def test_many_keys_share_few_groups(spark):
    """900 keys, one of them null, in four groups of state; rows without a time are left out."""
    folder, out, marks = (scratch_path(spark, label) for label in ("in", "slots", "slots-marks"))
    rows = [(None if i % 900 == 7 else i % 900, None if i == 1803 else 1000.0 + i // 300, i) for i in range(3600)]
    schema = "k int, t double, id int"
    for part in (rows[:1800], rows[1800:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        s = R.read_stream(spark, folder, spark.createDataFrame([], schema).schema)
        R.land(R.first_in_window(s, ["k"], "t", "id", 5.0, slots=4), "slots", out=out, checkpoint=marks)
    last, want = {}, []
    for k, t, i in rows:
        if t is not None and t >= last.get(k, 0) + 5:
            last[k] = t
            want.append(i)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == want
    state = spark.read.format("statestore").option("path", marks).option("stateVarName", "last").load()
    assert 0 < state.select("key").distinct().count() <= 4


def test_limiter_keeps_one_copy_of_a_trigger(spark):
    """Rows come back batch by batch in the order they came, each with its verdict, and not as one sorted copy."""
    n = 40_000
    rows = spark.range(n, numPartitions=1).select("id", F.lit("c").alias("c"), (F.lit(n) - F.col("id")).cast("double").alias("t"))
    folder = scratch_path(spark, "in")
    rows.write.parquet(folder)
    out = R.land(R.limiter(R.read_stream(spark, folder, rows.schema), "c", "t", 3, 50.0), "copy")
    assert out.count() == n and {r.t for r in out.where("accepted").collect()} == {1.0 + 50 * (i // 3) + i % 3 for i in range(n // 50 * 3)}
    assert out.withColumn("at", F.monotonically_increasing_id()).where("at = 0 and id = 0").count() == 1
