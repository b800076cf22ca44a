from pyspark.sql import Window as W, functions as F

from millrace.catalog import Family, Tables
from millrace.catalog.state import SESSIONS
from millrace.session import scratch_path
from millrace.streaming import streams as R

family = Family()
def seconds_col():
    return F.unix_micros(F.col("ts").cast("timestamp")) / 1e6



def events(spark, sf):
    schema = Tables(spark, sf).events.schema
    return R.event_time(R.read_stream(spark, sf, schema, "events.parquet"))


def arrivals(spark, sf, folder):
    """The events in three instalments, ten days each; each is written to the folder when the one before has been taken."""
    table = Tables(spark, sf).events
    for k in range(3):
        table.where(F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2)) == k).write.mode("append").parquet(folder)
        yield R.event_time(R.read_stream(spark, folder, table.schema))


def topic_col():
    return F.concat_ws(".", F.lit("shop"), "event_type", F.when(F.col("value") > 60, "g0").when(F.col("value") > 20, "g1").otherwise("g2"))



@family.add("r01_topic_stream", "select event_id, 'shop.' || event_type || case when value > 60 then '.g0' when value > 20 then '.g1' else '.g2' end as topic from events where value > 20 and value <= 60")
def _(spark, sf):
    s = R.topic_stream(events(spark, sf), topic_col(), "shop.*.g1")
    return R.land(s.select("event_id", topic_col().alias("topic")), "topics")


@family.add("r02_dedup_stream", """
with recursive e as (select user_id, props, epoch_us(ts) as t, row_number() over (partition by user_id, props order by ts, event_id) as rn from events),
f as (select user_id, props, t, rn, t as last, true as passes from e where rn = 1
  union all select e.user_id, e.props, e.t, e.rn, case when e.t - f.last >= 432000000000 then e.t else f.last end, e.t - f.last >= 432000000000 from f join e on e.user_id = f.user_id and e.props = f.props and e.rn = f.rn + 1)
select user_id, props, count(*) as passed from f where passes group by 1, 2""")
def _(spark, sf):
    folder, out, marks = (scratch_path(spark, label) for label in ("in", "dedup", "dedup-marks"))
    for s in arrivals(spark, sf, folder):
        s = s.select("event_id", "user_id", "props", R.payload_hash(F.col("props")).alias("h"), seconds_col().alias("t"))
        kept = R.land(R.first_in_window(s, ["user_id", "h"], "t", "event_id", 5 * 86400), "dedup", out=out, checkpoint=marks)
    return kept.groupBy("user_id", "props").agg(F.count("*").alias("passed"))


@family.add("r03_micro_batches", """
with d as (select user_id % 10 as e, event_type, props, min_by(event_id, (ts, event_id)) as id from events group by 1, 2, 3),
k as (select d.*, least((day(ts) - 1) // 10, 2) as part, row_number() over (partition by e, d.event_type, least((day(ts) - 1) // 10, 2) order by ts, id) as rn from d join events on event_id = id)
select 'u' || e as endpoint, case when count(*) > 1 then event_type || '.batch' else event_type end as event, part::int as batch_id, ceil(rn / 5.0)::bigint as batch, count(*) as count from k group by e, event_type, part, ceil(rn / 5.0)""")
def _(spark, sf):
    folder, root, marks = (scratch_path(spark, label) for label in ("in", "batches", "batches-marks"))
    for s in arrivals(spark, sf, folder):
        s = s.select(
            F.col("event_id").alias("message_id"), F.concat(F.lit("u"), F.col("user_id") % 10).alias("endpoint"), F.col("event_type").alias("event"), "ts",
            F.col("props").alias("payload"), (F.col("user_id") % 4).alias("priority"))
        R.batch_deliveries(s, root, 5, marks, window=90 * 86400)
    ids = spark.read.parquet(root).select("batch_id").distinct()
    order = ids.select("batch_id", (F.dense_rank().over(W.orderBy("batch_id")) - 1).alias("part"))  # a row per micro-batch
    return spark.read.parquet(root).join(order, "batch_id").select("endpoint", "event", F.col("part").alias("batch_id"), "batch", "count")


@family.add("r04_delayed_stream", "select event_id, event_type from events where epoch_ms(ts) + 864000000 < (select epoch_ms(max(ts)) from events)")
def _(spark, sf):
    s = events(spark, sf).select("event_id", "event_type", seconds_col().alias("t"), (seconds_col() + 10 * 86400).alias("due"))
    return R.land(R.delayed(s, "event_id", "t", "due", bucket=86400, slots=8), "delayed").select("event_id", "event_type")


@family.add("r05_dead_letter_stream", """
select case when event_type = 'view' then 'dead' when event_type <> 'error' then 'delivered' when user_id % 4 < 3 then 'retry' else 'dead' end as outcome, count(*) as n from events group by 1""")
def _(spark, sf):
    s = events(spark, sf).select(
        "event_id", F.when(F.col("event_type") == "error", 503).when(F.col("event_type") == "view", 404).otherwise(200).alias("status_code"),
        (F.col("user_id") % 4).alias("attempts"), F.lit(3).alias("max_attempts"))
    root = scratch_path(spark, "letters")
    R.dead_letters(s, root)
    return spark.read.parquet(root).groupBy("outcome").agg(F.count("*").alias("n"))


@family.add("r06_limiter_stream")
def _(spark, sf):
    s = events(spark, sf).select("event_id", (F.col("user_id") % 3).alias("client"), seconds_col().alias("t"))
    return R.land(R.limiter(s, "client", "t", 4, 3600), "limiter")


@family.add("r07_live_anomalies", """
with z as (select event_id, abs(value - avg(value) over w) / nullif(stddev_samp(value) over w, 0) as z, count(*) over w as n from events window w as (partition by event_type order by ts range between interval 1 day preceding and current row))
select event_id, round(z, 6) as zscore from z where n >= 10 and z > 3""")
def _(spark, sf):
    folder, out, marks = (scratch_path(spark, label) for label in ("in", "live", "live-marks"))
    for s in arrivals(spark, sf, folder):
        s = s.select("event_id", "event_type", seconds_col().alias("t"), "value")
        found = R.land(R.live_anomalies(s, "event_type", "t", "value", 86400), "live", out=out, checkpoint=marks)
    return found.select("event_id", F.round("zscore", 6).alias("zscore"))


@family.add("r08_windows_stream", """
with w as (select time_bucket(interval 6 hour, ts) as s, event_type, count(*) as n from events group by 1, 2)
select strftime(s, '%Y-%m-%d %H:%M') as window_start, event_type, n from w where s + interval 6 hour <= (select max(ts) from events) - interval 1 hour""")
def _(spark, sf):
    out = R.windowed(events(spark, sf), "ts", "1 hour", "6 hours", ["event_type"], [F.count("*").alias("n")])
    return R.land(out, "windows").select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n")


@family.add("r09_sessions_stream", f"""
with {SESSIONS} select user_id, round(epoch_us(min(ts)) / 1e6, 3) as session_start, count(*) as n from s group by user_id, session
having epoch_us(max(ts)) + 14400000000 <= (select epoch_us(max(ts)) from events) - 3600000000""")
def _(spark, sf):
    out = R.session_windows(events(spark, sf), "ts", "1 hour", "4 hours", ["user_id"], [F.count("*").alias("n")])
    return R.land(out, "sessions").select("user_id", F.round(F.unix_micros("session_start") / 1e6, 3).alias("session_start"), "n")


@family.add("r10_late_data", """
with w as (select time_bucket(interval 1 day, ts) as s, count(*) as n from events group by 1) select strftime(s, '%Y-%m-%d') as day, n from w where s + interval 1 day <= (select max(ts) from events) - interval 1 hour""")
def _(spark, sf):
    s = R.retained(events(spark, sf), "ts", "1 hour")
    out = s.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")
    return R.land(out, "late").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n")


@family.add("r11_routing_stream", """
with t as (select event_id, 'shop.' || event_type || case when value > 60 then '.g0' when value > 20 then '.g1' else '.g2' end as topic from events), s as (select * from (values ('a', '^shop\\.view\\.g1$'), ('b', '^shop\\.[^.]+\\.g2$'), ('c', '^shop\\..+$')) v(subscriber, rx))
select subscriber, count(*) as n from t join s on regexp_matches(topic, rx) group by 1""")
def _(spark, sf):
    subs = spark.createDataFrame([("a", "shop.view.g1"), ("b", "shop.*.g2"), ("c", "shop.**")], "subscriber string, pattern string")
    routed = R.route(events(spark, sf).select("event_id", topic_col().alias("topic")), subs, "topic")
    return R.land(routed.select("event_id", "subscriber"), "routes").groupBy("subscriber").agg(F.count("*").alias("n"))


@family.add("r13_scheduled_alerts", "select round(avg(value), 6) as value, avg(value) > 40 as fires from events")
def _(spark, sf):
    root = scratch_path(spark, "alerts")
    R.scheduled_alerts(events(spark, sf), F.avg("value"), ">", 40, root)
    return spark.read.parquet(root).select(F.round("value", 6).alias("value"), "fires")


@family.add("r14_incremental_ingest", "select case when value > 5 then 'processed' else 'failed' end as side, count(*) as n from events group by 1")
def _(spark, sf):
    root, marks = scratch_path(spark, "ingest"), scratch_path(spark, "ingest-marks")
    for _ in range(2):  # the second run finds nothing new
        R.ingest(events(spark, sf), F.col("value") > 5, root, marks)
    sides = [spark.read.parquet(f"{root}/{s}").agg(F.count("*").alias("n")).select(F.lit(s).alias("side"), "n") for s in ("processed", "failed")]
    return sides[0].unionByName(sides[1])
