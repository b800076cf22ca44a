from pyspark.sql import functions as F

from millrace.catalog import Family, Tables
from millrace.operators import aggregates as A, anomaly as N
from millrace.session import cut

family = Family()
def seconds_col():
    return F.unix_micros(F.col("ts").cast("timestamp")) / 1e6

DAY = 86400
def hour_chunk_col():
    return F.floor(F.col("t") / 86400)



def points(t):
    return t.events.select("event_id", "event_type", "user_id", seconds_col().alias("t"), "value")


SEV = "case when {s} > {a} then 'critical' when {s} > {b} then 'high' when {s} > {c} then 'medium' else 'low' end"
Z_SQL = f"""
z as (select *, abs((value - m) / nullif(s, 0)) as z from (select event_id, event_type, epoch_us(ts) / 1e6 as t, value, count(*) over w as n, avg(value) over w as m, stddev_samp(value) over w as s from events
  window w as (partition by event_type order by ts range between interval 1 day preceding and current row))),
zs as (select event_id, event_type, t, 'zscore' as method, case when value > m then 'spike' else 'drop' end as kind, {SEV.format(s='z', a=5, b=4, c=3.5)} as severity, round(z, 5) as deviation, round(least(0.99, 0.5 + (z - 3) * 0.1), 5) as confidence from z where n >= 10 and z > 3)
"""
O_SQL = f"""
l as (select event_id, event_type, epoch_us(ts) / 1e6 as t, value, list_sort(list(value) over (partition by event_type order by ts range between interval 1 day preceding and current row)) as v from events),
o as (select *, len(v) as n, v[len(v) // 4 + 1] as q1, v[3 * len(v) // 4 + 1] as q3, list_median(v) as med from l),
o2 as (select *, q3 - q1 as iqr, greatest(value - (q3 + 1.5 * (q3 - q1)), q1 - 1.5 * (q3 - q1) - value) / nullif(q3 - q1, 0) as dev, list_median(list_transform(v, lambda x: abs(x - med))) as mad from o),
iq as (select event_id, event_type, t, 'iqr' as method, case when value > q3 then 'spike' else 'drop' end as kind, {SEV.format(s='dev', a=3, b=2, c=1)} as severity, round(dev, 5) as deviation, round(least(0.95, 0.6 + dev * 0.1), 5) as confidence from o2 where n >= 10 and iqr <> 0 and dev > 0),
md as (select event_id, event_type, t, 'mad' as method, case when value > med then 'spike' else 'drop' end as kind, {SEV.format(s='mz', a=5, b=4, c=3.5)} as severity, round(mz, 5) as deviation, round(least(0.97, 0.55 + (mz - 3) * 0.1), 5) as confidence
  from (select *, 0.6745 * abs(value - med) / nullif(mad, 0) as mz from o2) where n >= 10 and mad <> 0 and mz > 3)
"""
T_SQL = """
h as (select event_id, event_type, epoch_us(ts) / 1e6 as t, list(value) over w as v, stddev_samp(value) over w as s from events window w as (partition by event_type order by ts range between interval 1 day preceding and current row)),
tr as (select event_id, event_type, t, 'trend_change' as method, 'trend_change' as kind, case when r > 5 then 'high' else 'medium' end as severity, round(r, 5) as deviation, round(least(0.9, 0.5 + r * 0.05), 5) as confidence
  from (select *, abs(list_avg(v[len(v)//2+1:]) - list_avg(v[1:len(v)//2])) / nullif(s, 0) as r from h where len(v) >= 20) where r > 0.6)
"""
SHOW = ["event_id", "event_type", "method", "kind", "severity", "deviation", "confidence"]
SHOW_SQL = ", ".join(SHOW)


def shown(df):
    return df.select(*SHOW).withColumns({"deviation": F.round("deviation", 5), "confidence": F.round("confidence", 5)})


@family.add("n01_zscore", f"with {Z_SQL} select {SHOW_SQL} from zs")
def _(spark, sf):
    return shown(N.zscore_anomalies(points(Tables(spark, sf)), ["event_type"], "t", "value", DAY))


@family.add("n02_iqr", f"with {O_SQL} select {SHOW_SQL} from iq")
def _(spark, sf):
    return shown(N.iqr_anomalies(points(Tables(spark, sf)), ["event_type"], "t", "value", "event_id", DAY))


@family.add("n03_mad", f"with {O_SQL} select {SHOW_SQL} from md")
def _(spark, sf):
    return shown(N.mad_anomalies(points(Tables(spark, sf)), ["event_type"], "t", "value", "event_id", DAY))


@family.add("n04_trend_change", f"with {T_SQL} select {SHOW_SQL} from tr")
def _(spark, sf):
    return shown(N.trend_anomalies(points(Tables(spark, sf)), ["event_type"], "t", "value", "event_id", DAY, 0.6))


ALL_SQL = f"with {Z_SQL}, {O_SQL}, {T_SQL}, a as (select * from zs union all select * from iq union all select * from md union all select * from tr)"


def detected(t):
    return N.detect(points(t), ["event_type"], "t", "value", "event_id", DAY, DAY, 0.6)


@family.add("n05_combined", ALL_SQL + f" select {SHOW_SQL} from a")
def _(spark, sf):
    return shown(detected(Tables(spark, sf)))


@family.add("n06_alerts_cooldown", """
with recursive z as (select event_type, epoch_us(ts) as t, value, avg(value) over w as m, stddev_samp(value) over w as s, count(*) over w as n from events
  window w as (partition by event_type order by ts range between interval 1 day preceding and current row)),
a as (select event_type, case when value > m then 'spike' else 'drop' end as kind, t, row_number() over (partition by event_type, value > m order by t) as rn from z where n >= 10 and abs((value - m) / nullif(s, 0)) > 1.5),
f as (select event_type, kind, t, rn, t as last, true as fires from a where rn = 1
  union all select a.event_type, a.kind, a.t, a.rn, case when a.t - f.last >= 21600000000 then a.t else f.last end, a.t - f.last >= 21600000000 from f join a on a.event_type = f.event_type and a.kind = f.kind and a.rn = f.rn + 1)
select event_type, kind, round(t / 1e6, 3) as t from f where fires""")
def _(spark, sf):
    found = N.zscore_anomalies(points(Tables(spark, sf)), ["event_type"], "t", "value", DAY, threshold=1.5)
    return N.with_cooldown(found, ["event_type", "kind"], "t", 21600).withColumn("t", F.round("t", 3))


@family.add("n07_alert_queries", ALL_SQL + """,
p as (select event_id, event_type, t, count(*) as methods, min(case severity when 'critical' then 1 when 'high' then 2 when 'medium' then 3 else 4 end) as sev from a group by 1, 2, 3),
k as (select *, event_type = 'error' as acknowledged from p where sev = 1 and t > 1705000000)
select event_id, event_type, methods, (select count(*) from k where not acknowledged) as active from k where not acknowledged order by t desc, event_id limit 30""")
def _(spark, sf):
    # Alerts are a stored table; the list, the acknowledgements and the count all read it.
    alerts = cut(N.first_anomaly(detected(Tables(spark, sf)), ["event_id", "event_type", "t"]).withColumn("acknowledged", F.lit(False)), "alerts")
    gone = alerts.where("event_type = 'error'").select("event_id")
    alerts = N.acknowledge(alerts, gone, "event_id").where("severity = 'critical' and t > 1705000000")
    active = N.count_by(alerts, {"active": ~F.col("acknowledged")}).scalar()
    return N.alert_list(alerts, "critical", 1705000000, only_open=True, limit=30).select("event_id", "event_type", "methods").withColumn("active", active)


@family.add("n08_recommendations", """
with m as (select event_id, user_id % 5 as host, ts, value / 100 as memory, user_id % 13 as connections, value * 4 as latency from events),
r as (select event_id, avg(memory) over w as m, avg(connections) over w as c, avg(latency) over w as l from m window w as (partition by host order by ts, event_id rows between 29 preceding and current row))
select category, priority, suggested, count(*) as n from (
  select 'memory' as category, case when m > 0.8 then 'high' else 'medium' end as priority, 0 as suggested from r where m > 0.7
  union all select 'connections', 'medium', 15 from r where c > 8 union all select 'performance', 'high', 0 from r where l > 200
  union all select 'batch_size', 'low', 120 from r where l < 150) group by 1, 2, 3""")
def _(spark, sf):
    m = Tables(spark, sf).events.select(
        "event_id", (F.col("user_id") % 5).alias("host"), "ts", (F.col("value") / 100).alias("memory"),
        (F.col("user_id") % 13).alias("connections"), (F.col("value") * 4).alias("latency"))
    means = N.rolling_means(m, ["host"], ["ts", "event_id"], F.to_date("ts"), ["memory", "connections", "latency"])
    advice = N.recommendations(means, batch_target=300.0)
    return advice.groupBy("category", "priority", "suggested").agg(F.count("*").alias("n"))


@family.add("n09_delivery_report", """
select user_id, case when event_type = 'error' then 500 else 200 end as status, count(*) as deliveries, round(count(*) filter (event_type <> 'error') / count(*), 6) as success_rate,
  sum(case when event_type = 'error' then 3 else 0 end)::bigint as retries, round(avg(value), 6) as mean_latency, max(value) as max_latency from events group by 1, 2""")
def _(spark, sf):
    log = Tables(spark, sf).events.withColumn("status", F.when(F.col("event_type") == "error", 500).otherwise(200))
    ok = F.col("event_type") != "error"
    out = N.delivery_report(log, ["user_id", "status"], ok, "value", F.when(ok, 0).otherwise(3))
    return out.withColumns({"success_rate": F.round("success_rate", 6), "mean_latency": F.round("mean_latency", 6)})


HEALTH_SQL = """
with recursive o as (select user_id, event_type <> 'error' as ok, value, row_number() over (partition by user_id order by ts, event_id) as rn from events),
f as (select user_id, 0::bigint as rn, 0.0::double as ema, 0::bigint as score from (select distinct user_id from events)
  union all select o.user_id, o.rn, case when ok then 0.3 * value + 0.7 * ema else ema end, case when ok then greatest(score - 1, 0) else score + 1 end from f join o on o.user_id = f.user_id and o.rn = f.rn + 1),
e as (select user_id, arg_max(ema, rn) as ema, arg_max(score, rn) as score from f group by 1)
"""


@family.add("n10_endpoint_health", HEALTH_SQL + """
select user_id, round(ema, 6) as ema, score as failure_score, score < 5 as healthy, coalesce(case when score < 5 then rank() over (partition by score < 5 order by ema) end, 0)::bigint as latency_rank from e""")
def _(spark, sf):
    log = points(Tables(spark, sf))
    out = N.endpoint_health(log, "user_id", ["t", "event_id"], hour_chunk_col(), F.col("event_type") != "error", "value")
    return out.select("user_id", F.round("ema", 6).alias("ema"), "failure_score", "healthy", F.coalesce("latency_rank", F.lit(0)).cast("bigint").alias("latency_rank"))


@family.add("n11_outages", """
with r as (select user_id, ts, event_id, event_type in ('error', 'view') as bad, sum((event_type not in ('error', 'view'))::int) over (partition by user_id order by ts, event_id) as island from events),
k as (select *, row_number() over (partition by user_id, island order by ts, event_id) as k from r where bad)
select user_id, count(*) as failures, round(epoch_us(min(ts) filter (k = 4)) / 1e6, 3) as opened_at, round(epoch_us(max(ts)) / 1e6, 3) as last_failure from k group by user_id, island having count(*) >= 4""")
def _(spark, sf):
    out = N.outage_intervals(points(Tables(spark, sf)), ["user_id"], ["t", "event_id"], hour_chunk_col(), "t", F.col("event_type").isin("error", "view"), 4)
    return out.select("user_id", "failures", F.round("opened_at", 3).alias("opened_at"), F.round("last_failure", 3).alias("last_failure"))


@family.add("n11_failure_rate", """
with r as (select event_id, user_id, count(*) over w as requests, sum((event_type = 'error')::int) over w as failures from events window w as (partition by user_id order by ts, event_id rows unbounded preceding))
select event_id, requests, failures::bigint as failures from r where requests >= 10 and failures / requests >= 0.3""")
def _(spark, sf):
    out = N.failure_rate_breaches(points(Tables(spark, sf)), ["user_id"], ["t", "event_id"], hour_chunk_col(), F.col("event_type") == "error", 0.3, 10)
    return out.select("event_id", F.col("requests").cast("bigint").alias("requests"), F.col("failures").cast("bigint").alias("failures"))


@family.add("n12_rate_breach", """
select event_id, offered from (select event_id, count(*) over (partition by user_id % 3 order by ts range between interval 3600 seconds preceding and current row) as offered from events) where offered > 6""")
def _(spark, sf):
    e = points(Tables(spark, sf)).withColumn("client", F.col("user_id") % 3)
    return N.rate_breaches(e, ["client"], "t", 6, 3600).select("event_id", "offered")


@family.add("w08_ema", """
with recursive o as (select event_type, value, row_number() over (partition by event_type order by ts, event_id) as rn from events),
f as (select event_type, 0::bigint as rn, 0.0::double as ema from (select distinct event_type from events)
  union all select o.event_type, o.rn, 0.3 * value + 0.7 * ema from f join o on o.event_type = f.event_type and o.rn = f.rn + 1)
select event_type, round(arg_max(ema, rn), 6) as ema from f group by 1""")
def _(spark, sf):
    return N.final_ema(points(Tables(spark, sf)), ["event_type"], ["t", "event_id"], F.floor(F.col("t") / 3600), "value").withColumn("ema", F.round("ema", 6))


@family.add("w09_streak", """
with r as (select *, sum((event_type <> 'error')::int) over (partition by user_id order by ts, event_id) as island from events)
select event_id, sum((event_type = 'error')::int) over (partition by user_id, island order by ts, event_id)::bigint as streak from r""")
def _(spark, sf):
    return N.streaks(points(Tables(spark, sf)), ["user_id"], ["t", "event_id"], hour_chunk_col(), F.col("event_type") == "error").select("event_id", "streak")


@family.add("w10_failed_logins", """
select event_id, recent_failures from (select event_id, count(*) over (partition by user_id order by ts range between interval 2 day preceding and current row) as recent_failures from events where event_type = 'error') where recent_failures >= 3""")
def _(spark, sf):
    return N.frequent_failures(points(Tables(spark, sf)), ["user_id"], "t", F.col("event_type") == "error", 2 * DAY, 3).select("event_id", "recent_failures")


@family.add("n09_latency_histogram", """
select user_id % 10 as endpoint, le, n from (select user_id % 10 as user_id, unnest(['10','50','100','250','+Inf']) as le,
  unnest([count(*) filter (value <= 10), count(*) filter (value <= 50), count(*) filter (value <= 100), count(*) filter (value <= 250), count(*)]) as n from events group by 1)""")
def _(spark, sf):
    e = Tables(spark, sf).events.select((F.col("user_id") % 10).alias("endpoint"), "value")
    return A.histogram(e, ["endpoint"], "value", (10, 50, 100, 250)).select("endpoint", "le", "n")
