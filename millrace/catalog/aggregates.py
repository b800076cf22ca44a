from pyspark.sql import functions as F

from millrace.catalog import Family, Tables
from millrace.operators import aggregates as A
from millrace.plans.ranks import index_quantiles

family = Family()


@family.add("a05_audit_report", """
with l as (select event_type as operation, 'e' || (user_id % 4) as entity_type, event_type <> 'error' as success from events order by ts desc, event_id desc limit 1000)
select 'operation' as cut, operation as key, count(*) as n from l group by 2 union all select 'entity_type', entity_type, count(*) from l group by 2
union all select 'success', success::varchar, count(*) from l group by 2""")
def _(spark, sf):
    log = Tables(spark, sf).events.select(
        "ts", "event_id", F.col("event_type").alias("operation"), F.concat(F.lit("e"), F.col("user_id") % 4).alias("entity_type"),
        (F.col("event_type") != "error").alias("success"))
    return A.audit_report(log, 1000, [F.desc("ts"), F.desc("event_id")])


@family.add("a06_facets", """
select 'lang' as field, lang as value, count(*) as n from documents group by 2 union all
select 'tags', t, count(*) from (select unnest([source, lang]) as t from documents) group by 2""")
def _(spark, sf):
    d = Tables(spark, sf).documents.select("lang", F.array("source", "lang").alias("tags"))
    return A.facets(d, ["lang", "tags"])


@family.add("a07_share_rollup", """
select lang, count(*) as files, sum(n_chars)::bigint as bytes, sum(len(text) - len(replace(text, chr(10), '')) + 1)::bigint as lines,
  round(sum(n_chars) * 100.0 / (select sum(n_chars) from documents where lang <> 'es'), 6) as percent from documents where lang <> 'es' group by 1""")
def _(spark, sf):
    d = Tables(spark, sf).documents.withColumn("lines", F.size(F.split("text", "\n")))
    return A.share_rollup(d, "lang", "n_chars", "lines", F.col("lang") != "es").withColumn("percent", F.round("percent", 6))


@family.add("a08_primary_key", """
with t as (select source, lang, sum(n_chars) as b from documents group by 1, 2)
select source, arg_min(lang, (-b, lang)) as primary_lang from t group by 1""")
def _(spark, sf):
    return A.primary_key_by(Tables(spark, sf).documents, ["source"], "lang", "n_chars")


@family.add("a10_histogram", """
with v as (select event_type, value / 50 as x from events)
select event_type, le, case when le = '+Inf' then total else n end as n, total, round(s, 4) as sum, round(m, 6) as mean from (
 select event_type, count(*) as total, sum(x) as s, avg(x) as m,
   unnest(['0.005','0.01','0.025','0.05','0.1','0.25','0.5','1','2.5','5','10','+Inf']) as le,
   unnest([count(*) filter (x <= 0.005), count(*) filter (x <= 0.01), count(*) filter (x <= 0.025), count(*) filter (x <= 0.05), count(*) filter (x <= 0.1),
     count(*) filter (x <= 0.25), count(*) filter (x <= 0.5), count(*) filter (x <= 1), count(*) filter (x <= 2.5), count(*) filter (x <= 5), count(*) filter (x <= 10), count(*)]) as n
 from v group by 1)""")
def _(spark, sf):
    v = Tables(spark, sf).events.select("event_type", (F.col("value") / 50).alias("x"))
    return A.histogram(v, ["event_type"], "x").withColumns({"sum": F.round("sum", 4), "mean": F.round("mean", 6)})


@family.add("a11_outcome_rates", """
select user_id, count(*) as total, count(*) filter (event_type <> 'error') as succeeded, count(*) filter (event_type = 'error') as failed,
  round(count(*) filter (event_type <> 'error') / count(*), 6) as success_rate, round(count(*) filter (event_type = 'error') / count(*), 6) as failure_rate
from events group by 1""")
def _(spark, sf):
    out = A.outcome_rates(Tables(spark, sf).events, ["user_id"], F.col("event_type") != "error")
    return out.withColumns({c: F.round(c, 6) for c in ("success_rate", "failure_rate")})


STATS_SQL = """
with o as (select {key} as k, {v} as v, row_number() over (partition by {key} order by {v}) as rn, count(*) over (partition by {key}) as n from {table}),
s as (select k, count(*) as count, avg(v) as mean, median(v) as median, min(v) as min, max(v) as max, stddev_samp(v) as stdev, var_samp(v) as variance,
  max(v) filter (rn = least(floor(n * 0.5) + 1, n)) as p50, max(v) filter (rn = least(floor(n * 0.95) + 1, n)) as p95, max(v) filter (rn = least(floor(n * 0.99) + 1, n)) as p99 from o group by 1)
"""


@family.add("a12_stats_bundle", STATS_SQL.format(key="event_type", v="value", table="events") + """
select k as event_type, count, round(mean, 6) as mean, round(s.median, 6) as median, min, max, round(stdev, 6) as stdev, round(variance, 5) as variance, p50, p95, p99,
  (select round(median(abs(o.v - s.median)), 6) from o where o.k = s.k) as mad from s""")
def _(spark, sf):
    out = A.stats_bundle(Tables(spark, sf).events, ["event_type"], "value")
    return out.withColumns({**{c: F.round(c, 6) for c in ("mean", "median", "stdev", "mad")}, "variance": F.round("variance", 5)})


@family.add("a13_index_quantile", """
with o as (select l_returnflag, l_extendedprice as v, row_number() over (partition by l_returnflag order by l_extendedprice) - 1 as i,
  count(*) over (partition by l_returnflag) as n from lineitem)
select l_returnflag, max(n) as n, max(v) filter (i = n // 4) as q1, max(v) filter (i = n // 2) as mid, max(v) filter (i = 3 * n // 4) as q3 from o group by 1""")
def _(spark, sf):
    return index_quantiles(Tables(spark, sf).lineitem, "l_extendedprice", {"q1": 0.25, "mid": 0.5, "q3": 0.75}, ["l_returnflag"])


BATCH_SQL = """
with r as (select event_id, 'u' || (user_id % 10) as endpoint, event_type, ts, (user_id % 4)::bigint as priority,
  ceil(row_number() over (partition by user_id % 10 order by ts, event_id) / 100.0)::bigint as batch from events)
"""


@family.add("a15_similar_events", BATCH_SQL + """
select endpoint, batch, case when count(*) > 1 then event_type || '.batch' else event_type end as event_type, count(*) as count,
  string_agg(event_id::varchar, ',' order by ts, event_id) as items, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_ts, max(priority) as priority from r group by endpoint, batch, r.event_type""")
def _(spark, sf):
    e = Tables(spark, sf).events.select(
        "event_id", F.concat(F.lit("u"), F.col("user_id") % 10).alias("endpoint"), "event_type", "ts", (F.col("user_id") % 4).alias("priority"))
    batched = A.in_batches(e, ["endpoint"], ["ts", "event_id"], F.to_date("ts"), 100)
    out = A.aggregate_similar(batched, ["endpoint", "batch"], "event_type", "event_id", "ts", "priority")
    return out.select("endpoint", "batch", "event_type", "count", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"),
                      F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("first_ts"), "priority")


@family.add("a16_distinct", """
select 'users' as what, count(distinct user_id) as n from events union all select 'types', count(distinct event_type) from events
union all select 'pairs', count(*) from (select distinct user_id, event_type from events)""")
def _(spark, sf):
    e = Tables(spark, sf).events
    wide = e.agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("types"), F.count_distinct("user_id", "event_type").alias("pairs"))
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("n")) for c in wide.columns])).alias("e")).select("e.*")


@family.add("a17_conditional_counts", """
select user_id, count(*) filter (event_type = 'view') as unread, count(*) filter (event_type = 'error') as failed, count(*) filter (value > 100) as large from events group by 1""")
def _(spark, sf):
    return A.conditional_counts(Tables(spark, sf).events, ["user_id"], {
        "unread": F.col("event_type") == "view", "failed": F.col("event_type") == "error", "large": F.col("value") > 100})


@family.add("a18_reference_statistics", """
select count(*) filter (p_type like '%STEEL') as steel, count(*) filter (p_type like '%TIN') as tin, count(*) filter (p_size > 40) as unresolved, count(*) as total from part""")
def _(spark, sf):
    return A.conditional_counts(Tables(spark, sf).part, [], {
        "steel": F.col("p_type").like("%STEEL"), "tin": F.col("p_type").like("%TIN"), "unresolved": F.col("p_size") > 40, "total": F.lit(True)})


@family.add("w11_share_rank", """
with t as (select c_nationkey, sum(c_acctbal) as b from customer group by 1)
select c_nationkey, round(b, 2) as balance, round(b / sum(b) over (), 6) as share, rank() over (order by round(b, 2) desc) as rank from t""")
def _(spark, sf):
    t = Tables(spark, sf).customer.groupBy("c_nationkey").agg(F.round(F.sum("c_acctbal"), 2).alias("balance"))
    return A.ranked_share(t, "balance").withColumn("share", F.round("share", 6))


@family.add("k08_metrics_exposition", """
with c as (select event_type, count(*) as n from events group by 1), b as (select count(*) filter (value <= 10) as b10, count(*) filter (value <= 100) as b100, count(*) as n, round(sum(value), 2) as s from events)
select 'events_' || event_type as name, 0 as seq, '# TYPE events_' || event_type || ' counter' as line from c
union all select 'events_' || event_type, 1, 'events_' || event_type || ' ' || n from c
union all select 'latency', 0, '# TYPE latency histogram' union all select 'latency', 1, 'latency_bucket{le="10"} ' || b10 from b
union all select 'latency', 2, 'latency_bucket{le="100"} ' || b100 from b union all select 'latency', 3, 'latency_bucket{le="+Inf"} ' || n from b
union all select 'latency', 100000, 'latency_sum ' || s from b union all select 'latency', 100001, 'latency_count ' || n from b""")
def _(spark, sf):
    e = Tables(spark, sf).events
    counters = e.groupBy(F.concat(F.lit("events_"), "event_type").alias("name")).agg(F.count("*").alias("value"))
    hist = A.histogram(e.withColumn("name", F.lit("latency")), ["name"], "value", (10, 100)).withColumn("sum", F.round("sum", 2).cast("decimal(20,2)"))
    return A.exposition_lines(counters, histograms=hist)
