from pyspark.sql import Window as W, functions as F

from millrace.catalog import Family, Tables
from millrace.operators import scopes as S
from millrace.operators.anomaly import half_means, resource_severity
from millrace.plans import runs, topn, windows

family = Family()
def seconds_col():
    return F.unix_micros(F.col("ts").cast("timestamp")) / 1e6



@family.add("t04_sort_string_page", "select c_custkey, c_name, c_acctbal from customer order by c_acctbal desc, c_custkey limit 15 offset 15")
def _(spark, sf):
    return S.sorted_page(Tables(spark, sf).customer.select("c_custkey", "c_name", "c_acctbal"), ["-c_acctbal", "c_custkey"], page=2)


@family.add("t05_top_n", "select doc_id, n_chars from documents order by n_chars desc, doc_id limit 20")
def _(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20)


@family.add("t06_depth_then_path", r"""
with p as (select page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') as path from pages)
select page_id, path, (len(path) - len(replace(path, '/', '')))::int as depth from p order by depth, path, page_id""")
def _(spark, sf):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    p = Tables(spark, sf).pages.select("page_id", path.alias("path"))
    return p.withColumn("depth", F.size(F.split("path", "/")) - 1).orderBy("depth", "path", "page_id")


@family.add("t07_value_counts_top", """
select p_brand, p_type, n from (select p_brand, p_type, count(*) as n, row_number() over (partition by p_brand order by count(*) desc, p_type) as r from part group by 1, 2) where r <= 3""")
def _(spark, sf):
    counts = Tables(spark, sf).part.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return topn.top_per_key(counts, ["p_brand"], [F.desc("n"), F.asc("p_type")], 3, ["p_type"])


@family.add("t08_severity_order", """
with c as (select event_type, count(*) as n, case event_type when 'error' then 'critical' when 'purchase' then 'high' when 'signup' then 'medium' when 'click' then 'low' else 'info' end as severity from events group by 1)
select row_number() over (order by case severity when 'critical' then 1 when 'high' then 2 when 'medium' then 3 when 'low' then 4 else 5 end) as pos, severity, n from c""")
def _(spark, sf):
    names = {"error": "critical", "purchase": "high", "signup": "medium", "click": "low", "view": "info"}
    sev = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("event_type")]
    c = Tables(spark, sf).events.groupBy(sev.alias("severity")).agg(F.count("*").alias("n"))
    order = W.partitionBy(F.lit(0)).orderBy(resource_severity(F.col("severity")))  # one row per severity
    return c.select(F.row_number().over(order).cast("bigint").alias("pos"), "severity", "n")


@family.add("t09_capped_list", """
select event_id, user_id, (select count(*) from events where event_type = 'error') as total from events where event_type = 'error' order by ts desc, event_id limit 50""")
def _(spark, sf):
    e = Tables(spark, sf).events
    return S.capped_list(e, ["-ts", "event_id"], 50, F.col("event_type") == "error").select("event_id", "user_id", "total")


@family.add("w01_first_and_latest", """
select user_id, arg_min(event_id, (ts, event_id)) as first_id, arg_max(event_id, (ts, event_id)) as last_id from events group by 1""")
def _(spark, sf):
    e = Tables(spark, sf).events.select("user_id", "event_id", "ts")
    first = topn.first_per_key(e, ["user_id"], ["ts", "event_id"]).select("user_id", F.col("event_id").alias("first_id"))
    last = topn.first_per_key(e, ["user_id"], ["ts", "event_id"], latest=True).select("user_id", F.col("event_id").alias("last_id"))
    return first.join(last, "user_id")


@family.add("w02_trailing_window", """
select event_id, count(*) over w as win_n, round(avg(value) over w, 8) as win_mean, round(coalesce(stddev_samp(value) over w, -1), 5) as win_std from events
window w as (partition by event_type order by ts range between interval 21600 seconds preceding and current row)""")
def _(spark, sf):
    e = Tables(spark, sf).events.select("event_id", "event_type", "value", seconds_col().alias("t"))
    out = windows.sliding_moments(e, ["event_type"], "t", "value", 21600)
    return out.select("event_id", "win_n", F.round("win_mean", 8).alias("win_mean"), F.round(F.coalesce("win_std", F.lit(-1.0)), 5).alias("win_std"))


@family.add("w03_half_means", """
with l as (select event_id, list(value) over w as v from events window w as (partition by event_type order by ts range between interval 1 day preceding and current row))
select event_id, len(v) as win_n, round(list_avg(v[1:len(v)//2]), 9) as first_mean, round(list_avg(v[len(v)//2+1:]), 9) as second_mean from l where len(v) >= 2""")
def _(spark, sf):
    e = Tables(spark, sf).events.select("event_id", "event_type", "value", seconds_col().alias("t"))
    out = half_means(e, ["event_type"], "t", "event_id", "value", 86400).where("win_n >= 2")
    return out.select("event_id", "win_n", F.round("first_mean", 9).alias("first_mean"), F.round("second_mean", 9).alias("second_mean"))


@family.add("w04_retention", """
select event_id, user_id from (select event_id, user_id, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r <= 50""")
def _(spark, sf):
    e = Tables(spark, sf).events.select("event_id", "user_id", "ts")
    return topn.top_per_key(e, ["user_id"], [F.desc("ts"), F.desc("event_id")], 50, ["event_id"]).select("event_id", "user_id")


@family.add("w05_numbering", """
select l_orderkey, l_linenumber, row_number() over (partition by l_returnflag, l_linestatus order by l_orderkey, l_linenumber) as number from lineitem""")
def _(spark, sf):
    lines = Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    out = runs.numbered(lines, ["l_returnflag", "l_linestatus"], ["l_orderkey", "l_linenumber"], F.floor(F.col("l_orderkey") / 4096), "number")
    return out.select("l_orderkey", "l_linenumber", "number")


@family.add("w06_previous_next", """
select conv_id, turn, coalesce(lag(role) over w, 'none') as prev_role, coalesce(lead(turn) over w, -1) as next_turn from conversations window w as (partition by conv_id order by turn)""")
def _(spark, sf):
    c = Tables(spark, sf).conversations.select("conv_id", "turn", "role")
    out = runs.neighbours(c, ["conv_id"], ["turn"], F.floor(F.col("turn") / 1000), {"prev_role": "role"}, {"next_turn": "turn"})
    return out.select("conv_id", "turn", F.coalesce("prev_role", F.lit("none")).alias("prev_role"), F.coalesce("next_turn", F.lit(-1)).alias("next_turn"))


@family.add("w07_version_number", """
select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as version from orders""")
def _(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderkey", "o_custkey", "o_orderdate")
    out = runs.numbered(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], F.date_trunc("month", "o_orderdate"), "version")
    return out.select("o_orderkey", "o_custkey", "version")
