from pyspark.sql import functions as F

from millrace.plans.runs import numbered
from millrace.catalog import Family, Tables
from millrace.catalog.joins import UPSERT, upsert_sides
from millrace.operators import joins as J, scopes, state as S
from millrace.session import scratch_path
from millrace.sources import writers

family = Family()
def as_of():
    return F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")

def seconds_col():
    return F.unix_micros(F.col("ts").cast("timestamp")) / 1e6

def chunk_col():
    return F.floor(F.col("seq") / 1000)



def changes(t):
    """Events as changes: a user is a key, errors delete it."""
    return t.events.select(
        F.concat(F.lit("u"), "user_id").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"),
        "value", "ts", F.when(F.col("event_type") != "click", 86400).alias("ttl_seconds"))


CH = "c as (select 'u' || user_id as key, event_id as seq, case when event_type = 'error' then 'delete' else 'put' end as op, value, ts, case when event_type <> 'click' then 86400 end as ttl from events)"
HIST = CH + """, h as (select *, lag(op) over w as before, row_number() over w as version, row_number() over (partition by key order by seq desc) as back from c window w as (partition by key order by seq)),
hh as (select *, case when op = 'delete' then 'delete' when coalesce(before, 'delete') = 'delete' then 'create' else 'update' end as operation from h)"""


@family.add("v01_current", f"with {CH} select key, arg_max(value, seq) as value, max(seq) as seq from c group by 1 having arg_max(op, seq) <> 'delete'")
def _(spark, sf):
    return S.current(changes(Tables(spark, sf))).select("key", "value", "seq")


@family.add("v01_classify", f"with {HIST} select operation, count(*) as n, sum(seq)::bigint as s from hh group by 1")
def _(spark, sf):
    return S.classify(changes(Tables(spark, sf)), chunk_col()).groupBy("operation").agg(F.count("*").alias("n"), F.sum("seq").alias("s"))


@family.add("v02_history", f"with {HIST} select key, version, operation, value from hh where back <= 50")
def _(spark, sf):
    return S.history(changes(Tables(spark, sf)), 50, chunk_col()).select("key", "version", "operation", "value")


@family.add("v03_rollback", f"""
with {HIST}, r as (select key, seq + 10000000 as seq, op, value from hh where version = 2 and op <> 'delete'), a as (select key, seq, op, value from c union all select * from r)
select key, arg_max(value, seq) as value, max(seq) as seq from a group by 1 having arg_max(op, seq) <> 'delete'""")
def _(spark, sf):
    c = changes(Tables(spark, sf))
    wanted = c.select("key").distinct().withColumn("version", F.lit(2))
    return S.current(S.rollback(c, wanted, F.col("seq") + 10000000, chunk_col())).select("key", "value", "seq")


@family.add("v04_live_export", f"""
with {CH}, l as (select key, arg_max(op, seq) as op, arg_max(ts, seq) as ts, arg_max(coalesce(ttl, -1), seq) as ttl from c group by 1)
select key from l where op <> 'delete' and not (ttl > 0 and epoch_us(timestamp '2024-01-31 00:00:00') - epoch_us(ts) > ttl::bigint * 1000000)""")
def _(spark, sf):
    return S.live(changes(Tables(spark, sf)), as_of()).select("key")


@family.add("v05_composite_key", "select event_type as entity_type, user_id as entity_id, arg_max(value, event_id) as value from events where event_type in ('view', 'click') group by 1, 2")
def _(spark, sf):
    e = Tables(spark, sf).events.select(F.col("event_type").alias("entity_type"), F.col("user_id").alias("entity_id"), "value", F.col("event_id").alias("seq"), F.lit("put").alias("op"))
    latest = S.current(e, ("entity_type", "entity_id"))
    return latest.where(F.col("entity_type").isin("view", "click")).select("entity_type", "entity_id", "value")


@family.add("v06_audit_log", f"with {CH} select sha256(key || '|' || seq) as id, key as entity_id, op as operation from c where op = 'delete' and ts > timestamp '2024-01-20 00:00:00' order by ts desc, id desc limit 200")
def _(spark, sf):
    path = scratch_path(spark, "audit")
    S.write_audit(S.audit_rows(changes(Tables(spark, sf))), path)
    log = spark.read.parquet(path)
    # The day is the partition column, so the time filter prunes folders.
    recent = log.where(F.col("day") >= F.lit("2024-01-20").cast("date"))
    return scopes.audit_query(recent, operation="delete", since="2024-01-20 00:00:00", limit=200).select("id", "entity_id", "operation")


@family.add("v07_upsert_counts", UPSERT + "select count(*) filter (old.key is null) as created, count(*) filter (old.key is not null and new.key is not null) as updated from old full join new on old.key = new.key")
def _(spark, sf):
    old, new = upsert_sides(Tables(spark, sf))
    return S.upsert_counts(J.merge_rows(old, new, ["key"]))


@family.add("k05_upsert_sink", UPSERT + "select coalesce(new.key, old.key) as key, coalesce(new.v, old.v) as v from old full join new on old.key = new.key")
def _(spark, sf):
    old, new = upsert_sides(Tables(spark, sf))
    path = scratch_path(spark, "upsert")
    writers.upsert_by_key(old, new, ["key"], path)
    return spark.read.parquet(path)


@family.add("v08_tag_index", "select doc_id as key from documents where lang = 'fr' or source = 'src7'")
def _(spark, sf):
    entries = Tables(spark, sf).documents.select(F.col("doc_id").alias("key"), F.array("lang", "source").alias("tags"))
    return S.by_tag(entries, S.tag_index(entries), ["fr", "src7"]).select("key")


def messages(t):
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return t.events.select(
        F.col("event_id").alias("message_id"), "ts", (F.col("user_id") % 5).cast("int").alias("priority"), F.when(F.col("event_type") == "error", 503).when(F.col("event_type") == "view", 404).otherwise(200).alias("status_code"),
        (k % 4).alias("attempts"), F.lit(3).alias("max_attempts"), (F.col("ts") + F.expr("INTERVAL 2 DAY")).alias("scheduled_at"), F.when(F.col("event_type") != "click", F.col("ts") + F.expr("INTERVAL 12 DAY")).alias("expires_at"))


@family.add("r04_due_messages", "select event_id as message_id from events where ts + interval 2 day <= timestamp '2024-01-20' and (event_type = 'click' or ts + interval 12 day > timestamp '2024-01-20')")
def _(spark, sf):
    return S.due_messages(messages(Tables(spark, sf)), F.lit("2024-01-20").cast("timestamp_ntz")).select("message_id")


@family.add("r05_dead_letters", """
with m as (select *, cast(regexp_extract(props, '([0-9]+)', 1) as int) % 4 as attempts from events)
select case when event_type = 'view' then 'dead' when event_type <> 'error' then 'delivered' when attempts < 3 then 'retry' else 'dead' end as outcome, count(*) as n from m where event_type not in ('view') or ts >= timestamp '2024-01-31' - interval 10 day group by 1""")
def _(spark, sf):
    split = S.delivery_split(messages(Tables(spark, sf)))
    dead = S.purge_dead(split.where("status_code = 404"), as_of(), 10)
    return split.where("status_code <> 404").unionByName(dead).groupBy("outcome").agg(F.count("*").alias("n"))


@family.add("r12_priority_order", """
select row_number() over (order by user_id % 5 desc, ts, event_id) as pos, event_id as message_id from events""")
def _(spark, sf):
    ordered = S.priority_order(messages(Tables(spark, sf)))
    hour = F.struct(-F.col("priority"), F.date_trunc("hour", "ts"))
    return numbered(ordered, [], [F.desc("priority"), "ts", "message_id"], hour, "pos").select("pos", "message_id")


@family.add("r06_sliding_limit")
def _(spark, sf):
    e = Tables(spark, sf).events.select((F.col("user_id") % 3).alias("client"), seconds_col().alias("t"))
    return S.sliding_limit(e, "client", "t", 4, 3600)


BUCKET_SQL = """
with recursive b as (select user_id % 3 as client, floor(epoch_us(ts) / 1e6)::bigint as t, count(*) as n from events group by 1, 2),
o as (select *, row_number() over (partition by client order by t) as rn from b),
f as (select client, t, rn, least(n, 3) as accepted, n - least(n, 3) as rejected, 3.0::double - least(n, 3) as tokens from o where rn = 1
  union all select o.client, o.t, o.rn, least(n, floor(least(3.0, tokens + (o.t - f.t) * 0.001)))::bigint, (n - least(n, floor(least(3.0, tokens + (o.t - f.t) * 0.001))))::bigint,
    least(3.0, tokens + (o.t - f.t) * 0.001) - least(n, floor(least(3.0, tokens + (o.t - f.t) * 0.001))) from f join o on o.client = f.client and o.rn = f.rn + 1)
select client, t as second, accepted::bigint as accepted, rejected::bigint as rejected from f"""


@family.add("r06_token_bucket", BUCKET_SQL)
def _(spark, sf):
    e = Tables(spark, sf).events.select((F.col("user_id") % 3).alias("client"), seconds_col().alias("t"))
    return S.token_bucket(e, "client", "t", 3, 0.001)


@family.add("r08_tumbling_table", "select strftime(time_bucket(interval 6 hour, ts), '%Y-%m-%d %H:%M') as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def _(spark, sf):
    e = Tables(spark, sf).events.withColumn("ts", F.col("ts").cast("timestamp"))
    out = S.tumbling(e, F.col("ts"), "6 hours", ["event_type"], [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")])
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n", "total")


@family.add("r08_sliding_table", """
with w as (select time_bucket(interval 6 hour, ts) - to_hours((6 * i)::int) as s, event_type from events, range(0, 4) t(i))
select strftime(s, '%Y-%m-%d %H:%M') as window_start, event_type, count(*) as n from w group by 1, 2""")
def _(spark, sf):
    e = Tables(spark, sf).events.withColumn("ts", F.col("ts").cast("timestamp"))
    out = S.tumbling(e, F.col("ts"), "24 hours", ["event_type"], [F.count("*").alias("n")], "6 hours")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n")


SESSIONS = """
b as (select *, coalesce(epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts)) >= 14400000000, true) as brk from events),
s as (select *, sum(brk::int) over (partition by user_id order by ts) as session from b)
"""


@family.add("r09_sessions_table", f"with {SESSIONS} select user_id, round(epoch_us(min(ts)) / 1e6, 3) as session_start, round(epoch_us(max(ts)) / 1e6 + 14400, 3) as session_end, count(*) as n from s group by user_id, session")
def _(spark, sf):
    e = Tables(spark, sf).events.select("user_id", seconds_col().alias("t"))
    out = S.sessions(e, ["user_id"], "t", 14400, F.floor(F.col("t") / 86400), [F.count("*").alias("n")])
    return out.select("user_id", F.round("session_start", 3).alias("session_start"), F.round("session_end", 3).alias("session_end"), "n")
