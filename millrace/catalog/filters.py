from functools import reduce

from pyspark.sql import functions as F

from millrace.catalog import Family, Tables
from millrace.functions import ignore, predicates as P
from millrace.operators import kv, scopes as S

family = Family()
def as_of():
    return F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")



def entries(t: Tables):
    """Events as store entries; signups have no value, clicks have no TTL."""
    return t.events.select(
        F.concat(F.lit("e"), "event_id").alias("key"), "event_id", "user_id",
        F.parse_json(F.concat(F.lit('{"a":'), "props", F.lit('}'))).alias("doc"),
        F.col("event_type").alias("category"), "ts",
        F.when(F.col("event_type") != "signup", F.col("value")).alias("value"),
        F.when(F.col("event_type") != "click", F.col("user_id") * 10000).alias("ttl_seconds"),
        F.array("event_type", F.concat(F.lit("u"), F.col("user_id") % 7)).alias("tags"),
    )


ENTRIES = """
with e as (select *, 'e' || event_id as key, event_type as category, case when event_type <> 'signup' then value end as v,
  case when event_type <> 'click' then user_id * 10000 end as ttl, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k,
  'u' || (user_id % 7) as utag from events)
"""


@family.add("f02_eq_ne_null_safe", ENTRIES + """
select 'eq' as op, count(*) as n from e where v is not distinct from null
union all select 'ne', count(*) from e where v is distinct from 6.55 union all select 'eq_value', count(*) from e where v is not distinct from 6.55""")
def _(spark, sf):
    e = entries(Tables(spark, sf))
    return e.select(F.explode(F.array(
        F.struct(F.lit("eq").alias("op"), P.store_filter("value", "eq", None).alias("hit")),
        F.struct(F.lit("ne").alias("op"), P.store_filter("value", "ne", 6.55).alias("hit")),
        F.struct(F.lit("eq_value").alias("op"), P.store_filter("value", "eq", 6.55).alias("hit")),
    )).alias("x")).groupBy("x.op").agg(F.count_if("x.hit").alias("n"))


@family.add("f03_ordering", ENTRIES + """
select count(*) filter (v > 50) as gt, count(*) filter (v >= 50) as gte, count(*) filter (v < 50) as lt, count(*) filter (v <= 50) as lte,
  count(*) filter (not coalesce(v > 50, false)) as not_gt from e""")
def _(spark, sf):
    e = entries(Tables(spark, sf))
    ops = [F.count_if(P.store_filter("value", op, 50)).alias(op) for op in ("gt", "gte", "lt", "lte")]
    return e.agg(*ops, F.count_if(~P.store_filter("value", "gt", 50)).alias("not_gt"))


@family.add("f04_in_nin", ENTRIES + """
select count(*) filter (v in (6.55, 12.31, 1.63)) as n_in, count(*) filter (v not in (6.55, 12.31, 1.63)) as n_nin from e""")
def _(spark, sf):
    vals = [6.55, 12.31, 1.63]
    return entries(Tables(spark, sf)).agg(
        F.count_if(P.store_filter("value", "in", vals)).alias("n_in"), F.count_if(P.store_filter("value", "nin", vals)).alias("n_nin"))


@family.add("f05_contains_regex_exists", """
select source, count(*) filter (contains(text, 'the')) as has, count(*) filter (regexp_matches(text, '[A-Z]{3,}')) as caps,
  count(*) filter (nullif(lang, 'fr') is not null) as known, count(*) filter (nullif(lang, 'fr') is null) as unknown from documents group by 1""")
def _(spark, sf):
    d = Tables(spark, sf).documents.withColumn("lang2", F.nullif("lang", F.lit("fr")))
    return d.groupBy("source").agg(
        F.count_if(P.store_filter("text", "contains", "the")).alias("has"),
        F.count_if(P.store_filter("text", "regex", "[A-Z]{3,}")).alias("caps"),
        F.count_if(P.store_filter("lang2", "exists", True)).alias("known"),
        F.count_if(P.store_filter("lang2", "exists", False)).alias("unknown"))


@family.add("f06_nested_path", ENTRIES + """
select count(*) filter (k >= 50) as gte, count(*) filter (k <> 7) as ne, 0::bigint as ne_missing_parent, count(*) as ne_missing_leaf from e""")
def _(spark, sf):
    doc = F.col("doc")
    return entries(Tables(spark, sf)).agg(
        F.count_if(P.path_filter(doc, "a.k", "gte", 50, "int")).alias("gte"),
        F.count_if(P.path_filter(doc, "a.k", "ne", 7, "int")).alias("ne"),
        F.count_if(P.path_filter(doc, "a.k.z", "ne", 7, "int")).alias("ne_missing_parent"),
        F.count_if(P.path_filter(doc, "a.z", "ne", 7, "int")).alias("ne_missing_leaf"))


@family.add("f07_tags_category", ENTRIES + """
select category, count(*) as n, round(sum(value), 2) as total from e where (event_type in ('view') or utag in ('u3', 'view')) and category <> 'error' group by 1""")
def _(spark, sf):
    e = kv.kv_filter(entries(Tables(spark, sf)).withColumn("raw", F.col("value")), [("category", "ne", "error")], tags=["view", "u3"])
    raw = Tables(spark, sf).events.select("event_id", F.col("value").alias("v0"))
    return e.join(raw, "event_id").groupBy("category").agg(F.count("*").alias("n"), F.round(F.sum("v0"), 2).alias("total"))


@family.add("f08_ttl", ENTRIES + """
select category, count(*) as live from e
where not coalesce(ttl > 0 and epoch_us(timestamp '2024-01-31 00:00:00') - epoch_us(ts) > ttl * 1000000, false) group by 1""")
def _(spark, sf):
    live = kv.kv_filter(entries(Tables(spark, sf)), as_of=as_of())
    return live.groupBy("category").agg(F.count("*").alias("live"))


@family.add("f10_condition", """
select event_type, count(*) filter (value > 50) as numeric_gt, count(*) filter (event_type >= 'click') as text_ge,
  count(*) filter (user_id <> 8) as whole_ne from events group by 1""")
def _(spark, sf):
    return Tables(spark, sf).events.groupBy("event_type").agg(
        F.count_if(P.condition(F.col("value").cast("string"), ">", F.lit("50"))).alias("numeric_gt"),
        F.count_if(P.condition(F.concat(F.lit("'"), "event_type", F.lit("'")), ">=", F.lit('"click"'))).alias("text_ge"),
        F.count_if(P.condition_text(F.concat(F.col("user_id").cast("string"), F.lit(" != 8.0")))).alias("whole_ne"))


@family.add("f11_scopes", """
with u as (select c.c_custkey, c_name, c_mktsegment, c_acctbal, max(o_orderdate) as last_seen from customer c left join orders on o_custkey = c_custkey group by all)
select c_mktsegment, count(*) filter (last_seen >= timestamp '1998-08-01' - interval 90 day) as recent,
  count(*) filter (last_seen is null or last_seen < timestamp '1998-08-01' - interval 365 day) as inactive,
  count(*) filter (c_acctbal between 0 and 5000) as mid, count(*) filter (last_seen is null) as never,
  count(*) filter (contains(lower(c_name), '7') or contains(lower(c_mktsegment), '7')) as found,
  count(*) filter (last_seen is null or last_seen > timestamp '1998-08-01') as unexpired from u group by 1""")
def _(spark, sf):
    t = Tables(spark, sf)
    as_of = F.lit("1998-08-01").cast("timestamp_ntz")
    seen = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_seen"))
    u = t.customer.join(seen, "c_custkey", "left")
    return u.groupBy("c_mktsegment").agg(
        F.count_if(S.recent("last_seen", 90, as_of)).alias("recent"),
        F.count_if(S.inactive("last_seen", 365, as_of)).alias("inactive"),
        F.count_if(F.col("c_acctbal").between(0, 5000)).alias("mid"),
        F.count_if(F.col("last_seen").isNull()).alias("never"),
        F.count_if(S.search_like(["c_name", "c_mktsegment"], "7")).alias("found"),
        F.count_if(S.unexpired("last_seen", as_of)).alias("unexpired"))


@family.add("f12_audit_query", """
select id, operation, user_name, stamp from (select event_id as id, event_type as operation, 'user' || (user_id % 20) as user_name,
  strftime(ts, '%Y-%m-%d %H:%M:%S') as stamp, ts from events where event_type = 'error' and ts > timestamp '2024-01-10 00:00:00' order by ts desc, event_id desc limit 100)""")
def _(spark, sf):
    log = Tables(spark, sf).events.select(
        F.col("event_id").alias("id"), "ts", F.col("event_type").alias("operation"),
        F.concat(F.lit("user"), F.col("user_id") % 20).alias("user_name"))
    out = S.audit_query(log, operation="error", since="2024-01-10 00:00:00", limit=100)
    return out.select("id", "operation", "user_name", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("stamp"))


def topics_col():
    return F.concat_ws(".", F.lit("shop"), "event_type", F.when(F.col("value") > 60, "g0").when(F.col("value") > 20, "g1").otherwise("g2"))



@family.add("f13_topic_match", """
with t as (select 'shop.' || event_type || case when value > 60 then '.g0' when value > 20 then '.g1' else '.g2' end as topic from events)
select topic, count(*) as n, (topic = 'shop.view.g1') as exact, regexp_matches(topic, '^shop\\.[^.]+\\.g1$') as one,
  false as short, true as deep, topic like 'shop.view.%' as branch, true as loose from t group by 1""")
def _(spark, sf):
    topic = F.col("topic")
    counted = Tables(spark, sf).events.groupBy(topics_col().alias("topic")).agg(F.count("*").alias("n"))
    return counted.select(
        "topic", "n", P.topic_matches(topic, "shop.view.g1").alias("exact"), P.topic_matches(topic, "shop.*.g1").alias("one"),
        P.topic_matches(topic, "shop.*").alias("short"), P.topic_matches(topic, "shop.**").alias("deep"),
        P.topic_matches(topic, "shop.view.**").alias("branch"), P.topic_matches(topic, "nothing.**", loose_double_star=True).alias("loose"))


@family.add("f14_document_filters", """
select lang, count(*) as n from documents where (lang in ('fr', 'en') or source in ('src3')) and source <> 'src0' group by 1""")
def _(spark, sf):
    from millrace.operators.search import document_filter

    docs = Tables(spark, sf).documents.select(
        "doc_id", "lang", F.array("lang", "source").alias("tags"), F.col("lang").alias("section"),
        F.create_map(F.lit("source"), "source").alias("metadata"))
    found = document_filter(docs, tags=["fr", "en", "src3"], metadata={"unknown_field": "x"})
    dropped = document_filter(docs, metadata={"source": "src0"})
    return found.join(dropped, "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("n"))


@family.add("f15_ignore_rules", """
with p as (select source || '/' || lang || '/d' || doc_id || case when n_chars > 2000 then '.log' else '.txt' end as path, source, lang, n_chars from documents)
select path, (case when lang = 'de' then true when source = 'src4' then true
  when n_chars > 2000 then not (source = 'src1') else false end) as ignored from p""")
def _(spark, sf):
    rules = ignore.read_rules(["# logs", "*.log", "", "!src1/*.log", "de/", "/src4"])
    path = F.concat("source", F.lit("/"), "lang", F.lit("/d"), "doc_id", F.when(F.col("n_chars") > 2000, ".log").otherwise(".txt"))
    return Tables(spark, sf).documents.select(path.alias("path")).withColumn("ignored", ignore.ignored(F.col("path"), rules))


@family.add("f16_row_level_security", """
select c_mktsegment, count(*) as n from customer where (c_nationkey < 10 or c_nationkey > 20) and c_acctbal > 0 and c_mktsegment <> 'BUILDING' group by 1""")
def _(spark, sf):
    tables = frozenset({"customer"})
    rules = [
        P.RowRule("c_nationkey < 10", tables, frozenset({"west"}), "area"),
        P.RowRule("c_nationkey > 20", tables, frozenset({"east"}), "area"),
        P.RowRule("c_acctbal > 0", tables, frozenset({"west"})),
        P.RowRule("c_mktsegment <> 'BUILDING'", tables, frozenset({"admin"}), base=True),
        P.RowRule("c_custkey < 0", tables, frozenset({"other"})),
        P.RowRule("c_custkey < 0", tables, frozenset({"west"}), base=True),
    ]
    return P.secured(Tables(spark, sf).customer, "customer", ["west", "east"], rules).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@family.add("f18_alert_condition", """
select 'errors' as alert, count(*)::double as value, count(*) > 100 as fires from events where event_type = 'error'
union all select 'big', max(o_totalprice), max(o_totalprice) <= 1000 from orders
union all select 'any', max(l_tax), true from lineitem""")
def _(spark, sf):
    t = Tables(spark, sf)
    parts = [
        ("errors", P.alert_state(t.events.where("event_type = 'error'"), F.count("*").cast("double"), ">", 100)),
        ("big", P.alert_state(t.orders, F.max("o_totalprice"), "<=", 1000)),
        ("any", P.alert_state(t.lineitem, F.max("l_tax"), "not null")),
    ]
    named = [df.select(F.lit(name).alias("alert"), "value", "fires") for name, df in parts]
    return reduce(lambda a, b: a.unionByName(b), named)


@family.add("f19_history_page", """
select event_id, user_id, event_type from events where user_id > 50 and event_type in ('view', 'click') order by event_id desc limit 40 offset 80""")
def _(spark, sf):
    filters = [{"col": "user_id", "opr": "gt", "value": 50}, {"col": "event_type", "opr": "in", "value": ["view", "click"]}]
    return S.history_page(Tables(spark, sf).events.select("event_id", "user_id", "event_type"), filters, 2, 40, ["-event_id"])


@family.add("a04_kv_aggregate", ENTRIES + """
select 'COUNT' as op, count(v)::double as result from e union all select 'SUM', round(coalesce(sum(v), 0), 4) from e
union all select 'AVG', round(avg(v), 6) from e union all select 'MIN', min(v) from e union all select 'MAX', max(v) from e
union all select 'SUM_EMPTY', 0 union all select 'AVG_EMPTY', null union all select 'AVG_NO_VALUE', 0
union all select 'DISTINCT', v from (select distinct v from e where v > 300)""")
def _(spark, sf):
    e = entries(Tables(spark, sf))
    v = F.col("value")
    # One pass for the five whole-table figures.
    whole = e.select("category", "value")
    parts = [kv.kv_aggregate(whole, v, op).select(F.lit(op).alias("op"), F.round("result", 6 if op == "AVG" else 4).alias("result"))
             for op in ("COUNT", "SUM", "AVG", "MIN", "MAX")]
    none = whole.where(F.col("category") == "missing")
    parts.append(kv.kv_aggregate(none, v, "SUM").select(F.lit("SUM_EMPTY").alias("op"), "result"))
    parts.append(kv.kv_aggregate(none, v, "AVG").select(F.lit("AVG_EMPTY").alias("op"), "result"))
    parts.append(kv.kv_aggregate(whole.where(F.col("category") == "signup"), v, "AVG").select(F.lit("AVG_NO_VALUE").alias("op"), "result"))
    parts.append(kv.kv_aggregate(whole.where("value > 300"), v, "DISTINCT").select(F.lit("DISTINCT").alias("op"), "result"))
    return reduce(lambda a, b: a.unionByName(b), parts)


@family.add("t03_kv_sort_page", ENTRIES + """
select key, k from e where category = 'purchase' order by k desc, event_id limit 30 offset 10""")
def _(spark, sf):
    k = F.try_variant_get("doc", "$.a.k", "bigint")
    rows = kv.kv_filter(entries(Tables(spark, sf)), category="purchase").withColumn("k", k)
    return kv.kv_page(rows, [F.col("k").desc_nulls_last(), F.col("event_id").asc()], 10, 30).select("key", "k")
