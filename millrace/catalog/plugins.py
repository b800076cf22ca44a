from pyspark.sql import functions as F

from millrace.catalog import Family, Tables
from millrace.catalog.corpus import markdown_pages
from millrace.operators import aggregates as A, steps as U
from millrace.operators.quality import split_valid

family = Family()


@family.add("u01_row_transformer", "select event_id, upper(event_type) as kind, value * 2 as twice from events where event_type <> 'signup'")
def _(spark, sf):
    def change(row):
        return None if row["event_type"] == "signup" else {"event_id": row["event_id"], "kind": row["event_type"].upper(), "twice": row["value"] * 2}

    return U.map_rows(Tables(spark, sf).events.select("event_id", "event_type", "value"), change, "event_id bigint, kind string, twice double")


@family.add("u02_batch_validator", "select event_type, count(*) as n from events where value > 20 and length(event_type) > 4 group by 1")
def _(spark, sf):
    ok = U.batch_validator(lambda f: (f["value"] > 20) & (f["event_type"].str.len() > 4), "value", "event_type")
    good, _bad = split_valid(Tables(spark, sf).events, ok)
    return good.groupBy("event_type").agg(F.count("*").alias("n"))


STEPS = [
    {"type": "transform", "input": "kind", "operation": "uppercase", "store_as": "shown"},
    {"type": "condition", "condition": "{{value}} > {{limit}}", "then": [{"type": "set", "name": "label", "value": "{{shown}} over {{limit}}"}],
     "else": [{"type": "set", "name": "label", "value": "small"}]},
    {"type": "loop", "items": "tags", "as": "tag", "actions": [{"type": "set", "name": "line", "value": "{{tag}}:{{label}}"}]},
]


@family.add("u03_steps", """
select event_id, tag || ':' || case when value > 50 then upper(event_type) || ' over 50' else 'small' end as line from (select *, unnest([event_type, 'u' || (user_id % 3)]) as tag from events)""")
def _(spark, sf):
    e = Tables(spark, sf).events.select("event_id", F.col("event_type").alias("kind"), "value", F.array("event_type", F.concat(F.lit("u"), F.col("user_id") % 3)).alias("tags"))
    return U.run_steps(e, U.fill_spec(STEPS, {"limit": 50})).select("event_id", "line")


@family.add("u04_templates", "select event_id, case when value > 200 then upper(event_type) || ' over 200' else 'small' end as label from events")
def _(spark, sf):
    e = Tables(spark, sf).events.select("event_id", F.col("event_type").alias("kind"), "value")
    return U.run_steps(e, U.fill_spec(STEPS[:2], {"limit": 200})).select("event_id", "label")


@family.add("u05_text_plugins", """
select conv_id, turn, md5(replace(text, 'the', '🔥') || '!') as digest from conversations""")
def _(spark, sf):
    plugins = U.standard_plugins().register("loud", lambda c: F.concat(c, F.lit("!")), 950)
    text = plugins.apply(F.replace("text", F.lit("the"), F.lit(":fire:")), ["emoji", "loud"])
    return Tables(spark, sf).conversations.select("conv_id", "turn", F.md5(text).alias("digest"))


@family.add("u06_role_marks", """
select doc_id, 0 as position, 'ref' as role, 'fig-' || doc_id || 'b' as ref from documents union all select doc_id, 1, 'cite', 'k' || doc_id from documents
union all select doc_id, 2, 'term', 'the plan <Plan>' from documents union all select doc_id, 3, 'term', 'ghost' from documents""")
def _(spark, sf):
    return U.role_marks(markdown_pages(Tables(spark, sf))).select("doc_id", "position", "role", "ref")


@family.add("u07_saved_query", "select o_orderkey, o_totalprice, true as is_limited from orders where o_totalprice > 200000 and o_orderstatus = 'O' order by o_totalprice desc, o_orderkey limit 25")
def _(spark, sf):
    saved = U.SavedQuery("big", "select o_orderkey, o_totalprice from {orders} where o_totalprice > :low and o_orderstatus = :state order by o_totalprice desc, o_orderkey", {"low": 1, "state": "O"}, 25)
    return U.run_saved(spark, saved, {"low": 200000}, orders=Tables(spark, sf).orders)


@family.add("u08_custom_aggregates", """
with o as (select user_id as k, value as v, row_number() over (partition by user_id order by value) as rn, count(*) over (partition by user_id) as n from events),
s as (select k, median(v) as med, max(v) filter (rn = least(floor(n * 0.95) + 1, n)) as p95 from o group by 1)
select k as user_id, p95, (select round(median(abs(o.v - s.med)), 6) from o where o.k = s.k) as mad from s""")
def _(spark, sf):
    out = A.stats_bundle(Tables(spark, sf).events, ["user_id"], "value")
    return out.select("user_id", "p95", F.round("mad", 6).alias("mad"))
