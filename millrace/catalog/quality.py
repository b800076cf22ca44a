from pyspark.sql import functions as F

from millrace.catalog import Family, Tables
from millrace.operators import quality as Q, sets

family = Family()


def column_profile_sql(table, numeric, other):
    parts = []
    for c in numeric:
        parts.append(f"select '{c}' as \"column\", count(*) as rows, count(*) - count({c}) as null_count, count(distinct {c}) as unique_count, round(min({c})::double, 6) as min, "
                     f"round(max({c})::double, 6) as max, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std, round(median({c})::double, 6) as median, '' as mode from {table}")
    for c in other:
        parts.append(f"select '{c}', count(*), count(*) - count({c}), count(distinct {c}), null, null, null, null, null, (select {c} from {table} where {c} is not null group by 1 order by count(*) desc, 1 limit 1) from {table}")
    return " union all ".join(parts)


@family.add("q01_profile", column_profile_sql("part", ["p_partkey", "p_size", "p_retailprice"], ["p_name", "p_brand", "p_type"]))
def _(spark, sf):
    out = Q.profile(Tables(spark, sf).part)
    return out.select("column", "rows", "null_count", "unique_count", *[F.round(c, 6).alias(c) for c in ("min", "max", "mean", "std", "median")], F.coalesce("mode", F.lit("")).alias("mode"))


@family.add("a14_column_profile", column_profile_sql("customer", ["c_custkey", "c_nationkey", "c_acctbal"], ["c_name", "c_mktsegment"]))
def _(spark, sf):
    out = Q.profile(Tables(spark, sf).customer)
    return out.select("column", "rows", "null_count", "unique_count", *[F.round(c, 6).alias(c) for c in ("min", "max", "mean", "std", "median")], F.coalesce("mode", F.lit("")).alias("mode"))


@family.add("q01_samples", """
select 'o_orderstatus' as "column", row_number() over (order by o_orderkey)::int as position, o_orderstatus as value from (select * from orders order by o_orderkey limit 5)
union all select 'o_totalprice', row_number() over (order by o_orderkey)::int, o_totalprice::varchar from (select * from orders order by o_orderkey limit 5)""")
def _(spark, sf):
    return Q.column_samples(Tables(spark, sf).orders, ["o_orderstatus", "o_totalprice"], "o_orderkey")


@family.add("q01_target_top", "select p_brand as value, count(*) as n from part group by 1 order by n desc, value limit 20")
def _(spark, sf):
    return Q.top_values(Tables(spark, sf).part, "p_brand")


SAMPLE = "(select event_id, case when event_type <> 'error' then value end as value, case when event_type = 'view' then '' else event_type end as kind from events order by event_id limit 1000)"


@family.add("q02_profile_sample", f"""
select 'value' as "column", count(*) as rows, count(*) - count(value) as null_count, count(distinct value) as unique_count, round(avg(value), 6) as mean from {SAMPLE}
union all select 'kind', count(*), count(*) filter (kind = ''), count(distinct nullif(kind, '')), null from {SAMPLE}""")
def _(spark, sf):
    e = Tables(spark, sf).events.select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
                                        F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("kind"))
    first = e.orderBy("event_id").limit(1000)
    out = Q.profile(first, ["value", "kind"], empty_is_missing=True)
    return out.select("column", "rows", "null_count", "unique_count", F.round("mean", 6).alias("mean"))


@family.add("q03_completeness", """
select count(*) * 3 as cells, count(*) filter (event_type = 'signup') + count(*) filter (event_type = 'error') as missing,
  round(1 - (count(*) filter (event_type = 'signup') + count(*) filter (event_type = 'error')) / (count(*) * 3.0), 6)::double as completeness, false as low from events""")
def _(spark, sf):
    e = Tables(spark, sf).events.select(
        "event_id", F.when(F.col("event_type") != "signup", F.col("value")).alias("value"),
        F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("kind"))
    return Q.completeness(e).withColumn("completeness", F.round("completeness", 6))


def json_cells(t):
    kind = F.col("event_type")
    mixed = F.when(kind == "view", F.concat(F.lit('"'), "value", F.lit('"'))).when(kind == "click", "true").when(kind == "error", "null").otherwise(F.col("value").cast("string"))
    return t.events.select("event_id", mixed.alias("mixed"), "props")


@family.add("q04_type_consistency", """
select 'mixed' as "column", 'numeric' as majority, count(*) filter (event_type <> 'error') as present, count(*) filter (event_type in ('signup', 'purchase')) as matching,
  round(count(*) filter (event_type in ('signup', 'purchase')) / count(*) filter (event_type <> 'error'), 6) as consistency, true as low from events
union all select 'props', 'object', count(*), count(*), 1.0, false from events""")
def _(spark, sf):
    return Q.type_consistency(json_cells(Tables(spark, sf)), ["mixed", "props"]).withColumn("consistency", F.round("consistency", 6))


@family.add("q05_sigma_outliers", """
with s as (select avg(value) as m, stddev_pop(value) as s from events), o as (select value from events, s where abs(value - m) > 3 * s)
select 'value' as "column", (select count(*) from events) as values, (select count(*) from o) as outliers,
  round((select count(*) from o) * 100.0 / (select count(*) from events), 6)::double as outlier_pct, (select string_agg(value::varchar, ',' order by value desc) from (select distinct value from o order by value desc limit 3)) as examples
union all select 'user_id', count(*), 0, 0.0, '' from events""")
def _(spark, sf):
    out = Q.sigma_outliers(Tables(spark, sf).events, ["value", "user_id"])
    return out.select("column", "values", "outliers", F.round("outlier_pct", 6).alias("outlier_pct"),
                      F.coalesce(F.array_join(F.col("examples").cast("array<string>"), ","), F.lit("")).alias("examples"))


@family.add("q06_quality_score", """
with c as (select 1 - count(*) filter (event_type = 'error') / (count(*) * 3.0) as completeness,
  (count(*) filter (event_type in ('signup', 'purchase')) / count(*) filter (event_type <> 'error') + 1.0) / 2 as consistency from events)
select round((completeness + consistency) / 2, 6)::double as score, (completeness + consistency) / 2 >= 0.7 as valid, 'check outliers' as suggestions from c""")
def _(spark, sf):
    t = Tables(spark, sf)
    cells = json_cells(t)
    rows = t.events.select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"), "props")
    score = Q.quality_score(
        Q.completeness(rows), Q.type_consistency(cells, ["mixed", "props"]), sets.duplicate_count(t.events.select("event_id", "user_id")),
        Q.profile(t.events.select("event_id", "event_type")), Q.sigma_outliers(t.events, ["value"]))
    return score.select(F.round("score", 6).alias("score"), "valid", F.array_join("suggestions", ";").alias("suggestions"))


@family.add("q07_validate_rows", """
with e as (select user_id, case when event_type <> 'signup' then event_type end as kind, 'x' as fixed from events)
select 'nulls' as "check", 'kind' as "column", count(*) filter (kind is null)::double as value from e union all select 'null_target', 'kind', count(*) filter (kind is null) from e
union all select 'quasi_constant', 'fixed', 1.0 from (select 1) union all select 'duplicates', '*', (select sum(n - 1) from (select count(*) as n from e group by user_id, kind, fixed))""")
def _(spark, sf):
    e = Tables(spark, sf).events.select("user_id", F.when(F.col("event_type") != "signup", F.col("event_type")).alias("kind"), F.lit("x").alias("fixed"))
    return Q.validate_rows(e, "kind")


@family.add("q08_bounds", """
select 'min_rows' as "check", count(*) >= 10 as ok, count(*) as detail from customer union all select 'max_rows', count(*) <= 100000, count(*) from customer
union all select 'column:c_name', true, 0 union all select 'column:missing', false, 0""")
def _(spark, sf):
    return Q.check_bounds(Tables(spark, sf).customer, ["c_name", "missing"])


@family.add("q09_problem", """
select 'label' as target, count(distinct label) as unique_values, case when count(distinct label) <= 20 then 'classification' else 'regression' end as problem from embeddings
union all select 'o_totalprice', count(distinct o_totalprice), 'regression' from orders""")
def _(spark, sf):
    t = Tables(spark, sf)
    target = Q.infer_target(t.embeddings.columns)
    a = Q.infer_problem(t.embeddings, target).select(F.lit(target).alias("target"), "unique_values", "problem")
    return a.unionByName(Q.infer_problem(t.orders, "o_totalprice").select(F.lit("o_totalprice").alias("target"), "unique_values", "problem"))


@family.add("q10_split_valid", """
select case when value > 5 and event_type <> 'signup' then 'valid' else 'rejected' end as side, count(*) as n from events group by 1""")
def _(spark, sf):
    e = Tables(spark, sf).events.withColumn("kind", F.when(F.col("event_type") != "signup", F.col("event_type")))
    good, bad = Q.split_valid(e, Q.has_content(["kind"]) & (F.col("value") > 5))
    count = lambda d, s: d.agg(F.count("*").alias("n")).select(F.lit(s).alias("side"), "n")
    return count(good, "valid").unionByName(count(bad.where("error IS NOT NULL"), "rejected"))


@family.add("q11_record_rules", """
select event_id, case event_type when 'view' then 'Missing required field: actions' when 'click' then 'Invalid trigger: click' when 'error' then 'actions must be an array' when 'signup' then 'Record is not an object' else '' end as errors from events""")
def _(spark, sf):
    kind = F.col("event_type")
    record = (
        F.when(kind == "view", '{"name":"a","trigger":"event"}').when(kind == "click", '{"name":"a","trigger":"click","actions":[]}')
        .when(kind == "error", '{"name":"a","trigger":"manual","actions":{"x":1}}').when(kind == "signup", "not json")
        .otherwise('{"name":"a","trigger":"webhook","actions":[1]}'))
    errors = Q.record_errors(["name", "trigger", "actions"], {"trigger": ["event", "schedule", "manual", "webhook"]}, {"actions": "array"})
    return Tables(spark, sf).events.select("event_id", record.alias("record")).select("event_id", F.array_join(errors, ";").alias("errors"))


@family.add("q12_metric_gate", """
with m as (select 'accuracy' as metric, round(count(*) filter (event_type <> 'error') / count(*), 6) as value from events union all select 'r2', 0.25 union all select 'other', 0.0)
select metric, value::double as value, case metric when 'accuracy' then value >= 0.7 when 'r2' then false else true end as passed from m""")
def _(spark, sf):
    acc = Tables(spark, sf).events.agg(F.round(F.count_if(F.col("event_type") != "error") / F.count("*"), 6).alias("v"))
    metrics = acc.select(F.explode(F.array(F.struct(F.lit("accuracy").alias("metric"), F.col("v").alias("value")), F.struct(F.lit("r2").alias("metric"), F.lit(0.25).alias("value")),
                                           F.struct(F.lit("other").alias("metric"), F.lit(0.0).alias("value")))).alias("e")).select("e.*")
    return Q.metric_gate(metrics).select("metric", "value", "passed")
