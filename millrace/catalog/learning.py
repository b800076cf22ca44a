from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from millrace.catalog import Family, Tables
from millrace.operators import forecast, models as M
from millrace.operators.condensed import Condensed
from millrace.plans.spread import dealt
from millrace.session import cut

family = Family()
NUMERIC = ["l_quantity", "l_discount", "l_tax"]


def line_rows(t):
    return t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), *NUMERIC, "l_returnflag", "l_linestatus",
        F.col("l_extendedprice").alias("price"), (F.col("l_returnflag") == "R").cast("double").alias("returned"))


@family.add("m01_preprocess")
def _(spark, sf):
    rows = M.fill_modes(line_rows(Tables(spark, sf)), ["l_returnflag"])
    ready = Pipeline(stages=M.preprocess(NUMERIC, ["l_returnflag", "l_linestatus"])).fit(rows).transform(rows)
    return ready.select("id", vector_to_array("features").alias("features"))


@family.add("m02_stratified_split", """
with h as (select c_custkey, c_mktsegment, row_number() over (partition by c_mktsegment order by substr(md5(c_custkey::varchar), 1, 15)) as rn, count(*) over (partition by c_mktsegment) as n from customer)
select c_custkey, rn <= floor(n * 0.2) as is_test from h""")
def _(spark, sf):
    return M.stratified_split(Tables(spark, sf).customer, "c_custkey", "c_mktsegment").select("c_custkey", "is_test")


@family.add("m03_candidates")
def _(spark, sf):
    rows = line_rows(Tables(spark, sf)).withColumnRenamed("price", "label")
    rows = cut(dealt(rows), "rows")
    ready = cut(Pipeline(stages=M.preprocess(NUMERIC)).fit(rows).transform(rows).select("features", "label"), "prepared")
    found, condensed = [], Condensed(ready)
    for c in M.candidates("regression"):
        scored = condensed.fit(c.estimator).transform(ready)
        found.append(M.regression_metrics(scored).select(F.lit(c.name).alias("model"), "*"))
    return reduce(DataFrame.unionByName, found)


@family.add("m04_model_selection")
def _(spark, sf):
    rows = M.stratified_split(line_rows(Tables(spark, sf)).withColumnRenamed("price", "label"), "id")
    pool = M.candidates("regression")
    board, _, _ = M.select_model(rows.where(~F.col("is_test")), rows.where("is_test"), M.preprocess(NUMERIC, ["l_returnflag"]), pool, "regression")
    return board


GUESS = "case when l_quantity > 30 then 'A' when l_quantity > 15 then 'N' else 'R' end"


@family.add("m05_metrics", f"""
with g as (select l_returnflag as y, {GUESS} as p, l_extendedprice as v, l_quantity * 1500 as w, l_discount as s, (l_returnflag = 'R')::int as b from lineitem),
c as (select cls, count(*) filter (y = cls) as a, count(*) filter (p = cls) as q, count(*) filter (y = cls and p = cls) as h from g, (values ('A'), ('N'), ('R')) t(cls) group by 1),
r as (select s, b, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 as rk from g)
select round(sqrt(avg((v - w) * (v - w))), 4) as rmse, round(avg(abs(v - w)), 4) as mae, round(1 - sum((v - w) * (v - w)) / (var_pop(v) * count(*)), 6) as r2,
  (select round(sum(h) / sum(a), 6) from c) as accuracy, (select round(sum(2.0 * h / (a + q) * a) / sum(a), 6) from c) as f1,
  (select round((sum(rk) filter (b = 1) - count(*) filter (b = 1) * (count(*) filter (b = 1) + 1) / 2.0) / (count(*) filter (b = 1)::double * count(*) filter (b = 0)), 6)::double from r) as auc from g""")
def _(spark, sf):
    lines = Tables(spark, sf).lineitem
    guess = F.when(F.col("l_quantity") > 30, "A").when(F.col("l_quantity") > 15, "N").otherwise("R")
    g = lines.select(F.col("l_returnflag").alias("y"), guess.alias("p"), F.col("l_extendedprice").alias("v"), (F.col("l_quantity") * 1500).alias("w"),
                     F.col("l_discount").alias("s"), (F.col("l_returnflag") == "R").cast("int").alias("b"))
    reg, cls, auc = M.regression_metrics(g, "v", "w"), M.classification_metrics(g, "y", "p"), M.roc_auc(g, "b", "s")
    return reg.select(
        F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"),
        F.round(cls.select("accuracy").scalar(), 6).alias("accuracy"), F.round(cls.select("f1").scalar(), 6).alias("f1"), F.round(auc.scalar(), 6).alias("auc"))


@family.add("m05_one_vs_rest", """
with g as (select l_returnflag as y, unnest(['A', 'N', 'R']) as cls, unnest([l_quantity, l_discount, l_tax]) as s from lineitem),
r as (select cls, y = cls as b, rank() over (partition by cls order by s) + (count(*) over (partition by cls, s) - 1) / 2.0 as rk from g),
a as (select cls, (sum(rk) filter (b) - count(*) filter (b) * (count(*) filter (b) + 1) / 2.0) / (count(*) filter (b)::double * count(*) filter (not b)) as auc from r group by cls)
select round(avg(auc), 6)::double as auc from a""")
def _(spark, sf):
    scores = {"A": "l_quantity", "N": "l_discount", "R": "l_tax"}
    return M.one_vs_rest_auc(Tables(spark, sf).lineitem, "l_returnflag", scores).select(F.round("auc", 6).alias("auc"))


@family.add("m06_feature_importance")
def _(spark, sf):
    rows = line_rows(Tables(spark, sf)).withColumnRenamed("price", "label")
    ready = Pipeline(stages=M.preprocess(NUMERIC, ["l_returnflag"])).fit(rows).transform(rows)
    tree = next(c for c in M.candidates("regression") if c.name == "decision_tree").estimator.fit(ready)
    return M.feature_importance(tree, M.feature_names(ready), spark)


@family.add("m06_permutation_importance")
def _(spark, sf):
    rows = line_rows(Tables(spark, sf)).withColumnRenamed("price", "label")
    fitted = Pipeline(stages=[*M.preprocess(NUMERIC), next(c for c in M.candidates("regression") if c.name == "ridge").estimator]).fit(rows)
    return M.permutation_importance(rows, fitted, ["l_quantity", "l_tax"], "regression", "id")


@family.add("m07_explain_linear", """
with m as (select avg(l_quantity) as q, avg(l_discount) as d from lineitem), s as (select l_orderkey * 10 + l_linenumber as id, l_quantity, l_discount from lineitem)
select id, 'l_quantity' as feature, round(1500.5 * (l_quantity - q), 4) + 0.0 as contribution from s, m union all select id, 'l_discount', round(-20.25 * (l_discount - d), 6) + 0.0 from s, m""")
def _(spark, sf):
    out = M.explain_linear(line_rows(Tables(spark, sf)), {"l_quantity": 1500.5, "l_discount": -20.25}, "id")
    rounded = F.when(F.col("feature") == "l_quantity", F.round("contribution", 4)).otherwise(F.round("contribution", 6))
    return out.withColumn("contribution", rounded + F.lit(0.0))


@family.add("m08_predict")
def _(spark, sf):
    rows = line_rows(Tables(spark, sf)).withColumnRenamed("returned", "label")
    model = Pipeline(stages=[*M.preprocess(NUMERIC, ["l_linestatus"]), M.candidates("classification")[0].estimator]).fit(rows)
    out = M.predict(model, rows, [*NUMERIC, "l_linestatus"], labels=["kept", "returned"], probabilities=True)
    return out.select("id", "prediction", "predicted_label", F.round(F.col("probabilities")[1], 6).alias("p_returned"))


REGISTRY = """
reg as (select o_orderkey as model_id, 'm' || (o_custkey % 50) as model_name, o_orderdate as created_at, row_number() over (partition by o_custkey % 50 order by o_orderdate, o_orderkey) as version, o_orderstatus as verdict from orders),
ch as (select model_name, version, case when verdict = 'F' then 'production' else 'staging' end as stage, version as seq from reg where verdict <> 'O'),
hold as (select model_name, stage, arg_max(version, seq) as version from ch group by 1, 2),
st as (select reg.*, case when hold.version is not null then ch.stage when ch.version is not null then 'archived' else 'none' end as stage from reg left join ch using (model_name, version)
  left join hold on hold.model_name = reg.model_name and hold.version = reg.version and hold.stage = ch.stage)
"""


def registry_tables(t):
    models = t.orders.select(F.col("o_orderkey").alias("model_id"), F.concat(F.lit("m"), F.col("o_custkey") % 50).alias("model_name"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("verdict"))
    reg = M.register_versions(models)
    changes = reg.where("verdict <> 'O'").select("model_name", "version", F.when(F.col("verdict") == "F", "production").otherwise("staging").alias("stage"), F.col("version").alias("at"))
    return reg, changes


@family.add("m09_registry_promote", f"with {REGISTRY} select model_id, model_name, version, stage from st")
def _(spark, sf):
    return M.promote(*registry_tables(Tables(spark, sf))).select("model_id", "model_name", "version", "stage")


@family.add("m09_resolve_stage", f"with {REGISTRY} select model_name, max(version) as version from st where stage = 'production' group by 1")
def _(spark, sf):
    return M.resolve_stage(M.promote(*registry_tables(Tables(spark, sf))), "production").select("model_name", "version")


@family.add("m10_experiment_runs", """
with f as (select user_id as run_id, arg_max(value, event_id) filter (event_type = 'view') as loss, arg_max(value, event_id) filter (event_type = 'click') as lr, max(event_id) as seq from events where event_type in ('view', 'click', 'error') group by 1)
select run_id, coalesce(loss, -1) as loss, coalesce(lr, -1) as lr, seq from f order by seq desc, run_id limit 40""")
def _(spark, sf):
    e = Tables(spark, sf).events.where("event_type in ('view', 'click', 'error')")
    kind = F.when(F.col("event_type") == "view", "metric").when(F.col("event_type") == "click", "param").otherwise("tag")
    key = F.when(F.col("event_type") == "view", "loss").when(F.col("event_type") == "click", "lr").otherwise("owner")
    events = e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("at"), kind.alias("kind"), key.alias("key"), F.col("value"))
    out = M.run_list(M.fold_runs(events), limit=40)
    pick = lambda m, k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(-1.0))
    return out.select("run_id", pick(F.col("metrics"), "loss").alias("loss"), pick(F.col("params"), "lr").alias("lr"), F.col("at").alias("seq"))


@family.add("m11_model_list", """
with reg as (select l_orderkey as model_id, 'r' || max(l_suppkey) as owner from lineitem group by 1)
select o_orderkey as model_id, coalesce(case when o_orderstatus = 'O' then 'own' end, owner) as owner from orders left join reg on model_id = o_orderkey
where o_orderpriority = '2-HIGH' and o_orderstatus <> 'P' order by o_orderdate desc, o_orderkey limit 20 offset 20""")
def _(spark, sf):
    t = Tables(spark, sf)
    reg = t.lineitem.groupBy(F.col("l_orderkey").alias("model_id")).agg(F.concat(F.lit("r"), F.max("l_suppkey")).alias("owner"))
    meta = t.orders.select(F.col("o_orderkey").alias("model_id"), F.when(F.col("o_orderstatus") == "O", "own").alias("owner"), F.array("o_orderpriority").alias("tags"),
                           F.when(F.col("o_orderstatus") != "P", "regression").otherwise("classification").alias("problem"), F.col("o_orderdate").alias("created_at"))
    return M.model_list(meta, reg, "2-HIGH", "regression", 2, 20).select("model_id", "owner")


@family.add("m12_seasonal_naive", """
with d as (select c_mktsegment as series, date_trunc('day', o_orderdate) as day, sum(o_totalprice) as y from orders join customer on o_custkey = c_custkey group by 1, 2),
r as (select *, row_number() over (partition by series order by day desc) as back, max(day) over (partition by series) as last from d)
select series, h::int as step, strftime(last + to_days(h::int), '%Y-%m-%d') as at, round(y, 2) as forecast from r join range(1, 11) t(h) on back = 7 - (h - 1) % 7 where back <= 7""")
def _(spark, sf):
    t = Tables(spark, sf)
    daily = (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_mktsegment").alias("series"), F.date_trunc("day", "o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("y"))
    )
    out = forecast.seasonal_naive(daily, ["series"], "day", "y", 10, 7, "D")
    return out.select("series", "step", F.date_format("at", "yyyy-MM-dd").alias("at"), F.round("forecast", 2).alias("forecast"))


@family.add("m13_network")
def _(spark, sf):
    e = Tables(spark, sf).embeddings.where("label IS NOT NULL")
    sizes = e.agg(F.max(F.size("embedding")).alias("w"), F.max("label").alias("k")).first()
    rows = M.stratified_split(e, "vec_id", "label").select("vec_id", array_to_vector("embedding").alias("features"), F.col("label").cast("double").alias("label"), "is_test")
    net = M.network([sizes.w, 128, 64, 32, sizes.k + 1], iterations=15)
    scored = net.fit(rows.where(~F.col("is_test"))).transform(rows.where("is_test"))
    return M.classification_metrics(scored)
