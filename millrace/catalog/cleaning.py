from pyspark.sql import functions as F

from millrace.catalog import Family, Tables
from millrace.operators.information import nearest_information
from millrace.operators import clean as E, features as G

family = Family()


def dirty(t):
    """Order rows as text, with gaps and words where a number should be."""
    return t.orders.select(
        F.col("o_orderkey").cast("string").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_totalprice").cast("string")).alias("price"),
        F.when(F.col("o_orderstatus") == "F", "yes").otherwise("no").alias("done"), F.col("o_orderpriority").alias("prio"),
        F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.col("o_custkey").cast("string")).alias("cust"))


@family.add("e01_infer_types", """
select 'id' as "column", 'float' as inferred union all select 'day', 'datetime' union all select 'price', 'float' union all select 'done', 'boolean'
union all select 'prio', 'categorical' union all select 'cust', case when (select count(distinct o_custkey) + 1 from orders where o_orderstatus <> 'P') / (select count(*) from orders) < 0.5 then 'categorical' else 'string' end""")
def _(spark, sf):
    return E.infer_types(dirty(Tables(spark, sf))).select("column", "inferred")


@family.add("e02_auto_convert", """
select count(*) as rows, round(sum(case when o_orderpriority <> '1-URGENT' then o_totalprice end), 2) as price, count(*) filter (o_orderstatus = 'F') as done,
  count(*) filter (o_orderstatus = 'P') as raw, sum(case when o_orderstatus <> 'P' then o_custkey end)::double as cust, strftime(max(o_orderdate), '%Y-%m-%d') as last from orders""")
def _(spark, sf):
    d = E.auto_convert(dirty(Tables(spark, sf)), {"price": "float", "done": "boolean", "cust": "float", "day": "datetime"})
    return d.agg(F.count("*").alias("rows"), F.round(F.sum("price"), 2).alias("price"), F.count_if("done").alias("done"),
                 F.count_if(F.col("cust__raw") == "n/a").alias("raw"), F.sum("cust").alias("cust"), F.date_format(F.max("day"), "yyyy-MM-dd").alias("last"))


def gaps(t):
    return t.events.select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
                           F.when(F.col("event_type") != "view", F.col("user_id")).alias("user"), F.when(F.col("event_type") != "click", F.col("event_type")).alias("kind"))


GAPS = "g as (select event_id, case when event_type <> 'error' then value end as value, case when event_type <> 'view' then user_id end as usr, case when event_type <> 'click' then event_type end as kind from events)"
SUMMARY = "count(*) as rows, round(sum(value), 4) as value, round(sum({u})::double, 4) as users, count(kind) as kinds"


def summary(df):
    return df.agg(F.count("*").alias("rows"), F.round(F.sum("value"), 4).alias("value"), F.round(F.sum("user").cast("double"), 4).alias("users"), F.count("kind").alias("kinds"))


@family.add("e03_fill_missing", f"""
with {GAPS}, o as (select value, row_number() over (order by value) - 1 as i, count(*) over () as n from g where value is not null),
u as (select usr, row_number() over (order by usr) - 1 as i, count(*) over () as n from g where usr is not null),
f as (select (select avg(value) from g) as mv, (select avg(usr) from g) as mu, (select max(value) from o where i = n // 2) as dv, (select max(usr) from u where i = n // 2) as du,
  (select value from g where value is not null group by 1 order by count(*) desc, value limit 1) as ov, (select usr from g where usr is not null group by 1 order by count(*) desc, usr limit 1) as ou)
select 'auto' as strategy, {SUMMARY.format(u='usr')} from g
union all select 'drop', {SUMMARY.format(u='usr')} from g where value is not null and usr is not null and kind is not null
union all select 'mean', count(*), round(sum(coalesce(value, mv)), 4), round(sum(coalesce(usr, mu)), 4), count(kind) from g, f
union all select 'median', count(*), round(sum(coalesce(value, dv)), 4), round(sum(coalesce(usr, du))::double, 4), count(kind) from g, f
union all select 'mode', count(*), round(sum(coalesce(value, ov)), 4), round(sum(coalesce(usr, ou))::double, 4), count(kind) from g, f
union all select 'constant', count(*), round(sum(coalesce(value, 7)), 4), round(sum(coalesce(usr, 7))::double, 4), count(*) from g
union all select 'forward_fill', count(*), round(sum(v), 4), round(sum(u)::double, 4), count(k) from (select last_value(value ignore nulls) over w as v, last_value(usr ignore nulls) over w as u, last_value(kind ignore nulls) over w as k from g window w as (order by event_id rows unbounded preceding))""")
def _(spark, sf):
    g = gaps(Tables(spark, sf))
    parts = []
    for how in ("auto", "drop", "mean", "median", "mode", "constant", "forward_fill"):
        out = E.fill_missing(g, how, ["value", "user", "kind"], constant=7, order=["event_id"], chunk=F.floor(F.col("event_id") / 1000))
        parts.append(summary(out).select(F.lit(how).alias("strategy"), "*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@family.add("e04_outliers_iqr", """
with e as (select value, row_number() over (order by value) - 1 as i, count(*) over () as n from events), eq as (select max(value) filter (i = n // 4) as q1, max(value) filter (i = 3 * n // 4) as q3 from e),
eb as (select q1 - 1.5 * (q3 - q1) as low, q3 + 1.5 * (q3 - q1) as high from eq)
select 'clip' as action, count(*) as rows, round(sum(greatest(low, least(high, value))), 3) as total from events, eb
union all select 'remove', count(*), round(sum(value), 3) from events, eb where value between low and high
union all select 'flag', count(*), round(sum(value), 3) from events, eb where not (value between low and high)""")
def _(spark, sf):
    e = Tables(spark, sf).events.select("event_id", "value")
    figures = lambda d, a: d.agg(F.count("*").alias("rows"), F.round(F.sum("value"), 3).alias("total")).select(F.lit(a).alias("action"), "*")
    out = figures(E.outliers_iqr(e, ["value"], "clip"), "clip").unionByName(figures(E.outliers_iqr(e, ["value"], "remove"), "remove"))
    return out.unionByName(figures(E.outliers_iqr(e, ["value"], "flag").where("value_outlier"), "flag"))


@family.add("e05_date_features", """
select year(o_orderdate)::int as y, quarter(o_orderdate)::int as q, (isodow(o_orderdate) - 1)::int as d, count(*) as n from orders group by 1, 2, 3""")
def _(spark, sf):
    d = E.date_features(Tables(spark, sf).orders.select("o_orderdate"), ["o_orderdate"])
    return d.groupBy(F.col("o_orderdate_year").alias("y"), F.col("o_orderdate_quarter").alias("q"), F.col("o_orderdate_dayofweek").alias("d")).agg(F.count("*").alias("n"))


@family.add("e06_named_date_features", """
select l_orderkey, l_linenumber, month(l_shipdate)::int as m, hour(l_shipdate)::int as h, (isodow(l_shipdate) >= 6)::int as weekend from lineitem""")
def _(spark, sf):
    d = G.datetime_features(Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", "l_shipdate"))
    return d.select("l_orderkey", "l_linenumber", F.col("l_shipdate__dt_month").alias("m"), F.col("l_shipdate__dt_hour").alias("h"), F.col("l_shipdate__dt_is_weekend").alias("weekend"))


@family.add("e07_label_encode", """
select p_partkey, dense_rank() over (order by p_type) - 1 as p_type_encoded, (p_brand = 'Brand#11')::int as first_brand from part""")
def _(spark, sf):
    p = E.encode(Tables(spark, sf).part.select("p_partkey", "p_type", "p_brand"), ["p_type"], "label")
    return G.one_hot(p, "p_brand", ["Brand#11"]).select("p_partkey", "p_type_encoded", F.col("p_brand_Brand#11").alias("first_brand"))


@family.add("e08_one_hot_nulls", """
select event_id, (event_type = 'click')::int as kind_click, (event_type = 'error')::int as kind_error, (event_type = 'purchase')::int as kind_purchase, (event_type = 'signup')::int as kind_signup, (event_type = 'view')::int as kind_nan from events""")
def _(spark, sf):
    e = Tables(spark, sf).events.select("event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("kind"))
    return G.one_hot(e, "kind", G.category_levels(e, "kind"), dummy_na=True, drop=True)


@family.add("e09_frequency_encode", """
select event_id, round(count(*) over (partition by kind) / count(*) over (), 9) as freq from (select event_id, case when event_type <> 'view' then event_type end as kind from events)""")
def _(spark, sf):
    e = Tables(spark, sf).events.select("event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("kind"))
    return G.frequency_encode(e, "kind", "freq").select("event_id", F.round("freq", 9).alias("freq"))


@family.add("e10_target_encode", """
with m as (select event_type from events group by 1 order by count(*) desc, event_type limit 1)
select c.c_custkey, round(avg(c_acctbal) over (partition by c_mktsegment), 6) as reg,
  round(avg((c_mktsegment = (select c_mktsegment from customer group by 1 order by count(*) desc, 1 limit 1))::int) over (partition by c_nationkey), 6) as cls from customer c""")
def _(spark, sf):
    c = Tables(spark, sf).customer
    reg = G.target_encode(c, G.target_mapping(c, "c_mktsegment", "c_acctbal", "regression"), "c_mktsegment", "reg")
    both = G.target_encode(reg, G.target_mapping(c, "c_nationkey", "c_mktsegment", "classification"), "c_nationkey", "cls")
    return both.select("c_custkey", F.round("reg", 6).alias("reg"), F.round("cls", 6).alias("cls"))


@family.add("e11_ordinal_encode", """
with f as (select event_type, dense_rank() over (order by min(event_id)) - 1 as code from events group by 1) select event_id, code from events join f using (event_type)""")
def _(spark, sf):
    return G.ordinal_encode(Tables(spark, sf).events, "event_type", "event_id", "code").select("event_id", "code")


@family.add("e12_scale", """
with s as (select avg(l_quantity) as mq, stddev_pop(l_quantity) as sq, min(l_extendedprice) as lo, max(l_extendedprice) as hi, quantile_cont(l_tax, 0.25) as q1, quantile_cont(l_tax, 0.5) as md, quantile_cont(l_tax, 0.75) as q3 from lineitem)
select l_orderkey, l_linenumber, round((l_quantity - mq) / sq, 6) + 0.0 as l_quantity, round((l_extendedprice - lo) / (hi - lo), 6) as l_extendedprice, round((l_tax - md) / (q3 - q1), 6) + 0.0 as l_tax from lineitem, s""")
def _(spark, sf):
    lines = Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax")
    out = G.scale(G.scale(G.scale(lines, ["l_quantity"], "standard"), ["l_extendedprice"], "minmax"), ["l_tax"], "robust")
    return out.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("l_quantity", "l_extendedprice", "l_tax")})


@family.add("e12_quantile_normal", """
with v as (select event_id, coalesce(value, 0) as value, count(*) over () as n from events),
m as (select event_id, value, n, rank() over (order by value) - 1 as below, count(*) over (partition by value) as same from v)
select event_id, value, round(greatest(least((below + (same - 1) / 2.0) / greatest(n - 1, 1), 1 - 1e-7), 1e-7), 6) as share from m""")
def _(spark, sf):
    # SQL has no inverse normal; the normal distribution function gives back the share that each score stands for
    scored = G.quantile_normal(Tables(spark, sf).events.select("event_id", "value"), "value", "score")
    return scored.select("event_id", "value", F.round(G.normal(F.col("score")), 6).alias("share"))


@family.add("e13_normalise", """
with s as (select min(c_acctbal) as lo, max(c_acctbal) as hi, avg(c_nationkey) as m, stddev_pop(c_nationkey) as sd from customer)
select c_custkey, round((c_acctbal - lo) / (hi - lo), 6) as c_acctbal_normalized, round((c_nationkey - m) / sd, 6) as c_nationkey_normalized, 0.0::double as fixed_normalized from customer, s""")
def _(spark, sf):
    c = Tables(spark, sf).customer.select("c_custkey", "c_acctbal", "c_nationkey", F.lit(3).alias("fixed"))
    out = E.normalise(E.normalise(c, ["c_acctbal"], "minmax"), ["c_nationkey", "fixed"], "zscore")
    return out.select("c_custkey", *[F.round(x, 6).alias(x) for x in ("c_acctbal_normalized", "c_nationkey_normalized", "fixed_normalized")])


@family.add("e14_interactions", """
select l_orderkey, l_linenumber, round(l_quantity * l_discount, 6) as l_quantity__x__l_discount, round(l_quantity * l_tax, 6) as l_quantity__x__l_tax from lineitem""")
def _(spark, sf):
    out = G.interactions(Tables(spark, sf).lineitem, ["l_quantity", "l_discount", "l_tax"], 2)
    names = ("l_quantity__x__l_discount", "l_quantity__x__l_tax")
    return out.select("l_orderkey", "l_linenumber", *[F.round(n, 6).alias(n) for n in names])


@family.add("e15_near_constant", """
select 'p_size' as "column", round(var_pop(p_size), 6) as variance from part union all select 'p_retailprice', round(var_pop(p_retailprice), 4) from part union all select 'fixed', 0.0""")
def _(spark, sf):
    p = Tables(spark, sf).part.withColumn("fixed", F.lit(2.5))
    kept = G.drop_near_constant(p, ["p_size", "p_retailprice", "fixed"])
    assert "fixed" not in kept.columns and "p_size" in kept.columns
    out = G.column_variances(p, ["p_size", "p_retailprice", "fixed"])
    return out.select("column", F.when(F.col("column") == "p_retailprice", F.round("variance", 4)).otherwise(F.round("variance", 6)).alias("variance"))


@family.add("e16_mutual_information", """
with u as (select l_returnflag as y, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) as "column",
  unnest([l_quantity::double, l_extendedprice::double, l_discount::double, l_tax::double]) as v from lineitem where l_returnflag is not null),
r as (select "column", min(v) as lo, max(v) as hi from u group by 1),
b as (select u."column", y, least(floor((v - lo) / case when hi > lo then hi - lo else 1.0 end * 16), 15) as bin from u join r on r."column" = u."column" where v is not null),
j as (select "column", bin, y, count(*)::double as n from b group by all),
k as (select *, sum(n) over (partition by "column", bin) as nx, sum(n) over (partition by "column", y) as ny, sum(n) over (partition by "column") as total from j)
select "column", round(sum(n / total * ln(n * total / (nx * ny))), 9) as mi from k group by 1""")
def _(spark, sf):
    lines = Tables(spark, sf).lineitem
    found = G.mutual_information(lines, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "l_returnflag")
    return found.withColumn("mi", F.round("mi", 9))


@family.add("e16_nearest_information", """
with c as (select row_number() over () as i, c_mktsegment as y, c_acctbal::double as x from customer where c_mktsegment is not null and c_acctbal is not null),
z as (select y, count(*) as n from c group by 1 having count(*) > 1), o as (select c.*, z.n as size from c join z using (y)),
d as (select a.i, a.x, a.size, abs(b.x - a.x) as r, row_number() over (partition by a.i order by abs(b.x - a.x)) as k from o a join o b on a.y = b.y and a.i <> b.i),
n as (select i, x, size, max(r) as r, count(*) as k from d where k <= 3 group by all),
m as (select n.i, n.size, n.k, count(*) as m from n join o b on abs(b.x - n.x) < n.r or (n.r = 0 and b.x = n.x) group by all),
h as (select j + 1 as v, -0.5772156649015329 + sum(case when j > 0 then 1.0 / j else 0 end::double) over (order by j) as psi from range((select count(*) from o)) t(j))
select 'c_acctbal' as "column", round(greatest(0.0, (select psi from h where v = (select count(*) from o)) + avg(hk.psi - hs.psi - hm.psi)), 9) as mi
from m join h hk on hk.v = m.k join h hs on hs.v = m.size join h hm on hm.v = m.m""")
def _(spark, sf):
    found = nearest_information(Tables(spark, sf).customer, ["c_acctbal"], "c_mktsegment")
    return found.withColumn("mi", F.round("mi", 9))


@family.add("e17_clean_all")
def _(spark, sf):
    return E.clean(dirty(Tables(spark, sf)), E.CleanConfig(missing="mean", normalisation="minmax", skip=("id",)))


@family.add("e17_engineer_selected", """
with s as (select l_orderkey * 10 + l_linenumber as row_id, l_extendedprice as y, l_quantity as q, l_discount as d from lineitem),
m as (select avg(q) as mq, stddev_pop(q) as sq, avg(d) as md, stddev_pop(d) as sd from s)
select row_id, round((q - mq) / sq, 6) + 0.0 as l_quantity, round((q - mq) / sq * (d - md) / sd, 6) + 0.0 as quantity_discount from s, m""")
def _(spark, sf):
    lines = Tables(spark, sf).lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), "l_extendedprice", "l_quantity", "l_discount")
    out = G.engineer(lines, "l_extendedprice", "regression", {}, ["l_quantity", "l_discount"], least_information=0.0)
    rounded = lambda c: F.round(c, 6) + F.lit(0.0)
    return out.select("row_id", rounded("l_quantity").alias("l_quantity"), rounded("l_quantity__x__l_discount").alias("quantity_discount"))


@family.add("e17_engineer_all")
def _(spark, sf):
    lines = Tables(spark, sf).lineitem.withColumn("row_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return G.engineer(lines.drop("l_partkey", "l_suppkey"), "l_extendedprice", "regression",
                      {"l_returnflag": "onehot", "l_linestatus": "target"}, ["l_quantity", "l_discount", "l_tax"])
