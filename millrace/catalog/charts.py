from pyspark.sql import Window as W, functions as F

from millrace.catalog import Family, Tables
from millrace.functions.predicates import native_filter
from millrace.operators import chart as C
from millrace.operators.chart import ChartQuery

family = Family()


@family.add("p01_chart_segment_month", """
select c_mktsegment, strftime(o_orderdate, '%Y-%m') as month, count(*) as orders,
       round(sum(o_totalprice), 2) as revenue, round(avg(o_totalprice), 4) as avg_price
from orders join customer on o_custkey = c_custkey
where o_orderstatus in ('F', 'O') and o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1998-01-01'
group by all order by c_mktsegment, month limit 1000""")
def _(spark, sf):
    t = Tables(spark, sf)
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return (
        ChartQuery()
        .calculated("month", "date_format(o_orderdate, 'yyyy-MM')")
        .where("o_orderstatus", "IN", ["F", "O"])
        .time("o_orderdate", "1996-01-01 : 1998-01-01")
        .group_by("c_mktsegment", "month")
        .count(label="orders")
        .metric("round(sum(o_totalprice), 2)", "revenue")
        .metric("round(avg(o_totalprice), 4)", "avg_price")
        .order_by("c_mktsegment").order_by("month")
        .apply(joined)
    )


@family.add("p01_select_columns", "select n_nationkey, n_name, n_regionkey from nation")
def _(spark, sf):
    return ChartQuery().columns("n_nationkey", "n_name").columns("n_regionkey").limit(0).apply(Tables(spark, sf).nation)


@family.add("p02_calculated_column", """
select l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) as net,
       count(case when l_quantity > 25 then 1 end) as big_lines
from lineitem group by 1""")
def _(spark, sf):
    return (
        ChartQuery()
        .calculated("net_price", "l_extendedprice * (1 - l_discount)")
        .calculated("is_big", "l_quantity > 25")
        .group_by("l_returnflag")
        .metric("round(sum(net_price), 2)", "net").metric("count_if(is_big)", "big_lines")
        .limit(0).apply(Tables(spark, sf).lineitem)
    )


@family.add("p14_columns_by_role", """
select 'groupable' as role, n_name as a, cast(n_regionkey as varchar) as b from nation
union all select 'temporal', strftime(max(o_orderdate), '%Y-%m-%d'), strftime(min(o_orderdate), '%Y-%m-%d') from orders""")
def _(spark, sf):
    t = Tables(spark, sf)
    names = [c for c in C.columns_by_role(t.nation, "groupable") if c != "n_nationkey"]
    time_col = C.columns_by_role(t.orders, "temporal")[0]
    grouped = t.nation.select(F.lit("groupable").alias("role"), F.col(names[0]).alias("a"), F.col(names[1]).cast("string").alias("b"))
    span = t.orders.agg(F.date_format(F.max(time_col), "yyyy-MM-dd").alias("a"), F.date_format(F.min(time_col), "yyyy-MM-dd").alias("b"))
    return grouped.unionByName(span.select(F.lit("temporal").alias("role"), "a", "b"))


@family.add("f01_chart_filters", """
select p_brand, count(*) as parts, min(p_retailprice) as cheapest from part
where p_size >= 5 and p_size <> 11 and p_type like '%E%' and p_brand not in ('Brand#11') and p_name is not null
  and p_retailprice between 900 and 2000
group by 1""")
def _(spark, sf):
    return (
        ChartQuery().where("p_size", ">=", 5).where("p_size", "!=", 11).where("p_type", "LIKE", "%E%")
        .where("p_brand", "NOT IN", ["Brand#11"]).where("p_name", "is not null")
        .where("p_retailprice", "between", (900, 2000))
        .group_by("p_brand").count(label="parts").metric("min(p_retailprice)", "cheapest")
        .limit(0).apply(Tables(spark, sf).part)
    )


@family.add("f09_time_range", """
select event_type, count(*) as n from events
where ts >= timestamp '2024-01-31 00:00:00' - interval 7 day and ts < timestamp '2024-01-31 00:00:00' group by 1""")
def _(spark, sf):
    return (
        ChartQuery().time("ts").last(7, "days").group_by("event_type").count(label="n").limit(0)
        .apply(Tables(spark, sf).events, as_of="2024-01-31 00:00:00")
    )


@family.add("f17_native_filter", """
select 'orders' as frame, count(*) as n from orders where o_orderstatus = 'F'
union all select 'lines', count(*) from lineitem where l_linestatus = 'F'
union all select 'events', count(*) from events""")
def _(spark, sf):
    t = Tables(spark, sf)
    frames = native_filter(
        {"orders": t.orders, "lines": t.lineitem, "events": t.events},
        {"orders": "o_orderstatus", "lines": "l_linestatus"}, None, default="F",
    )
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("frame"), "n") for name, df in frames.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@family.add("a01_metrics", """
select l_linestatus, count(*) as "count_*", round(sum(l_quantity), 2) as sum_l_quantity,
       round(avg(l_discount), 6) as disc from lineitem group by 1""")
def _(spark, sf):
    out = ChartQuery().group_by("l_linestatus").count().sum("l_quantity").avg("l_discount", "disc").limit(0).apply(Tables(spark, sf).lineitem)
    return out.withColumns({"sum_l_quantity": F.round("sum_l_quantity", 2), "disc": F.round("disc", 6)})


@family.add("a02_named_metric", """
select l_returnflag, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) as charge,
       count(distinct l_suppkey) as suppliers from lineitem group by 1""")
def _(spark, sf):
    registry = {
        "charge": "round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2)",
        "suppliers": "count(distinct l_suppkey)",
    }
    q = ChartQuery(named_metrics=registry).group_by("l_returnflag").metric("charge").metric("suppliers")
    return q.limit(0).apply(Tables(spark, sf).lineitem)


@family.add("a03_group_by", """
select n_name, c_mktsegment, count(*) as customers, round(avg(c_acctbal), 4) as balance
from customer join nation on c_nationkey = n_nationkey group by 1, 2""")
def _(spark, sf):
    t = Tables(spark, sf)
    base = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return (
        ChartQuery().group_by("n_name", "c_mktsegment").count(label="customers")
        .metric("round(avg(c_acctbal), 4)", "balance").limit(0).apply(base)
    )


@family.add("a19_pivot", """
select o_orderpriority, sum(case when o_orderstatus = 'F' then 1 else 0 end)::bigint as F,
  sum(case when o_orderstatus = 'O' then 1 else 0 end)::bigint as O, sum(case when o_orderstatus = 'P' then 1 else 0 end)::bigint as P
from orders group by 1""")
def _(spark, sf):
    return C.pivot_frame(Tables(spark, sf).orders, ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], F.count("o_orderkey")).fillna(0)


@family.add("a19_big_number", "select count(*) as orders, round(sum(o_totalprice), 2) as revenue from orders")
def _(spark, sf):
    return ChartQuery().count(label="orders").metric("round(sum(o_totalprice), 2)", "revenue").apply(Tables(spark, sf).orders)


@family.add("a19_box_plot", """
select l_returnflag, count(*) as rows, min(l_extendedprice) as low, round(quantile_cont(l_extendedprice, 0.25), 6) as q1,
  round(quantile_cont(l_extendedprice, 0.5), 6) as mid, round(quantile_cont(l_extendedprice, 0.75), 6) as q3, max(l_extendedprice) as high
from lineitem group by 1""")
def _(spark, sf):
    out = C.box_plot_frame(Tables(spark, sf).lineitem, ["l_returnflag"], "l_extendedprice")
    return out.withColumns({c: F.round(c, 6) for c in ("q1", "mid", "q3")})


@family.add("a19_heatmap", """
select cast(extract(isodow from ts) - 1 as integer) as x, cast(extract(hour from ts) as integer) as y, count(*) as value
from events group by 1, 2""")
def _(spark, sf):
    return C.heatmap_frame(Tables(spark, sf).events, F.weekday("ts"), F.hour("ts"), F.count("*"))


@family.add("a19_funnel", """
with u as (select user_id, max((event_type = 'view')::int) s0, max((event_type = 'click')::int) s1, max((event_type = 'purchase')::int) s2 from events group by 1)
select 1 as position, 'view' as step, count(*) filter (s0 = 1) as actors from u
union all select 2, 'click', count(*) filter (s0 = 1 and s1 = 1) from u
union all select 3, 'purchase', count(*) filter (s0 = 1 and s1 = 1 and s2 = 1) from u""")
def _(spark, sf):
    return C.funnel_frame(Tables(spark, sf).events, "user_id", "event_type", ["view", "click", "purchase"])


@family.add("a19_treemap", """
select r_name, n_name, round(sum(c_acctbal), 2) as value, (2 - (grouping(r_name) + grouping(n_name)))::int as depth
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)""")
def _(spark, sf):
    t = Tables(spark, sf)
    base = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return C.treemap_frame(base, ["r_name", "n_name"], F.round(F.sum("c_acctbal"), 2))


@family.add("a19_sankey", """
select s.n_name as source, c.n_name as target, count(*) as value
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
join nation s on s_nationkey = s.n_nationkey join nation c on c_nationkey = c.n_nationkey group by 1, 2""")
def _(spark, sf):
    t = Tables(spark, sf)
    # Reduce to (supplier, customer) counts before touching the dimension tables.
    pairs = (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("l_suppkey", "o_custkey").agg(F.count("*").alias("n"))
    )
    sn = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("src"))
    cn = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("dst"))
    base = pairs.join(sn, F.col("l_suppkey") == F.col("s_suppkey")).join(cn, F.col("o_custkey") == F.col("c_custkey"))
    return C.sankey_frame(base, F.col("src"), F.col("dst"), F.sum("n"))


@family.add("a20_cube", """
select l_returnflag, l_linestatus, grouping(l_returnflag)::int as g1, grouping(l_linestatus)::int as g2, count(*) as n,
  round(sum(l_quantity), 2) as qty from lineitem group by cube (l_returnflag, l_linestatus)""")
def _(spark, sf):
    return Tables(spark, sf).lineitem.cube("l_returnflag", "l_linestatus").agg(
        F.grouping("l_returnflag").cast("int").alias("g1"), F.grouping("l_linestatus").cast("int").alias("g2"),
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"),
    )


@family.add("a21_time_grain", """
select strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') as week, count(*) as n, round(sum(o_totalprice), 2) as revenue from orders group by 1""")
def _(spark, sf):
    out = ChartQuery().time("o_orderdate", grain="week").count(label="n").metric("round(sum(o_totalprice), 2)", "revenue").limit(0).apply(Tables(spark, sf).orders)
    return out.select(F.date_format("o_orderdate_week", "yyyy-MM-dd").alias("week"), "n", "revenue")


@family.add("t01_order_by", """
select row_number() over (order by c_mktsegment, c_acctbal desc, c_custkey) as pos, c_custkey, c_mktsegment, c_acctbal
from customer order by c_mktsegment, c_acctbal desc, c_custkey limit 50""")
def _(spark, sf):
    top = (
        ChartQuery().columns("c_custkey", "c_mktsegment", "c_acctbal").order_by("c_mktsegment").order_by("c_acctbal", False)
        .order_by("c_custkey").limit(50).apply(Tables(spark, sf).customer)
    )
    order = W.partitionBy(F.lit(0)).orderBy("c_mktsegment", F.desc("c_acctbal"), "c_custkey")  # 50 rows
    return top.withColumn("pos", F.row_number().over(order).cast("bigint"))


@family.add("t02_limit_offset", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25 offset 100")
def _(spark, sf):
    return (
        ChartQuery().columns("o_orderkey", "o_totalprice").order_by("o_totalprice", False).order_by("o_orderkey")
        .limit(25).offset(100).apply(Tables(spark, sf).orders)
    )


@family.add("w12_chart_windows", """
with m as (select strftime(o_orderdate, '%Y-%m') as month, o_orderpriority as priority, count(*) as n from orders group by 1, 2)
select month, priority, n, rank() over w as rnk, dense_rank() over w as drnk, ntile(4) over (partition by priority order by month) as quart,
  coalesce(lag(n) over (partition by priority order by month), 0) as prev,
  sum(n) over (partition by priority order by month rows between 2 preceding and current row)::bigint as last3
from m window w as (partition by month order by n desc)""")
def _(spark, sf):
    monthly = Tables(spark, sf).orders.groupBy(
        F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderpriority").alias("priority")
    ).agg(F.count("*").alias("n"))
    by_month, by_prio = W.partitionBy("month").orderBy(F.desc("n")), W.partitionBy("priority").orderBy("month")
    # The windows run over monthly totals, one row per month and priority.
    return monthly.select(
        "month", "priority", "n", F.rank().over(by_month).cast("bigint").alias("rnk"),
        F.dense_rank().over(by_month).cast("bigint").alias("drnk"), F.ntile(4).over(by_prio).cast("bigint").alias("quart"),
        F.coalesce(F.lag("n").over(by_prio), F.lit(0)).alias("prev"), F.sum("n").over(by_prio.rowsBetween(-2, 0)).alias("last3"),
    )
