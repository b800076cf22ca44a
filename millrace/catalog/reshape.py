from pyspark.sql import functions as F

from millrace.plans.runs import numbered
from millrace.catalog import Family, Tables
from millrace.operators import features, reshape as R

family = Family()
K = "cast(regexp_extract(props, '([0-9]+)', 1) as bigint)"


@family.add("p03_extract_rows", f"""
with e as (select event_type, {K} as k from events)
select event_type, sum(case event_type when 'click' then 2 else 1 end)::bigint as rows,
  sum(case event_type when 'click' then 2 * k else k end)::bigint as total from e group by 1""")
def _(spark, sf):
    p, kind = F.col("props"), F.col("event_type")
    text = (
        F.when(kind == "view", F.concat(F.lit('{"total": 1, "rows": ['), p, F.lit("]}")))
        .when(kind == "click", F.concat(F.lit('{"items": ['), p, F.lit(","), p, F.lit(', 5], "data": "none"}')))
        .when(kind == "error", F.concat(F.lit("["), p, F.lit("]")))
        .otherwise(p)
    )
    rows = Tables(spark, sf).events.select("event_type", F.explode(R.extract_rows(F.try_parse_json(text))).alias("r"))
    return rows.groupBy("event_type").agg(F.count("*").alias("rows"), F.sum(F.try_variant_get("r", "$.k", "bigint")).alias("total"))


@family.add("p04_flatten", f"""
with e as (select event_id, event_type, user_id, {K} as k from events)
select path, count(*) as n, sum(v)::bigint as total from (
  select 'a.b.k' as path, k as v from e union all select 'c.0', 5 from e union all select 'c.1.d', user_id from e) group by 1""")
def _(spark, sf):
    text = F.concat(F.lit('{"a":{"b":'), "props", F.lit('},"c":[5,{"d":'), "user_id", F.lit('}],"e":{},"f":[]}'))
    docs = Tables(spark, sf).events.select("event_id", F.parse_json(text).alias("doc"))
    flat = R.flatten_variant(docs, "doc", ["event_id"], max_depth=5)
    return flat.groupBy("path").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("bigint")).alias("total"))


@family.add("p04_flatten_columns", """
select o_orderkey as "order.key", o_totalprice as "order.money.total", o_orderstatus as "tags.0", o_orderpriority as "tags.1" from orders""")
def _(spark, sf):
    nested = Tables(spark, sf).orders.select(
        F.struct(F.col("o_orderkey").alias("key"), F.struct(F.col("o_totalprice").alias("total")).alias("money")).alias("order"),
        F.array("o_orderstatus", "o_orderpriority").alias("tags"))
    return R.flatten_columns(nested, list_sizes={"tags": 2})


@family.add("p05_unflatten", """
select c_custkey as id, (c_nationkey + 0.5)::double as deep, c_mktsegment as second from customer""")
def _(spark, sf):
    flat = Tables(spark, sf).customer.select(
        F.col("c_custkey").alias("user.id"), (F.col("c_nationkey") + F.lit(0.5)).alias("user.geo.code"),
        F.col("c_name").alias("tags.0"), F.col("c_mktsegment").alias("tags.1"))
    return R.unflatten_columns(flat).select("user.id", F.col("user.geo.code").alias("deep"), F.col("tags")[1].alias("second"))


@family.add("p06_filter_keys", "select p_partkey, p_size, p_retailprice from part")
def _(spark, sf):
    nested = Tables(spark, sf).part.select(
        "p_partkey", "p_name", F.struct("p_size", "p_brand", F.struct("p_retailprice", "p_type").alias("p_inner")).alias("p_box"))
    kept = R.filter_keys(nested, exclude=["p_name"], include_patterns=["p_"], exclude_patterns=["p_b(?!ox)", "p_t"])
    return kept.select("p_partkey", "p_box.p_size", "p_box.p_inner.p_retailprice")


@family.add("p07_rename_keys", "select s_suppkey as id, s_name as label, s_acctbal as balance from supplier")
def _(spark, sf):
    nested = Tables(spark, sf).supplier.select(
        "s_suppkey", F.struct("s_name").alias("inner"), F.array(F.struct("s_acctbal")).alias("list"))
    out = R.rename_keys(nested, {"s_suppkey": "id", "s_name": "label", "s_acctbal": "balance"})
    return out.select("id", "inner.label", F.col("list")[0]["balance"].alias("balance"))


@family.add("p08_defaults", """
select c_custkey, case when c_acctbal < 0 then null else c_mktsegment end as segment, 'standard' as tier, 'en' as lang,
  case when c_nationkey < 5 then 'eu' else 'x' || c_nationkey end as zone from customer""")
def _(spark, sf):
    c = Tables(spark, sf).customer
    row = F.create_map(F.lit("segment"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")))
    done = R.with_defaults(row, {"segment": "none", "tier": "standard"})
    own = F.when(F.col("c_nationkey") >= 5, F.create_map(F.lit("zone"), F.concat(F.lit("x"), "c_nationkey"))).otherwise(F.create_map().cast("map<string,string>"))
    deep = R.with_deep_defaults(F.create_map(F.lit("locale"), own), {"locale": {"lang": "en", "zone": "eu"}})
    return c.select("c_custkey", done.alias("m"), deep["locale"].alias("d")).select(
        "c_custkey", F.col("m.segment").alias("segment"), F.col("m.tier").alias("tier"), F.col("d.lang").alias("lang"), F.col("d.zone").alias("zone"))


@family.add("p09_payload_edits", """
select n_nationkey as nid, n_name as title, 'v2' as version, n_regionkey * 10 as score from nation""")
def _(spark, sf):
    base = F.struct("n_nationkey", "n_name", F.struct("n_regionkey").alias("meta"))
    done = (
        R.Payload(base).set("meta.score", F.col("n_regionkey") * 10).remove("meta.n_regionkey")
        .merge(title=F.col("n_name")).wrap("body").envelope("payload", version=F.lit("v2")).col
    )
    return Tables(spark, sf).nation.select(done.alias("p")).select(
        F.col("p.payload.body.n_nationkey").alias("nid"), F.col("p.payload.body.title").alias("title"),
        F.col("p.version").alias("version"), F.col("p.payload.body.meta.score").alias("score"))


@family.add("p10_chain", """
select r_name as region, count(*) as n from nation join region on n_regionkey = r_regionkey where n_nationkey <> 3 group by 1""")
def _(spark, sf):
    t = Tables(spark, sf)
    return R.chain(
        t.nation, lambda d: d.where("n_nationkey <> 3"),
        lambda d: d.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")),
        lambda d: R.rename_keys(d, {"r_name": "region"}), lambda d: d.groupBy("region").agg(F.count("*").alias("n")))


@family.add("p11_item_counts", """
select o_orderkey, (3 + (case when o_orderstatus = 'F' then 1 else 0 end))::int as item_count from orders""")
def _(spark, sf):
    o = Tables(spark, sf).orders.select(
        "o_orderkey", F.array("o_orderstatus", "o_orderpriority").alias("tags"),
        F.create_map(F.lit("total"), "o_totalprice").alias("metadata"),
        F.when(F.col("o_orderstatus") == "F", F.array("o_custkey")).alias("logs"))
    return R.item_counts(o, ["tags", "metadata", "logs"]).select("o_orderkey", "item_count")


@family.add("p12_redact", """
select page_id, case when contains(url, '?') then split_part(url, '?', 1) || '?<redacted>' else url end as url,
  '<redacted>' as token, lang from (select page_id, url, regexp_extract(html, 'lang="([a-z]+)"', 1) as lang from pages)""")
def _(spark, sf):
    pages = Tables(spark, sf).pages.select(
        "page_id", R.redact_url_query(F.col("url")).alias("url"),
        F.struct(F.md5("url").alias("Token"), F.create_map(F.lit("lang"), F.regexp_extract("html", 'lang="([a-z]+)"', 1), F.lit("PassWord"), F.lit("x")).alias("m")).alias("auth"))
    out = R.redact_fields(pages, ["token", "password"])
    return out.select("page_id", "url", F.col("auth.Token").alias("token"), F.col("auth.m.lang").alias("lang"))


@family.add("p13_generated_projection", """
select l_orderkey, l_linenumber, (l_returnflag = 'A')::int as "l_returnflag_A", (l_returnflag = 'N')::int as "l_returnflag_N",
  (l_returnflag = 'R')::int as "l_returnflag_R", round(l_quantity * l_discount, 6) as "l_quantity__x__l_discount", cast(l_quantity as bigint) as l_quantity_int from lineitem""")
def _(spark, sf):
    lines = Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_discount")
    hot = features.one_hot(lines, "l_returnflag", ["A", "N", "R"])
    both = features.interactions(hot, ["l_quantity", "l_discount"], 1)
    both = both.withColumn("l_quantity_int", F.col("l_quantity").cast("bigint"))
    both = both.withColumn("l_quantity__x__l_discount", F.round("l_quantity__x__l_discount", 6))
    return both.drop("l_returnflag", "l_quantity", "l_discount")


@family.add("p15_tree_preorder", """
select 'c' || c_custkey as id, '0.' || r_regionkey || '.' || n_nationkey || '.' || c_custkey as path
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
union all select 'n' || n_nationkey, '0.' || n_regionkey || '.' || n_nationkey from nation
union all select 'r' || r_regionkey, '0.' || r_regionkey from region union all select 'root', '0'""")
def _(spark, sf):
    t = Tables(spark, sf)
    node = lambda p, k: F.concat(F.lit(p), F.col(k))
    parts = [
        t.customer.select(node("c", "c_custkey").alias("id"), node("n", "c_nationkey").alias("parent"), F.col("c_custkey").alias("seq")),
        t.nation.select(node("n", "n_nationkey").alias("id"), node("r", "n_regionkey").alias("parent"), F.col("n_nationkey").cast("bigint").alias("seq")),
        t.region.select(node("r", "r_regionkey").alias("id"), F.lit("root").alias("parent"), F.col("r_regionkey").cast("bigint").alias("seq")),
        t.region.agg(F.lit("root").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("bigint").alias("seq")),
    ]
    tree = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return R.preorder_paths(tree).orderBy("path").select("id", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"))


@family.add("p15_default_listing", """
with f as (select lang || '/' || source || '/' || case when n_chars < 60 then 'README' else 'd' || lpad(doc_id::varchar, 8, '0') end || '.md' as path, doc_id from documents),
o as (select min(path) as p from f where path like '%/README.md')
select row_number() over (order by coalesce(path = p, false) desc, path, doc_id) as pos, path, coalesce(path = p, false) as is_opening
from f left join o on true""")
def _(spark, sf):
    stem = F.when(F.col("n_chars") < 60, F.lit("README")).otherwise(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 8, "0")))
    files = Tables(spark, sf).documents.select(F.concat("lang", F.lit("/"), "source", F.lit("/"), stem, F.lit(".md")).alias("path"), "doc_id")
    listed = R.default_listing(files, ties=["doc_id"])
    folder = F.struct(~F.col("is_opening"), F.substring("path", 1, 8))
    return numbered(listed, [], [F.desc("is_opening"), "path", "doc_id"], folder, "pos").select("pos", "path", "is_opening")


@family.add("k09_event_envelope", """
select event_id, '{"specversion":"1.0","type":"shop.' || event_type || '","source":"web","id":"' || event_id || '","time":"' ||
  strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","datacontenttype":"application/json","data":{"user_id":' || user_id || '}}' as body from events""")
def _(spark, sf):
    return Tables(spark, sf).events.select("event_id", R.event_envelope(
        F.concat(F.lit("shop."), "event_type"), F.lit("web"), F.col("event_id").cast("string"), F.col("ts"), F.struct("user_id")).alias("body"))


@family.add("p06_map_keys", """
select doc_id, array_to_string(list_sort(list_filter([lang, source, 'n'], lambda k: k <> 'en' and not regexp_matches(k, '^(src1|fr)'))), ',') as keys from documents""")
def _(spark, sf):
    pairs = F.create_map("lang", F.lit(1), "source", F.lit(2), F.lit("n"), F.lit(3))
    kept = R.filter_map_keys(pairs, ["en"], ["src1", "fr"])
    return Tables(spark, sf).documents.select("doc_id", F.array_join(F.sort_array(F.map_keys(kept)), ",").alias("keys"))
