from pyspark.sql import functions as F

from millrace.catalog import Family, Tables
from millrace.functions import lookups
from millrace.operators import features, joins as J

family = Family()


@family.add("j01_enriched_left", """
with reg as (select l_partkey as p_partkey, 'reg' || min(l_suppkey) as p_name, count(*) as uses from lineitem where l_quantity > 49 group by 1)
select p.p_partkey, coalesce(case when p_size > 25 then p.p_name end, reg.p_name) as p_name, reg.uses::double as uses from part p left join reg using (p_partkey)""")
def _(spark, sf):
    t = Tables(spark, sf)
    reg = t.lineitem.where("l_quantity > 49").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.concat(F.lit("reg"), F.min("l_suppkey")).alias("p_name"), F.count("*").alias("uses"))
    meta = t.part.select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_name")).alias("p_name"))
    return J.enriched(meta, reg, ["p_partkey"], ["p_name", "uses"]).withColumn("uses", F.col("uses").cast("double"))


@family.add("j02_semi", """
select c_mktsegment, count(*) as n from customer where c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT' and o_totalprice > 300000) group by 1""")
def _(spark, sf):
    t = Tables(spark, sf)
    links = t.orders.where("o_orderpriority = '1-URGENT' and o_totalprice > 300000").withColumnRenamed("o_custkey", "c_custkey")
    return J.having(t.customer, links, ["c_custkey"]).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@family.add("j03_with_counts", """
select c_custkey, c_name, (select count(*) from orders where o_custkey = c_custkey and o_orderstatus = 'P') as activities from customer""")
def _(spark, sf):
    t = Tables(spark, sf)
    detail = t.orders.where("o_orderstatus = 'P'").withColumnRenamed("o_custkey", "c_custkey")
    return J.with_counts(t.customer.select("c_custkey", "c_name"), detail, ["c_custkey"], "activities")


def reference_tables(t):
    """References are words of the page URLs; targets are order clerks of documents by language."""
    targets = t.documents.select(F.concat(
        F.when(F.col("lang") == "en", F.lit("fig:")).when(F.col("lang") == "fr", F.lit("SEC:")).otherwise(F.lit("")), "source").alias("target_id")).distinct()
    refs = t.events.select(F.concat(
        F.when(F.col("event_type") == "view", F.lit("sec:")).when(F.col("event_type") == "error", F.lit("SRC")).otherwise(F.lit("src")),
        F.when(F.col("event_type") == "view", F.lit("src")).otherwise(F.lit("")), F.col("user_id") % 30).alias("ref"))
    return refs, targets


REFS = """
with targets as (select distinct case lang when 'en' then 'fig:' when 'fr' then 'SEC:' else '' end || source as target from documents),
refs as (select distinct case event_type when 'view' then 'sec:src' when 'error' then 'SRC' else 'src' end || (user_id % 30) as ref from events),
tries as (select ref, 0 as r, ref as k, false as ci from refs union all select ref, i, p || ref, false from refs,
  (values (1,'fig:'),(2,'table:'),(3,'eq:'),(4,'sec:'),(5,'code:')) v(i, p) union all select ref, 99, lower(ref), true from refs),
hits as (select ref, arg_min(m.target, tries.r) as resolved, min(tries.r) as rank from tries
  join (select target, target as k, false as ci from targets union all select min(target), lower(target), true from targets group by lower(target)) m
  on m.k = tries.k and m.ci = tries.ci group by 1)
"""


@family.add("j04_resolve_references", REFS + "select refs.ref, resolved, coalesce(rank, -1) as rank from refs left join hits using (ref)")
def _(spark, sf):
    refs, targets = reference_tables(Tables(spark, sf))
    return J.resolve_references(refs, targets).withColumn("rank", F.coalesce("rank", F.lit(-1)))


@family.add("j05_unresolved", REFS + "select refs.ref from refs where ref not in (select ref from hits)")
def _(spark, sf):
    return J.unresolved_references(*reference_tables(Tables(spark, sf)))


FILE_NAMES = (
    "a.py", "b.tsx", "Makefile", "c.md", "d.csv", "tests/foo.py", "lib/Gemfile", "requirements.txt", ".eslintrc", "CMakeLists.txt", "x/Cargo.toml",
    "e.spec.js", "stats.R", "setup.cfg", "noending",
)


@family.add("j06_extension_lookup", f"""
with names as (select * from unnest({list(FILE_NAMES)}) with ordinality t(name, i)),
f as (select n_chars, coalesce(name, 'e.unknown') as name from documents left join names on source = 'src' || (i - 1)),
k as (select n_chars, lower(name) as path, lower(regexp_extract(name, '([^/]*)$', 1)) as base, lower(regexp_extract(name, '[^/][.]([^./]+)$', 1)) as ext from f)
select case when base = 'makefile' then 'makefile' when base = 'cmakelists.txt' then 'cmake' when base in ('gemfile', 'rakefile', 'podfile', 'vagrantfile') then 'ruby'
    when base in ('.eslintrc', '.prettierrc', 'package.json', 'tsconfig.json') then 'json' when base in ('cargo.toml', 'pyproject.toml', 'pipfile') then 'toml'
    when base = 'requirements.txt' then 'requirements' when ext in ('py', 'pyi', 'pyx') then 'python' when ext in ('ts', 'tsx') then 'typescript'
    when ext in ('js', 'mjs', 'cjs', 'jsx') then 'javascript' when ext = 'md' then 'markdown' when ext = 'r' then 'r' else 'unknown' end as language,
  case when contains(path, 'test') or contains(path, 'spec') then 'test' when base in ('makefile', 'cmakelists.txt', 'cargo.toml', 'package.json', 'setup.py', 'setup.cfg') then 'build'
    when ext in ('py', 'tsx', 'ts', 'js') then 'source' when ext in ('md', 'txt') then 'documentation' when ext = 'csv' then 'data' when ext in ('toml', 'cfg') then 'config' else 'other' end as category,
  count(*) as files, sum(n_chars)::bigint as bytes from k group by 1, 2""")
def _(spark, sf):
    name = F.lit("e.unknown")
    for i, n in enumerate(FILE_NAMES):
        name = F.when(F.col("source") == f"src{i}", n).otherwise(name)
    files = Tables(spark, sf).documents.select("n_chars", name.alias("name"))
    tagged = files.select("n_chars", lookups.language_of(F.col("name")).alias("language"), lookups.category_of(F.col("name")).alias("category"))
    return tagged.groupBy("language", "category").agg(F.count("*").alias("files"), F.sum("n_chars").alias("bytes"))


@family.add("j07_indicators_in_text", """
select framework, count(*) as n from (select doc_id, unnest(list_filter(['license', 'email', 'latin'], lambda x: case x
  when 'license' then contains(lower(text), 'license') or contains(lower(text), 'copyright')
  when 'email' then contains(lower(text), '@') else contains(lower(text), 'the ') end)) as framework from documents) group by 1""")
def _(spark, sf):
    rules = {"license": ["License", "copyright"], "email": ["@"], "latin": ["the "]}
    found = Tables(spark, sf).documents.select(F.explode(lookups.indicators_in(F.col("text"), rules)).alias("framework"))
    return found.groupBy("framework").agg(F.count("*").alias("n"))


@family.add("j09_event_subscriptions", """
with t as (select event_id, 'shop.' || event_type || case when value > 60 then '.g0' when value > 20 then '.g1' else '.a.b.c.d.g2' end as topic from events),
s as (select * from (values ('a', '^shop\\.view\\.g1$'), ('b', '^shop\\.[^.]+\\.a\\.[^.]+\\.c\\.d\\.g2$'), ('c', '^shop\\..+$'), ('d', '^[^.]+\\.click\\.[^.]+$'), ('e', '^other\\..+$'),
  ('f', '^.+\\.g2$'), ('g', '^shop\\.[^.]+\\..+$'), ('h', '^shop\\..+\\.[^.]+\\.g2$'), ('i', '^.+\\.a\\..+\\.d\\..+$')) v(subscriber, rx))
select topic, subscriber, count(*) as n from t join s on regexp_matches(topic, rx) group by 1, 2""")
def _(spark, sf):
    t = Tables(spark, sf)
    events = t.events.select("event_id", F.concat_ws(".", F.lit("shop"), "event_type", F.when(F.col("value") > 60, "g0").when(F.col("value") > 20, "g1").otherwise("a.b.c.d.g2")).alias("topic"))
    subs = spark.createDataFrame(
        [("a", "shop.view.g1"), ("b", "shop.*.a.*.c.d.g2"), ("c", "shop.**"), ("d", "*.click.*"), ("e", "other.**"), ("f", "**.g2"), ("g", "shop.*.**"),
         ("h", "shop.**.*.g2"), ("i", "**.a.**.d.**")], "subscriber string, pattern string")
    return J.match_subscriptions(events, subs, "topic", "pattern").groupBy("topic", "subscriber").agg(F.count("*").alias("n"))


@family.add("j11_value_mapping", """
with m as (select c_mktsegment as level, avg(c_acctbal) as enc from customer where c_mktsegment <> 'MACHINERY' group by 1)
select c_custkey, round(coalesce(enc, -1.0), 6)::double as enc from customer left join m on c_mktsegment = level""")
def _(spark, sf):
    c = Tables(spark, sf).customer
    table = c.where("c_mktsegment <> 'MACHINERY'").groupBy(F.col("c_mktsegment").alias("level")).agg(F.avg("c_acctbal").alias("enc"))
    return features.map_encode(c, table, "c_mktsegment", "enc", F.lit(-1.0), "enc").select("c_custkey", F.round("enc", 6).alias("enc"))


UPSERT = """
with old as (select c_custkey as key, c_acctbal as v from customer where c_nationkey < 15),
new as (select o_custkey as key, round(sum(o_totalprice), 2) as v from orders where o_orderdate >= timestamp '1998-01-01' group by 1)
"""


def upsert_sides(t):
    old = t.customer.where("c_nationkey < 15").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("v"))
    new = t.orders.where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).groupBy(F.col("o_custkey").alias("key")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("v"))
    return old, new


@family.add("j12_upsert_match", UPSERT + """
select coalesce(new.key, old.key) as key, coalesce(new.v, old.v) as v,
  case when old.key is null then 'created' when new.key is not null then 'updated' else 'kept' end as status from old full join new on old.key = new.key""")
def _(spark, sf):
    old, new = upsert_sides(Tables(spark, sf))
    return J.merge_rows(old, new, ["key"])


@family.add("j13_compare_corpora", """
select 'docs' as metric, (select count(*) from documents where lang = 'en')::double as "left", (select count(*) from documents where lang = 'fr')::double as "right",
  (select count(*) from documents where lang = 'fr')::double - (select count(*) from documents where lang = 'en') as difference
union all select 'chars', (select sum(n_chars) from documents where lang = 'en'), (select sum(n_chars) from documents where lang = 'fr'),
  (select sum(n_chars) from documents where lang = 'fr')::double - (select sum(n_chars) from documents where lang = 'en')
union all select 'sources', (select count(distinct source) from documents where lang = 'en'), (select count(distinct source) from documents where lang = 'fr'),
  (select count(distinct source) from documents where lang = 'fr')::double - (select count(distinct source) from documents where lang = 'en')""")
def _(spark, sf):
    d = Tables(spark, sf).documents
    metrics = {"docs": F.count(F.lit(1)), "chars": F.sum("n_chars"), "sources": F.count_distinct("source")}
    return J.compare_metrics(d.where("lang = 'en'"), d.where("lang = 'fr'"), metrics)


@family.add("j14_bibliography", """
select p_partkey as key, p_brand as first_author, 1900 + p_size as year from part where p_partkey in (select l_partkey from lineitem where l_returnflag = 'R' and l_quantity > 48)""")
def _(spark, sf):
    t = Tables(spark, sf)
    entries = t.part.select(F.col("p_partkey").alias("key"), F.array("p_brand", "p_type").alias("authors"), (F.col("p_size") + 1900).alias("year"))
    cited = t.lineitem.where("l_returnflag = 'R' and l_quantity > 48").select(F.col("l_partkey").alias("key"))
    return J.bibliography(entries, cited).select("key", "first_author", "year")


@family.add("j15_range_join", """
with p as (select event_id, user_id, epoch_us(ts) as t from events where event_type = 'purchase'),
v as (select user_id, epoch_us(ts) as t, value from events where event_type = 'view')
select p.event_id, count(v.t) as views, round(coalesce(sum(v.value), 0), 4) as spent from p left join v
  on v.user_id = p.user_id and v.t between p.t - 86400000000 and p.t group by 1""")
def _(spark, sf):
    e = Tables(spark, sf).events.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).select("event_id", "user_id", "event_type", "t", "value")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "t")
    right = e.where("event_type = 'view'").select("user_id", "t", "value")
    out = J.trailing_join(left, right, ["user_id"], "t", 86400, {"views": F.lit(1).cast("bigint"), "spent": F.col("value")})
    return out.select("event_id", "views", (F.round("spent", 4) + F.lit(0.0)).alias("spent"))


@family.add("j15_as_of_join", """
with p as (select event_id, user_id, ts from events where event_type = 'purchase'),
v as (select user_id, ts, value from events where event_type = 'view')
select p.event_id, v.value as asof_value from p asof left join v on p.user_id = v.user_id and p.ts >= v.ts""")
def _(spark, sf):
    e = Tables(spark, sf).events.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "t")
    right = e.where("event_type = 'view'").select("user_id", "t", "value")
    return J.as_of_join(left, right, ["user_id"], "t", ["value"]).select("event_id", "asof_value")
