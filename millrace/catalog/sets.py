from pyspark.sql import functions as F

from millrace.catalog import Family, Tables
from millrace.operators import sets as D

family = Family()


@family.add("d01_deduplicate", """
select arg_min(doc_id, doc_id) as doc_id, md5(text) as text_hash from documents group by md5(text), text""")
def _(spark, sf):
    d = Tables(spark, sf).documents.select("doc_id", "text")
    return D.deduplicate(d, ["text"], ["doc_id"]).select("doc_id", F.md5("text").alias("text_hash"))


@family.add("d01_duplicate_count", """
select count(*) as rows, count(distinct (lang, text)) as distinct_rows, count(*) - count(distinct (lang, text)) as duplicates from documents""")
def _(spark, sf):
    return D.duplicate_count(Tables(spark, sf).documents, ["lang", "text"])


@family.add("d02_duplicate_members", """
with h as (select sha256(text) as content_hash, source || '/' || doc_id as path from documents),
g as (select content_hash, count(*) as copies, min(path) as first_path from h group by 1 having count(*) > 1)
select h.content_hash, path, copies, first_path from h join g using (content_hash)""")
def _(spark, sf):
    files = Tables(spark, sf).documents.select("text", "n_chars", F.concat("source", F.lit("/"), "doc_id").alias("path"))
    return D.duplicate_members(files, F.col("text"), "path", F.col("n_chars"))


@family.add("d03_payload_dedup", """
select user_id, props, min(event_id) as event_id from events group by 1, 2""")
def _(spark, sf):
    # The same payload in two spellings: key order and spacing must not matter.
    e = Tables(spark, sf).events.select("user_id", "event_id", "props", F.when(
        F.col("event_type") == "view", F.concat(F.lit('{"z":1,"a":'), "props", F.lit("}"))).otherwise(F.concat(F.lit('{ "a" : '), "props", F.lit(', "z": 1 }'))).alias("payload"))
    return D.payload_dedup(e, "payload", ["user_id"], ["event_id"]).select("user_id", "props", "event_id")


@family.add("d04_ragged_union", """
select 'c' || c_custkey as id, c_acctbal as balance, c_mktsegment as segment, null as nation from customer
union all select 's' || s_suppkey, s_acctbal, null, 'n' || s_nationkey from supplier""")
def _(spark, sf):
    t = Tables(spark, sf)
    return D.ragged_union(
        t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")),
        t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")))


@family.add("d05_merge_import", """
with old as (select p_partkey as key, p_name as v from part where p_size < 30), new as (select p_partkey as key, p_brand as v from part where p_size > 20)
select coalesce(new.key, old.key) as key, case when new.key is not null then new.v else old.v end as v from old full join new on old.key = new.key""")
def _(spark, sf):
    p = Tables(spark, sf).part
    old = p.where("p_size < 30").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("v"))
    return D.merge_import(old, p.where("p_size > 20").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("v")), ["key"])


@family.add("d06_intersect_union", """
select 'both' as op, count(*) as n from (select l_partkey from lineitem where l_returnflag = 'A' intersect select l_partkey from lineitem where l_returnflag = 'R')
union all select 'either', count(*) from (select l_partkey from lineitem where l_returnflag = 'A' union select l_partkey from lineitem where l_returnflag = 'R')""")
def _(spark, sf):
    lines = Tables(spark, sf).lineitem
    a, r = (lines.where(F.col("l_returnflag") == f).select("l_partkey") for f in "AR")
    both = a.intersect(r).agg(F.count("*").alias("n")).select(F.lit("both").alias("op"), "n")
    return both.unionByName(a.union(r).distinct().agg(F.count("*").alias("n")).select(F.lit("either").alias("op"), "n"))


@family.add("d07_delete_and_prune", """
select o_orderkey from orders where o_orderdate >= timestamp '1997-01-01' and o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')""")
def _(spark, sf):
    t = Tables(spark, sf)
    kept = D.prune_older(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", F.lit("1997-01-01").cast("timestamp_ntz"))
    gone = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return D.delete_keys(kept, gone, ["o_orderkey"]).select("o_orderkey")


@family.add("d08_row_id", """
select n_nationkey, case when n_regionkey = 1 then n_name when n_regionkey = 2 then n_nationkey::varchar
  else substr(sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || '}'), 1, 16) end as id from nation""")
def _(spark, sf):
    n = Tables(spark, sf).nation.withColumns({
        "uid": F.when(F.col("n_regionkey") == 1, F.col("n_name")).when(F.col("n_regionkey") == 3, F.lit("")),
        "alt": F.when(F.col("n_regionkey") == 2, F.col("n_nationkey"))})
    return n.select("n_nationkey", D.row_id(["uid", "alt"], ["n_nationkey", "n_name"]).alias("id"))


@family.add("d09_fingerprint", "select count(*) as rows, true as same_reordered, true as differs from lineitem")
def _(spark, sf):
    # the hashes are free: the order of rows must not matter, one changed value must
    lines = Tables(spark, sf).lineitem
    one, two = D.fingerprint(lines), D.fingerprint(lines.orderBy("l_extendedprice", "l_orderkey"))
    changed = lines.withColumn("l_tax", F.when(F.col("l_orderkey") == 1, F.col("l_tax") + 1).otherwise(F.col("l_tax")))
    marks = F.struct("hash_sum", "hash_xor")
    same, other = (d.select(marks.alias("m")).scalar() for d in (two, D.fingerprint(changed)))
    return one.select("rows", (marks == same).alias("same_reordered"), (marks != other).alias("differs"))
