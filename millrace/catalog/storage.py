import uuid

from pyspark.sql import functions as F

from millrace.catalog import Family, Tables
from millrace.functions.ignore import read_rules
from millrace.operators import aggregates as A
from millrace.session import scratch_path
from millrace.sources import readers as S, writers as K

family = Family()


@family.add("s01_read_ndjson", "select event_type, count(*) as n, round(sum(value), 2) as total from events where event_type <> 'error' group by 1")
def _(spark, sf):
    # Errors are landed as broken lines, and every line is followed by a blank one.
    root = scratch_path(spark, "ndjson")
    good = F.to_json(F.struct("event_id", "event_type", "value"))
    line = F.concat(F.when(F.col("event_type") == "error", '{"event_id": 1, "event_type"').otherwise(good), F.lit("\n"))
    Tables(spark, sf).events.select(line.alias("value")).write.text(root)
    rows = S.read_ndjson(spark, root, "event_id bigint, event_type string, value double")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@family.add("s02_read_csv", "select c_custkey::varchar as id, c_mktsegment as segment, case when c_nationkey < 5 then '' else c_nationkey::varchar end as nation from customer")
def _(spark, sf):
    root = scratch_path(spark, "csv")
    c = Tables(spark, sf).customer.select(F.col("c_custkey").alias(" id "), F.col("c_mktsegment").alias("segment"), F.when(F.col("c_nationkey") >= 5, F.col("c_nationkey")).alias("nation "))
    c.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(root)
    return S.read_csv(spark, root).select("id", "segment", F.coalesce("nation", F.lit("")).alias("nation"))


@family.add("s03_read_any", """
select 'json' as kind, count(*) as n from region union all select 'ndjson', count(*) from nation union all select 'csv', count(*) from supplier""")
def _(spark, sf):
    t, root = Tables(spark, sf), scratch_path(spark, "any")
    t.region.select("r_regionkey", F.concat(F.lit("[\n"), F.to_json(F.struct(F.lit("json").alias("kind"), "r_name")), F.lit("]")).alias("value")).write.partitionBy("r_regionkey").text(f"{root}/a")
    t.nation.select(F.lit("ndjson").alias("kind"), "n_name").write.json(f"{root}/b")
    t.supplier.select(F.lit("csv").alias("kind"), "s_name").write.option("header", True).csv(f"{root}/c")
    return S.read_any(spark, root).groupBy("kind").agg(F.count("*").alias("n"))


@family.add("s04_gunzip", """
select count(*) as texts, sum(strlen(t))::bigint as bytes, max(md5(t)) as last_digest from (select text || chr(10) as t from documents where text is not null)""")
def _(spark, sf):
    root = scratch_path(spark, "gz")
    escaped = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "\\s", "").alias("value")  # a line a text, whatever the text holds
    texts = Tables(spark, sf).documents.where("text is not null").select(escaped)
    texts.write.option("compression", "gzip").option("maxRecordsPerFile", 10_000).text(root)
    bodies = S.gunzip_files(spark.read.format("binaryFile").load(root), piece=1 << 20)
    lines = bodies.select(F.explode(F.split(F.regexp_replace(F.col("body").cast("string"), r"\n\z", ""), "\n")).alias("l"))
    text = F.concat(F.decode(F.unbase64("l"), "UTF-8"), F.lit("\n"))
    return lines.select(text.alias("t")).agg(F.count("*").alias("texts"), F.sum(F.octet_length("t")).cast("bigint").alias("bytes"), F.max(F.md5(F.encode("t", "UTF-8"))).alias("last_digest"))


@family.add("s05_json_documents", "select r_regionkey::bigint as id, r_name as name, true as has_file from region")
def _(spark, sf):
    root = scratch_path(spark, "docs")
    body = F.concat(F.lit('{\n "id": '), F.col("r_regionkey").cast("string"), F.lit(',\n "name": "'), "r_name", F.lit('"\n}'))
    Tables(spark, sf).region.select(F.col("r_regionkey").alias("k"), body.alias("value")).write.partitionBy("k").text(root)
    return S.read_json_documents(spark, root, "id bigint, name string").select("id", "name", F.col("source_file").contains("k=").alias("has_file"))


@family.add("s06_paged_results", "select event_id // 1000 as page, count(*) as n, sum(event_id)::bigint as ids from events group by 1")
def _(spark, sf):
    root = scratch_path(spark, "pages")
    e = Tables(spark, sf).events
    total = e.agg(F.count("*").alias("n")).scalar()
    pages = e.groupBy(F.floor(F.col("event_id") / 1000).alias("page")).agg(F.collect_list(F.struct(F.col("event_id").alias("id"))).alias("items"))  # a page holds 1000 rows
    landed = pages.select("page", F.lit(1000).alias("size"), total.alias("total"), "items")
    landed = landed.unionByName(landed.where("page = 0").withColumn("page", F.lit(1_000_000)))  # after a gap: must not count
    landed.write.partitionBy("page").json(root)
    # The page number travels in the document itself when it comes from a service; here it is the folder.
    texts = spark.read.json(root).select("page", F.to_json(F.struct("page", "size", "total", "items")).alias("value"))
    again = scratch_path(spark, "pages")
    texts.withColumn("p", F.col("page")).select("p", "value").write.partitionBy("p").text(again)
    rows = S.read_paged_results(spark, again, "struct<id:bigint>")
    return rows.groupBy("page").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@family.add("s07_text_corpus", "select lang, count(distinct source) as files from documents where lang <> 'de' and source <> 'src3' group by 1")
def _(spark, sf):
    root = scratch_path(spark, "corpus")
    Tables(spark, sf).documents.select("lang", "source", F.col("doc_id").cast("string").alias("value")).write.option("maxRecordsPerFile", 1_000_000).partitionBy("lang", "source").text(root)
    files = S.read_text_corpus(spark, root, read_rules(["lang=de/", "source=src3"]))
    kept = files.select(F.regexp_extract("path", "lang=([a-z]+)/", 1).alias("lang"), F.regexp_extract("path", "source=([a-z0-9]+)/", 1).alias("source"))
    return kept.groupBy("lang").agg(F.count_distinct("source").alias("files"))


@family.add("s08_notebooks", "select n_nationkey as id, '# ' || n_name || chr(10) || 'text' || chr(10) || 'note ' || n_nationkey as text, n_name as headings from nation")
def _(spark, sf):
    root = scratch_path(spark, "books")
    cell = lambda kind, *parts: F.struct(F.lit(kind).alias("cell_type"), F.array(*parts).alias("source"))
    book = F.to_json(F.struct(F.array(
        cell("markdown", F.concat(F.lit("# "), "n_name", F.lit("\n")), F.lit("text")), cell("code", F.lit("x = 1\n"), F.concat(F.lit("# note "), "n_nationkey"))).alias("cells")))
    Tables(spark, sf).nation.select(F.col("n_nationkey").alias("k"), book.alias("value")).write.partitionBy("k").text(root)
    out = S.read_notebooks(spark, root)
    return out.select(F.regexp_extract("path", "k=([0-9]+)/", 1).cast("int").alias("id"), "text", F.array_join("headings", "|").alias("headings"))


@family.add("s09_tables", "select 'mr_nation' as name, count(*) as n from nation union all select 'mr_region', count(*) from region")
def _(spark, sf):
    t = Tables(spark, sf)
    K.create_table_as(t.nation, "mr_nation")
    K.create_table_as(t.region, "mr_region")
    found = S.list_tables(spark).where(F.col("name").isin("mr_nation", "mr_region")).select("name")
    counts = [S.read_table(spark, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("mr_nation", "mr_region")]
    return found.join(counts[0].unionByName(counts[1]), "name")


@family.add("s10_parquet", "select l_shipdate >= timestamp '1998-06-01' as late, count(*) as n from lineitem where l_quantity > 10 group by 1")
def _(spark, sf):
    lines = Tables(spark, sf).lineitem.where("l_quantity > 10")
    return lines.groupBy((F.col("l_shipdate") >= F.lit("1998-06-01").cast("timestamp_ntz")).alias("late")).agg(F.count("*").alias("n"))


@family.add("k01_write_ndjson", "select count(*) as n, round(sum(c_acctbal), 2) as balance from customer")
def _(spark, sf):
    root = scratch_path(spark, "out")
    K.write_ndjson(Tables(spark, sf).customer, root)
    back = S.read_ndjson(spark, root, Tables(spark, sf).customer.schema)
    return back.agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@family.add("k02_csv_frame", """
select '["' || s_name || '",null]' as a_list, '{"key":' || s_suppkey || '}' as b_doc, s_acctbal as c_num from supplier""")
def _(spark, sf):
    s = Tables(spark, sf).supplier.select(F.col("s_acctbal").alias("c_num"), F.struct(F.col("s_suppkey").alias("key")).alias("b_doc"), F.array("s_name", F.lit(None)).alias("a_list"))
    K.write_csv(s, scratch_path(spark, "csv-out"))
    return K.flat_for_csv(s)


@family.add("k03_write_run", "select count(*) as items_processed, count(*) filter (value > 5) as items_stored, count(*) filter (value <= 5) as items_failed, count(*) filter (value <= 5) as rejects from events")
def _(spark, sf):
    root = scratch_path(spark, "run")
    log = K.write_run(Tables(spark, sf).events, F.col("value") > 5, root, "r1", "2024-01-31T00:00:00")
    rejects = spark.read.parquet(f"{root}/failed").where("error IS NOT NULL").agg(F.count("*").alias("n")).scalar()
    return log.select("items_processed", "items_stored", "items_failed", rejects.alias("rejects"))


@family.add("k04_run_manifest", "select 'n_name,n_nationkey,n_regionkey' as columns, count(*) as rows, 64 as digest from nation")
def _(spark, sf):
    root = scratch_path(spark, "artifact")
    nation = Tables(spark, sf).nation
    nation.coalesce(1).write.json(root)
    return K.run_manifest(spark, root, nation).select("columns", "rows", F.length("sha256").alias("digest"))


@family.add("k07_table_as", "select n_regionkey, count(*) as n from nation group by 1")
def _(spark, sf):
    K.create_table_as(Tables(spark, sf).nation.groupBy("n_regionkey").agg(F.count("*").alias("n")), "mr_counts")
    return spark.table("mr_counts")


@family.add("k07_stored_table", "select n_regionkey, count(*) as n from nation group by 1")
def _(spark, sf):
    name = f"mr_stored_{uuid.uuid4().hex}"
    counts = Tables(spark, sf).nation.groupBy("n_regionkey").agg(F.count("*").alias("n"))
    return K.create_table_as(counts, name, temporary=False, path=scratch_path(spark, "table"))


@family.add("k08_metrics_page", """
with c as (select 'events_' || event_type as name, count(*) as n from events group by 1)
select '# TYPE ' || name || ' counter' as value from c union all select name || ' ' || n from c""")
def _(spark, sf):
    counts = Tables(spark, sf).events.groupBy(F.concat(F.lit("events_"), "event_type").alias("name")).agg(F.count("*").alias("value"))
    root = scratch_path(spark, "metrics")
    K.write_lines(A.exposition_lines(counts), ["name", "seq"], root)
    return spark.read.text(root)


@family.add("k09_fan_out", """
with b as (select event_id, '{"k":' || regexp_extract(props, '([0-9]+)', 1) || ',"user":' || user_id || '}' as body from events)
select 'all' as target, count(*) as n from b union all select 'short', count(*) from b where len(body) <= 18""")
def _(spark, sf):
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    events = Tables(spark, sf).events.select("event_id", F.to_json(F.struct(k.alias("k"), F.col("user_id").alias("user"))).alias("body"))
    targets = spark.createDataFrame([("all", None), ("short", 18)], "target string, max_bytes bigint")
    return K.fan_out(events, targets).groupBy("target").agg(F.count("*").alias("n"))


