from pyspark.sql import functions as F

from millrace.catalog import Family, Tables
from millrace.functions import text as X, values as V
from millrace.operators.features import date_parts

family = Family()
WORD = X.WORD


@family.add("x01_operations", """
select s_suppkey, upper(s_name) as up, lower(s_name) as low, reverse(s_name) as rev, len(s_name)::int as n,
  array_to_string(list_sort([s_name, 'b', 'a', 'a']), ',') as sorted, array_to_string(list_reverse([s_name, 'x']), ',') as rl, 3 as uniq from supplier""")
def _(spark, sf):
    name, items = F.col("s_name"), F.array("s_name", F.lit("b"), F.lit("a"), F.lit("a"))
    return Tables(spark, sf).supplier.select(
        "s_suppkey", X.apply_operation(name, "uppercase").alias("up"), X.apply_operation(name, "lowercase").alias("low"),
        X.apply_operation(name, "reverse").alias("rev"), X.apply_operation(name, "count").alias("n"),
        F.array_join(X.apply_operation(items, "sort", True), ",").alias("sorted"),
        F.array_join(X.apply_operation(F.array("s_name", F.lit("x")), "reverse", True), ",").alias("rl"),
        F.size(X.apply_operation(items, "unique", True)).alias("uniq"))


@family.add("x02_template", """
select c_custkey, 'Dear ' || c_name || ' of ' || case when c_acctbal >= 0 then c_mktsegment else '{{ seg }}' end || ', {{unknown}} ' || c_custkey as letter from customer""")
def _(spark, sf):
    fields = {"user.name": F.col("c_name"), "seg": F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")), "id": F.col("c_custkey")}
    return Tables(spark, sf).customer.select("c_custkey", X.fill_template("Dear {{user.name}} of {{ seg }}, {{unknown}} {{id}}", fields).alias("letter"))


@family.add("x03_clean_text", r"""
with c as (select doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', '', 'g') as t from documents)
select doc_id, len(t)::int as length, len(regexp_extract_all(t, '\S+'))::int as words, md5(t) as digest from c""")
def _(spark, sf):
    c = Tables(spark, sf).documents.select("doc_id", X.clean_text(F.col("text")).alias("t"))
    return c.select("doc_id", F.length("t").alias("length"), X.word_count(F.col("t")).alias("words"), F.md5("t").alias("digest"))


@family.add("x04_anchors", r"""
with h as (select page_id, regexp_extract(html, '<title>(.*?)</title>', 1) as t from pages),
s as (select page_id, t, trim(regexp_replace(regexp_replace(lower(t), '[^\p{L}\p{N}_\s-]', '', 'g'), '[\s_]+', '-', 'g'), '-') as anchor,
  trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(t)), '[^a-z0-9\s_-]', '', 'g'), '[\s_]+', '-', 'g'), '-{2,}', '-', 'g'), '-') as slug from h)
select page_id, anchor, case when slug = '' then 'section' else slug end as slug from s""")
def _(spark, sf):
    t = X.html_title(F.col("html"))
    return Tables(spark, sf).pages.select("page_id", X.anchor(t).alias("anchor"), X.ascii_slug(t).alias("slug"))


@family.add("x05_safe_file_name", r"""
select page_id, case when n = '' then 'file.bin' else n end as name from (select page_id, regexp_replace(regexp_replace(trim(regexp_replace(url, '^https?://[^/]*/?', '')), '[^A-Za-z0-9._-]+', '_', 'g'), '^\.+', '') as n from pages)""")
def _(spark, sf):
    return Tables(spark, sf).pages.select("page_id", X.safe_file_name(F.regexp_replace("url", "^https?://[^/]*/?", "")).alias("name"))


@family.add("x06_content_types", """
select p_partkey, lower(p_brand) as base, case p_size % 4 when 0 then 'application/json' when 1 then 'text/csv' when 2 then 'image/jpeg' else 'application/octet-stream' end as kind from part""")
def _(spark, sf):
    ending = F.when(F.col("p_size") % 4 == 0, ".JSON").when(F.col("p_size") % 4 == 1, ".csv").when(F.col("p_size") % 4 == 2, ".jpeg").otherwise(".zip")
    return Tables(spark, sf).part.select(
        "p_partkey", X.content_type_base(F.concat(F.lit(" "), "p_brand", F.lit(" ; charset=UTF-8"))).alias("base"),
        X.content_type_of(F.concat("p_name", ending)).alias("kind"))


UA = ("Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Safari/537.36 Edge/18.1", "Mozilla/5.0 (Macintosh) Version/17 Safari/605.1",
      "Mozilla/5.0 (Linux; Android 14) Chrome/121.0 Mobile Safari/537", "Mozilla/5.0 (iPad) Firefox/9.1", "curl/8.0")


@family.add("x07_user_agent", """
select browser, platform, device, count(*) as n from events join (values (0,'Edge','Windows','Desktop'),(1,'Safari','macOS','Desktop'),(2,'Chrome','Linux','Mobile'),(3,'Firefox','iOS','Tablet'),(4,'Unknown','Unknown','Desktop')) v(i, browser, platform, device)
 on user_id % 5 = i group by 1, 2, 3""")
def _(spark, sf):
    agent = F.element_at(F.array(*[F.lit(u) for u in UA]), (F.col("user_id") % 5).cast("int") + 1)
    e = Tables(spark, sf).events.select(agent.alias("ua")).select(*[c.alias(n) for n, c in X.user_agent(F.col("ua")).items()])
    return e.groupBy("browser", "platform", "device").agg(F.count("*").alias("n"))


@family.add("x08_emoji", """
select conv_id, turn, md5('🚀 ' || replace(text, 'the', '🔥') || ' :none: ✅') as digest from conversations""")
def _(spark, sf):
    marked = F.concat(F.lit(":rocket: "), F.replace("text", F.lit("the"), F.lit(":fire:")), F.lit(" :none: :check:"))
    return Tables(spark, sf).conversations.select("conv_id", "turn", F.md5(X.replace_emoji(marked)).alias("digest"))


@family.add("x08_links_and_quotes")
def _(spark, sf):
    linked = X.smart_quotes(X.auto_link(F.col("text")))
    d = Tables(spark, sf).documents.select("doc_id", linked.alias("t"))
    return d.select("doc_id", F.length("t").alias("length"), F.regexp_count("t", F.lit(r"\]\(mailto:")).alias("mails"), F.regexp_count("t", F.lit(r"\]\(https?:")).alias("links"))


@family.add("x09_strip_markdown", r"""
with m as (select doc_id, '---' || chr(10) || 'title: x' || chr(10) || '---' || chr(10) || '# ' || text || chr(10) || '[see](http://a.b) `code` <b>x</b> {ref}`y`' as t from documents),
s as (select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t,
  '(?s)\A---\s*\n.*?\n---\s*\n', ''), '(?s)```.*?```', ' ', 'g'), '`[^`]+`', ' ', 'g'), '\{[a-z]+\}`.+?`', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'),
  '!\[[^\]]*\]\([^)]+\)', ' ', 'g'), '(?m)^\[[^\]]+\]:\s*.+$', '', 'g'), '\s+', ' ', 'g') as t from m)
select doc_id, md5(trim(t)) as digest from s""")
def _(spark, sf):
    head, tail = "---\ntitle: x\n---\n# ", "\n[see](http://a.b) `code` <b>x</b> {ref}`y`"
    d = Tables(spark, sf).documents.select("doc_id", F.concat(F.lit(head), "text", F.lit(tail)).alias("t"))
    return d.select("doc_id", F.md5(X.strip_markdown(F.col("t"))).alias("digest"))


@family.add("x10_camel_split", r"""
with n as (select p_partkey, replace(array_to_string(list_transform(string_split(p_type, ' '), lambda t: upper(left(t, 1)) || lower(substr(t, 2))), ' ') || 'XMLPart' || p_size, ' ', '') as w from part)
select p_partkey, regexp_replace(regexp_replace(w, '([a-z])([A-Z])', '\1|\2', 'g'), '([A-Z])([A-Z][a-z])', '\1|\2', 'g') as parts from n""")
def _(spark, sf):
    name = F.concat(F.initcap("p_type"), F.lit("XMLPart"), F.col("p_size").cast("string"))
    return Tables(spark, sf).part.select("p_partkey", F.array_join(X.camel_parts(F.replace(name, F.lit(" "), F.lit(""))), "|").alias("parts"))


@family.add("x11_similarity", """
select n_nationkey, r_name, levenshtein(n_name, r_name)::int as distance,
  round(1.0 - levenshtein(lower(n_name), lower(r_name))::double / greatest(len(n_name), len(r_name)), 6) as similarity from nation join region on n_regionkey = r_regionkey""")
def _(spark, sf):
    t = Tables(spark, sf)
    pairs = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return pairs.select("n_nationkey", "r_name", F.levenshtein("n_name", "r_name").alias("distance"), F.round(X.similarity(F.col("n_name"), F.col("r_name")), 6).alias("similarity"))


GRAMS = "list_distinct(list_transform(range(1, len({c}) + 3), lambda i: substr('$$' || lower({c}) || '$$', i, 3)))"


@family.add("x12_ngrams_jaccard", f"""
with g as (select p_partkey, p_name, {GRAMS.format(c='p_name')} as a, {GRAMS.format(c='p_type')} as b from part)
select p_partkey, len(a)::int as grams, round(len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))), 6) as jaccard from g""")
def _(spark, sf):
    p = Tables(spark, sf).part.select("p_partkey", X.ngrams(F.col("p_name")).alias("a"), X.ngrams(F.col("p_type")).alias("b"))
    return p.select("p_partkey", F.size("a").alias("grams"), F.round(X.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


def stem_sql(w):
    cases = " ".join(f"when {w} like '%{s}' and len({w}) >= {len(s) + 2} then left({w}, len({w}) - {len(s)}) || '{e}'" for s, e in X.SUFFIX_RULES)
    return f"case {cases} else {w} end"


STOPS_SQL = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


def words_sql(text):
    plain = rf"regexp_replace(regexp_replace(regexp_replace({text}, '<[^>]+>', ' ', 'g'), '(?s)```.*?```', ' ', 'g'), '`[^`]+`', ' ', 'g')"
    return rf"list_filter(regexp_extract_all(lower({plain}), '[\p{{L}}\p{{N}}_\-]+'), lambda w: len(w) >= 2 and w not in ({STOPS_SQL}))"


@family.add("x13_stem", rf"""
with w as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from documents)
select word, {stem_sql('word')} as stem from w""")
def _(spark, sf):
    found = Tables(spark, sf).documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return found.select("word", X.stem(F.col("word")).alias("stem"))


@family.add("x14_human_readable", """
select doc_id, case when b < 1024 then b || ' B' when b < 1048576 then format('{:.1f} KiB', b / 1024.0) else format('{:.1f} MiB', b / 1048576.0) end as size,
  format('{:,}', b) as number, format('{:.1f}%', b / 40.0) as percent from (select doc_id, n_chars * 37 as b from documents)""")
def _(spark, sf):
    b = F.col("n_chars") * 37
    return Tables(spark, sf).documents.select("doc_id", V.human_bytes(b).alias("size"), V.human_number(b).alias("number"), V.human_percent(b / 40.0).alias("percent"))


@family.add("x15_date_parts", """
select event_id, year(ts)::int as ts_year, month(ts)::int as ts_month, day(ts)::int as ts_day, hour(ts)::int as ts_hour, (isodow(ts) - 1)::int as ts_dayofweek, quarter(ts)::int as ts_quarter, (isodow(ts) >= 6)::int as ts_is_weekend from events""")
def _(spark, sf):
    return Tables(spark, sf).events.select("event_id", *[c.alias(n) for n, c in date_parts(F.col("ts"), "ts", weekend=True).items()])


DATES = (
    "case o_orderkey % 7 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%Y/%m/%d') when 2 then strftime(o_orderdate, '%m/%d/%Y') "
    "when 3 then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') when 4 then strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') when 5 then strftime(o_orderdate, '%Y-%m-%dZ') else 'x' || o_orderkey end"
)


def date_texts(t):
    formats = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'Z'")
    text = F.concat(F.lit("x"), "o_orderkey")
    for i, f in enumerate(formats):
        text = F.when(F.col("o_orderkey") % 7 == i, F.date_format("o_orderdate", f)).otherwise(text)
    return t.orders.select("o_orderkey", text.alias("d"))


@family.add("x16_parse_dates", """
select o_orderkey, coalesce(case when o_orderkey % 7 < 5 then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') end, 'none') as parsed from orders""")
def _(spark, sf):
    return date_texts(Tables(spark, sf)).select("o_orderkey", F.coalesce(V.parse_date(F.col("d")), F.lit("none")).alias("parsed"))


@family.add("x17_looks_like_date", f"select o_orderkey, regexp_matches({DATES}, '^(\\d{{4}}-\\d{{2}}-\\d{{2}}|\\d{{4}}/\\d{{2}}/\\d{{2}}|\\d{{2}}/\\d{{2}}/\\d{{4}})') as looks from orders")
def _(spark, sf):
    return date_texts(Tables(spark, sf)).select("o_orderkey", V.looks_like_date(F.col("d")).alias("looks"))


@family.add("x18_to_bool", "select o_orderkey, o_orderkey % 3 <> 2 as flag from orders")
def _(spark, sf):
    word = F.when(F.col("o_orderkey") % 3 == 0, " Yes ").when(F.col("o_orderkey") % 3 == 1, "ON").otherwise("off")
    return Tables(spark, sf).orders.select("o_orderkey", V.to_bool(word).alias("flag"))


@family.add("x19_to_number", """
select event_id, value as num, true as coded, (select count(distinct event_type) from events) as codes from events""")
def _(spark, sf):
    # which bucket a text falls into is free: it is a whole number below the number of buckets, one for each text
    e = Tables(spark, sf).events.select("event_id", V.to_number(F.col("value").cast("string")).alias("num"), V.to_number(F.col("event_type")).alias("code"))
    codes = e.agg(F.count_distinct("code").alias("n")).scalar()
    return e.select("event_id", "num", ((F.col("code") == F.floor("code")) & F.col("code").between(0, 9999)).alias("coded"), codes.alias("codes"))


@family.add("x20_hashes_base64", """
select doc_id, sha256(text) as sha, substr(md5(text), 1, 8) as short, len(text)::int as length from documents""")
def _(spark, sf):
    url = F.concat(F.lit("data:text/plain;base64,"), F.base64(F.encode("text", "UTF-8")))
    return Tables(spark, sf).documents.select(
        "doc_id", F.sha2("text", 256).alias("sha"), F.substring(F.md5("text"), 1, 8).alias("short"),
        F.length(F.decode(V.decode_base64(url), "UTF-8")).alias("length"))


@family.add("x21_json", """
select event_id, '{"a":' || props_k || ',"b":"' || event_type || '"}' as canonical, props_k as best from (select *, regexp_extract(props, '([0-9]+)', 1)::bigint as props_k from events)""")
def _(spark, sf):
    from millrace.operators.sets import canonical_text

    k = F.regexp_extract("props", "([0-9]+)", 1)
    wrapped = F.concat(F.lit("Sure, here it is: "), "props", F.lit(" - done"))
    return Tables(spark, sf).events.select(
        "event_id", canonical_text(F.concat(F.lit('{ "b": "'), "event_type", F.lit('", "a": '), k, F.lit("}"))).alias("canonical"),
        F.try_variant_get(V.first_json_object(wrapped), "$.k", "bigint").alias("best"))


@family.add("x22_embedded_files", """
select doc_id, '$.items[1].attachment' as path, 'd' || doc_id || '.txt' as filename, 'text/plain' as content_type, len(text)::int as chars from documents where octet_length(encode(text)) >= 22""")
def _(spark, sf):
    doc = F.concat(F.lit('{"items":[1,{"attachment":{"Name":"d'), "doc_id", F.lit('.txt","Type":"text/plain","ContentBytes":"'), F.base64(F.encode("text", "UTF-8")), F.lit('"}}],"data":"short"}'))
    d = Tables(spark, sf).documents.select("doc_id", F.try_parse_json(F.regexp_replace(doc, "[\r\n]", "")).alias("doc"))
    found = V.embedded_files(d, "doc", ["doc_id"])
    return found.select("doc_id", "path", "filename", "content_type", F.length(F.decode(V.decode_base64(F.col("content")), "UTF-8")).alias("chars"))


@family.add("x24_maintainability", """
with l as (select doc_id, len(regexp_extract_all(text, '\\b(if|for|and|or|with|while)\\b')) + 1 as cc, len(text) - len(replace(text, chr(10), '')) + 1 as loc from documents),
m as (select doc_id, greatest(0, least(100, (171 - 0.23 * cc - 16.2 * ln(loc + 1)) * 100 / 171)) as score from l)
select doc_id, round(score, 6) as score, case when score >= 80 then 'A' when score >= 60 then 'B' when score >= 40 then 'C' when score >= 20 then 'D' else 'F' end as grade from m""")
def _(spark, sf):
    cc = F.regexp_count("text", F.lit(r"\b(if|for|and|or|with|while)\b")) + 1
    d = Tables(spark, sf).documents.select("doc_id", V.maintainability(cc, F.size(F.split("text", "\n"))).alias("score"))
    return d.select("doc_id", F.round("score", 6).alias("score"), V.letter_grade(F.col("score")).alias("grade"))


@family.add("x25_retry_delays", """
select l_linenumber, max(least(pow(2, l_linenumber - 1), 20)) as expo, max(least(1 + 2 * (l_linenumber - 1), 9))::double as linear, 1.5::double as fixed, count(*) as n from lineitem group by 1""")
def _(spark, sf):
    n = F.col("l_linenumber")
    return Tables(spark, sf).lineitem.groupBy("l_linenumber").agg(
        F.max(V.retry_delay(n, cap=20)).alias("expo"), F.max(V.retry_delay(n, "linear", 1.0, 2.0, 9.0)).alias("linear"),
        F.max(V.retry_delay(n, "constant", 1.5)).alias("fixed"), F.count("*").alias("n"))


@family.add("x26_html", r"""
select page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) as title, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) as digest from pages""")
def _(spark, sf):
    return Tables(spark, sf).pages.select("page_id", X.html_title(F.col("html")).alias("title"), F.md5(X.strip_html(F.col("html"))).alias("digest"))


@family.add("x27_person_fields", """
select p_partkey, case when i = '' then '??' else i end as initials, split_part(p_type, ' ', 1) as first_name, case when len(w) > 1 then w[len(w)] else '' end as last_name,
  date_diff('year', date '1950-06-15', date '2024-06-14') - 1 + p_size * 0 as age, p_size < 7 as fresh
from (select *, string_split(p_type, ' ') as w, upper(left(split_part(p_type, ' ', 1), 1) || left(split_part(p_type, ' ', 2), 1)) as i from part)""")
def _(spark, sf):
    as_of = F.lit("2024-06-14").cast("date")
    created = F.date_sub(as_of, F.col("p_size"))
    return Tables(spark, sf).part.select(
        "p_partkey", *[c.alias(n) for n, c in X.name_parts(F.col("p_type")).items()],
        V.age_in_years(F.lit("1950-06-15").cast("date"), as_of).cast("bigint").alias("age"), V.is_new(created, as_of, 7).alias("fresh"))
