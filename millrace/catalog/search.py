from pyspark.sql import functions as F

from millrace.catalog import Family, Tables
from millrace.catalog.scalars import GRAMS, stem_sql, words_sql
from millrace.functions import text as X
from millrace.operators import search as I
from millrace.session import cut

family = Family()


def search_docs(t):
    return t.documents.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("http://docs/"), "doc_id").alias("url"), "source", F.concat("source", F.lit(" report")).alias("title"),
        F.array(F.concat(F.lit("part "), "lang"), F.lit("summary notes")).alias("headings"), F.col("text").alias("content"),
        F.col("lang").alias("section"), F.array("source", "lang").alias("tags"))


# Positions run over title, headings and content; both tags start right after the content.
OCC = f"""
w as (select doc_id as id, list_concat(list_concat({words_sql("source || ' report'")}, list_concat({words_sql("'part ' || lang")}, {words_sql("'summary notes'")})), {words_sql('text')}) as m,
  {words_sql('source')} as t1, {words_sql('lang')} as t2 from documents),
x as (select id, len(m) + len(t1) + len(t2) as doc_len, unnest(m) as word, unnest(range(len(m))) as position from w
  union all select id, len(m) + len(t1) + len(t2), unnest(t1), unnest(range(len(m), len(m) + len(t1))) from w
  union all select id, len(m) + len(t1) + len(t2), unnest(t2), unnest(range(len(m), len(m) + len(t2))) from w),
occ as materialized (select id, doc_len, position, {stem_sql('word')} as term from x),
post as materialized (select term, id, count(*) as n, min(position) as first_position, max(doc_len) as doc_len, list_sort(list(position)) as positions from occ group by 1, 2)
"""


@family.add("i01_tokenize", f"""
select doc_id, len(v)::int as n, md5(array_to_string(list_transform(v, lambda w: {stem_sql('w')}), ' ')) as digest from (select doc_id, {words_sql('text')} as v from documents)""")
def _(spark, sf):
    d = Tables(spark, sf).documents.select("doc_id", X.tokens(F.col("text")).alias("v"))
    return d.select("doc_id", F.size("v").alias("n"), F.md5(F.array_join("v", " ")).alias("digest"))


CODE_STOPS = ", ".join(f"'{w}'" for w in X.CODE_STOP_WORDS)
LINES = f"""
ln as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no from documents),
lt as (select doc_id, line_no, line, list_filter(list_transform(regexp_extract_all(line, '[A-Za-z_][A-Za-z0-9_]{{1,50}}'), lambda w: lower(w)), lambda w: w not in ({CODE_STOPS})) as ws from ln),
tk as materialized (select doc_id, line_no, line, unnest(ws) as token, unnest(range(len(ws))) as ord from lt)
"""


def lines_of(t):
    return I.text_lines(t.documents)


def tokens_of(t, with_column=False):
    return I.line_tokens(lines_of(t), split_camel=False, with_column=with_column)


def stored(df):
    """An index is built once and read by every later step."""
    return cut(df, "index")


@family.add("i02_code_tokens", f"with {LINES} select token, count(*) as n, count(distinct doc_id) as docs from tk group by 1")
def _(spark, sf):
    return tokens_of(Tables(spark, sf)).groupBy("token").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


CAMEL = "string_split(regexp_replace(regexp_replace(w, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), ' ')"


@family.add("i02_camel_tokens", f"""
with ln as (select doc_id, unnest(string_split(text, chr(10))) as line from documents),
w as (select unnest(regexp_extract_all(line, '[A-Za-z_][A-Za-z0-9_]{{1,50}}')) as w from ln), k as (select w from w where lower(w) not in ({CODE_STOPS})),
p as (select lower(unnest({CAMEL})) as token from k where regexp_matches(substr(w, 2), '[A-Z]'))
select token, count(*) as n from (select lower(w) as token from k union all select token from p where len(token) >= 2 and token not in ({CODE_STOPS})) group by 1""")
def _(spark, sf):
    return I.line_tokens(lines_of(Tables(spark, sf)), with_column=False).groupBy("token").agg(F.count("*").alias("n"))


@family.add("i03_postings", f"with {OCC} select term, id, n, first_position::int as first_position, doc_len::int as doc_len, md5(array_to_string(positions, ',')) as positions from post")
def _(spark, sf):
    out = I.build_postings(search_docs(Tables(spark, sf)), with_positions=True)
    return out.withColumn("positions", F.md5(F.array_join(F.col("positions").cast("array<string>"), ",")))


@family.add("i04_line_postings", f"""
with {LINES}, r as (select *, row_number() over (partition by token order by doc_id, line_no, ord) as rn from tk)
select token, doc_id, line_no::int as line_no, ord::int as ord, (greatest(instr(lower(line), token) - 1, 0))::int as "column" from r""")
def _(spark, sf):
    return tokens_of(Tables(spark, sf), with_column=True).select("token", "doc_id", "line_no", "ord", "column")


RANKED = f"""
with {OCC}, st as (select count(*) as documents, avg(len(m) + len(t1) + len(t2)) as mean_len from w),
qw as (select item_id, unnest({words_sql('text')}) as word from benchmark), q as (select item_id, {stem_sql('word')} as term, count(*) as weight from qw group by 1, 2),
f as (select term, count(*) as df from post group by 1),
s as (select item_id, id, sum(weight * (ln((documents + 1) / (df + 1)) + 1) * (1 + ln(n)) / ((1 + ln(n)) + 1.5 * (0.25 + 0.75 * doc_len / mean_len)) * case when first_position < 10 then 5 else 1 end) as score, count(*) as matched_terms
  from q join post using (term) join f using (term), st group by 1, 2),
r as (select *, row_number() over (partition by item_id order by round(score, 9) desc, id) as position from s)
"""


@family.add("i05_ranked_search", RANKED + "select item_id, id, round(score, 6) as score, matched_terms, position::int as position from r where position <= 5")
def _(spark, sf):
    t = Tables(spark, sf)
    docs = search_docs(t)
    postings = stored(I.build_postings(docs))
    found = I.ranked_search(postings, I.document_stats(docs, postings), t.benchmark, "item_id", "text", limit=5)
    return found.withColumn("score", F.round("score", 6))


@family.add("i05_search_with_filter", RANKED.replace("(term), st group", "(term), st where id in (select doc_id from documents where lang = 'en') group") + "select item_id, id, round(score, 6) as score from r where position <= 3")
def _(spark, sf):
    t = Tables(spark, sf)
    docs = search_docs(t)
    postings = stored(I.build_postings(docs))
    allowed = I.document_filter(docs, section="en")
    found = I.ranked_search(postings, I.document_stats(docs, postings), t.benchmark, "item_id", "text", limit=3, allowed=allowed)
    return found.select("item_id", "id", F.round("score", 6).alias("score"))


LINE_SEARCH = """
with {lines}, tot as (select count(distinct doc_id) as n from documents), ex as (select unnest({expanded}) as token),
rn as (select *, row_number() over (partition by token order by doc_id, line_no, ord) as r from tk where token in ({words})),
common as (select doc_id, line_no from rn group by 1, 2 having count(distinct token) = {k}),
dl as (select doc_id, count(*) as len from tk group by 1), c as (select token, doc_id, count(*) as n from tk where token in (select token from ex) group by 1, 2), f as (select token, count(*) as df from c group by 1),
ds as (select doc_id, sum(c.n / len * (ln((tot.n + 1) / (df + 1)) + 1)) as tf_idf from c join f using (token) join dl using (doc_id), tot group by 1)
select doc_id, line_no::int as line_no, md5(trim(line)) as line, round(tf_idf + 0.1 * (select count(*) from ex where contains(lower(line), token)), 6) as score
from ln join common using (doc_id, line_no) join ds using (doc_id) order by round(tf_idf + 0.1 * (select count(*) from ex where contains(lower(line), token)), 9) desc, doc_id, line_no limit 50"""


@family.add("i06_line_search", LINE_SEARCH.format(lines=LINES, expanded="['les', 'des']", words="'les', 'des'", k=2))
def _(spark, sf):
    t = Tables(spark, sf)
    found = I.line_search(lines_of(t), stored(tokens_of(t, with_column=True)), "the les des")
    return found.withColumns({"line": F.md5("line"), "score": F.round("score", 6)})


VOCAB = f"""
v as (select distinct token from tk), g as (select token, {GRAMS.format(c='token')} as gs from v),
qg as (select word, {GRAMS.format(c='word')} as gs from (values ('thand'), ('entier'), ('sch')) q(word)),
sim as (select word, token, len(list_intersect(g.gs, qg.gs))::double / len(list_distinct(list_concat(g.gs, qg.gs))) as similarity from g, qg),
near as (select *, row_number() over (partition by word order by similarity desc, token) as r from sim where similarity >= 0.5)
"""


@family.add("i07_fuzzy_expansion", f"with {LINES}, {VOCAB} select word, token, round(similarity, 6) as similarity from near where r <= 5")
def _(spark, sf):
    t = Tables(spark, sf)
    asked = spark.createDataFrame([("thand",), ("entier",), ("sch",)], "word string")
    return I.similar_tokens(tokens_of(t), asked).withColumn("similarity", F.round("similarity", 6))


NEAR = VOCAB.replace("(values ('thand'), ('entier'), ('sch')) q(word)", "(select 'les' as word)")


@family.add("i07_fuzzy_line_search", LINE_SEARCH.format(lines=LINES + ", " + NEAR, expanded="['les']", words="'les'", k=1).replace(
    "ex as (select unnest(['les']) as token)", "ex as (select 'les' as token union select token from near where r <= 5)").replace("limit 50", "limit 20"))
def _(spark, sf):
    t = Tables(spark, sf)
    found = I.line_search(lines_of(t), stored(tokens_of(t, with_column=True)), "les", fuzzy=True, limit=20)
    return found.withColumns({"line": F.md5("line"), "score": F.round("score", 6)})


@family.add("j08_all_terms", f"""
with {LINES} select doc_id, line_no::int as line_no from tk where token in ('les', 'des', 'une') group by 1, 2 having count(distinct token) = 3""")
def _(spark, sf):
    return I.all_terms(tokens_of(Tables(spark, sf)), ["les", "des", "une"])


@family.add("j10_fuzzy_tokens", f"""
with v as (select distinct p_name as token from part), g as (select token, {GRAMS.format(c='token')} as gs from v), qg as (select distinct p_type as word, {GRAMS.format(c='p_type')} as gs from part),
s as (select word, token, len(list_intersect(g.gs, qg.gs))::double / len(list_distinct(list_concat(g.gs, qg.gs))) as similarity from g, qg),
r as (select *, row_number() over (partition by word order by similarity desc, token) as r from s where similarity >= 0.1) select word, token, round(similarity, 6) as similarity from r where r <= 3""")
def _(spark, sf):
    p = Tables(spark, sf).part
    out = I.similar_tokens(p.select(F.col("p_name").alias("token")), p.select(F.col("p_type").alias("word")), 0.1, 3)
    return out.withColumn("similarity", F.round("similarity", 6))


@family.add("i08_fuzzy_strings", """
with w as (select distinct unnest(regexp_extract_all(text, '[A-Za-z]+')) as word from benchmark), c as (select distinct unnest(regexp_extract_all(text, '[A-Za-z]+')) as candidate from documents),
s as (select word, candidate, 1.0 - levenshtein(lower(word), lower(candidate))::double / greatest(len(word), len(candidate)) as similarity from w join c on abs(len(word) - len(candidate)) <= 0.3 * greatest(len(word), len(candidate)) + 1)
select word, candidate, round(similarity, 6) as similarity from s where similarity >= 0.7""")
def _(spark, sf):
    t = Tables(spark, sf)
    # DuckDB measures bytes, so compare plain letters
    words_of = lambda df, name: df.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias(name)).distinct()
    found = I.fuzzy_matches(words_of(t.benchmark, "word"), words_of(t.documents, "candidate"))
    return found.withColumn("similarity", F.round("similarity", 6))


@family.add("i09_autocomplete", f"with {OCC} select term, count(*) as df from post where term like 'th%' group by 1 order by df desc, term limit 10")
def _(spark, sf):
    return I.autocomplete(I.build_postings(search_docs(Tables(spark, sf))), "TH")


@family.add("i09_prefix_lines", f"""
with {LINES}, r as (select *, row_number() over (partition by token order by doc_id, line_no, ord) as r from tk where token like 'ent%')
select doc_id, line_no::int as line_no, min(token) as token from r where r <= 5 group by 1, 2 order by token, doc_id, line_no limit 30""")
def _(spark, sf):
    return I.prefix_lines(tokens_of(Tables(spark, sf)), "ENT")


@family.add("i10_suggestions", f"""
with {OCC}, qw as (select item_id, unnest({words_sql('text')}) as word from benchmark), h as (select distinct item_id, left({stem_sql('word')}, 3) as head from qw),
f as (select term, left(term, 3) as head, count(*) as df from post group by 1), t as (select *, row_number() over (partition by head order by df desc, term) as r from f),
m as (select item_id, term, max(df) as df from h join t using (head) where r <= 5 group by 1, 2), k as (select *, row_number() over (partition by item_id order by df desc, term) as rk from m) select item_id, term, df from k where rk <= 10""")
def _(spark, sf):
    t = Tables(spark, sf)
    return I.suggestions(stored(I.build_postings(search_docs(t))), t.benchmark, "item_id", "text")


@family.add("i11_substring_search", """
select doc_id, case when contains(lower(source), 'src1') then 'source' when contains(lower(text), 'src1') then 'text' else 'tags' end as found_in
from documents where contains(lower(source), 'src1') or contains(lower(text), 'src1') or lang = 'src1'""")
def _(spark, sf):
    d = Tables(spark, sf).documents.withColumn("tags", F.array("lang"))
    return I.substring_search(d, "SRC1", ["source", "text", "tags"]).select("doc_id", "found_in")


def code_lines(t):
    """Lines of documents dressed as definitions, so that every pattern has something to find."""
    word = F.regexp_replace(F.split("text", " ")[0], "[^A-Za-z]", "")
    word = F.when(F.col("source") == "src5", F.concat(F.lit("_"), word)).otherwise(word)
    line = F.when(F.col("lang") == "en", F.concat(F.lit("  class "), word, F.lit(":"))).when(F.col("lang") == "fr", F.concat(word, F.lit(" = 1")))
    line = line.when(F.col("lang") == "de", F.concat(F.lit("export const "), word, F.lit(" = 2"))).otherwise(F.concat(F.lit("pub fn "), word, F.lit("() {}")))
    language = F.when(F.col("lang").isin("en", "fr"), "python").when(F.col("lang") == "de", "typescript").otherwise("rust")
    return t.documents.select("doc_id", language.alias("language"), line.alias("line"))


@family.add("i12_symbols", """
with w as (select doc_id, lang, case when source = 'src5' then '_' else '' end || regexp_replace(split_part(text, ' ', 1), '[^A-Za-z]', '', 'g') as name from documents)
select doc_id, name, case lang when 'en' then 'class' when 'fr' then 'variable' when 'de' then 'constant' else 'function' end as kind,
  case lang when 'en' then 'class ' || name || ':' when 'fr' then name || ' = 1' when 'de' then 'export const ' || name || ' = 2' else 'pub fn ' || name || '() {}' end as signature
from w where name <> '' and not (lang in ('fr', 'de') and name like '\\_%' escape '\\')""")
def _(spark, sf):
    return I.symbols(code_lines(Tables(spark, sf))).select("doc_id", "name", "kind", "signature")


@family.add("i12_symbol_search", """
with w as (select doc_id, case when source = 'src5' then '_' else '' end || regexp_replace(split_part(text, ' ', 1), '[^A-Za-z]', '', 'g') as name from documents where lang = 'en')
select doc_id, name, 'class' as kind from w where contains(lower(name), 'an') order by name, doc_id limit 30""")
def _(spark, sf):
    return I.symbol_search(I.symbols(code_lines(Tables(spark, sf))), "an", "class", order=("name", "doc_id")).select("doc_id", "name", "kind")


@family.add("i13_index_statistics", f"""
with {LINES}, m as (select token, count(*) as n from tk group by 1)
select count(*) as total_tokens, sum(n)::bigint as total_matches, (select count(*) from documents) as total_documents, 0::bigint as total_symbols, round(sum(n) / count(*), 6)::double as avg_matches_per_token from m""")
def _(spark, sf):
    t = Tables(spark, sf)
    out = I.index_statistics(tokens_of(t), t.documents)
    return out.withColumn("avg_matches_per_token", F.round("avg_matches_per_token", 6))


@family.add("i13_file_terms", f"with {LINES} select distinct doc_id, token from tk")
def _(spark, sf):
    return I.file_terms(tokens_of(Tables(spark, sf)))


@family.add("i14_metadata_search", """
select o_orderkey as model_id, o_totalprice as score from orders where o_orderpriority = '3-MEDIUM' and o_orderstatus = 'F' and contains('m' || o_custkey, '7') order by o_totalprice desc, o_orderkey limit 20""")
def _(spark, sf):
    docs = Tables(spark, sf).orders.select(F.col("o_orderkey").alias("model_id"), F.concat(F.lit("m"), "o_custkey").alias("model_name"), F.col("o_totalprice").alias("score"),
                                           F.array("o_orderpriority").alias("tags"), F.col("o_orderstatus").alias("problem"))
    out = I.metadata_search(docs, "7", ["model_name"], {"tags": "3-MEDIUM", "problem": "F"}, ["tags", "problem"], ["-score", "model_id"], ["score", "model_id"])
    return out.select("model_id", "score")


@family.add("i15_incremental_index", f"""
with {OCC} select term, count(*) as docs, sum(n)::bigint as n from post where id not in (select doc_id from documents where lang = 'es') group by 1""")
def _(spark, sf):
    docs = search_docs(Tables(spark, sf))
    stale = docs.withColumn("content", F.when(F.col("section") == "de", F.lit("old words")).otherwise(F.col("content")))
    index = I.build_postings(stale)
    index = I.upsert_documents(index, docs.where("section = 'de'"))
    index = I.remove_documents(index, docs.where("section = 'es'"))
    return index.groupBy("term").agg(F.count("*").alias("docs"), F.sum("n").alias("n"))


@family.add("x23_excerpts")
def _(spark, sf):
    t = Tables(spark, sf)
    docs = search_docs(t)
    query = "report of erst"
    postings = stored(I.build_postings(docs))
    asked = spark.createDataFrame([(0, query)], "query_id int, query string")
    found = I.ranked_search(postings, I.document_stats(docs, postings), asked, limit=10)
    return I.with_excerpts(found, docs, query)


@family.add("k06_export_documents", """
select doc_id as id, md5(left(text, 1000)) as content, md5(case when len(text) > 300 then left(text, 300) || '...' else text end) as excerpt, 'part ' || lang || '|summary notes' as headings from documents""")
def _(spark, sf):
    out = I.export_documents(search_docs(Tables(spark, sf)))
    return out.select("id", F.md5("content").alias("content"), F.md5("excerpt").alias("excerpt"), F.array_join("headings", "|").alias("headings"))
