from pyspark.sql import functions as F

from millrace.catalog import Family, Tables
from millrace.functions import lookups
from millrace.operators import corpus as C, joins as J, search as I
from millrace.sources import readers
from millrace.session import scratch_path

family = Family()

# Trailing newline removed, as a closing newline does not open another line.
LN = "case when text = '' then [] else string_split(regexp_replace(text, '\\n\\z', ''), chr(10)) end"


@family.add("c01_scan_files", """
select lang || '/' || source as folder, sum(n_chars)::bigint as chars, count(*) as docs from documents group by 1""")
def _(spark, sf):
    # The corpus is written out as text files first, a document per line, one folder per language and source.
    root = scratch_path(spark, "corpus")
    one_line = F.to_json(F.struct("doc_id", "text"))
    t = Tables(spark, sf)
    t.documents.select("lang", "source", one_line.alias("value")).write.option("maxRecordsPerFile", 10_000).partitionBy("lang", "source").text(root)
    files = C.describe_files(readers.scan_files(spark, root))
    assert {"language", "content_hash"} <= set(files.columns)
    bodies = readers.read_text_corpus(spark, root).select(F.regexp_extract("path", "lang=([^/]+)/source=[^/]+/", 1).alias("l"), F.regexp_extract("path", "source=([^/]+)/", 1).alias("s"), "text")
    lines = bodies.select("l", "s", F.explode(C.split_lines(F.col("text"))).alias("line"))
    counted = lines.groupBy(F.concat_ws("/", "l", "s").alias("folder")).agg(F.sum(F.length(F.from_json("line", "text string")["text"]).cast("bigint")).alias("chars"), F.count("*").alias("docs"))
    seen = files.groupBy(F.concat_ws("/", F.regexp_extract("path", "lang=([^/]+)/", 1), F.regexp_extract("path", "source=([^/]+)/", 1)).alias("folder")).agg(F.sum("line_count").alias("file_lines"))
    return counted.join(seen, "folder").where("docs = file_lines").select("folder", "chars", "docs")


@family.add("c02_line_metrics", f"""
with l as (select doc_id, list_transform({LN}, lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(10) || chr(12))) as ls from documents),
m as (select doc_id, len(ls) as lines, len(list_filter(ls, lambda x: x = '')) as blank, len(list_filter(ls, lambda x: x like '#%' or x like '//%' or x like '/*%' or x like '*%' or x like '\"\"\"%' or x like '''''''%')) as comments from l)
select doc_id, lines::int as lines, blank::int as blank, comments::int as comments, (lines - blank - comments)::int as logical, round(case when lines > 0 then comments * 100.0 / lines else 0 end, 6)::double as comment_ratio from m""")
def _(spark, sf):
    return C.line_metrics(Tables(spark, sf).documents, "doc_id").withColumn("comment_ratio", F.round("comment_ratio", 6))


@family.add("c03_branch_complexity", r"""
select doc_id, (len(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda w: w in ('if', 'elif', 'while', 'for', 'and', 'or', 'except', 'with', 'case', 'lambda'))) + len(regexp_extract_all(text, '\?\s*:')) + 1)::int as complexity from documents""")
def _(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", C.branch_complexity(F.col("text"))["complexity"].alias("complexity"))


def as_code(t):
    """Documents indented into something like code."""
    body = F.regexp_replace(F.col("text"), r"(?m)^(The|La|El|Der|In) ", "    if $1 x:\n        ")
    return t.documents.select("doc_id", F.concat(F.lit("def a(x):\n"), body, F.lit("\ndef b():\n    return 1\n")).alias("text"))


@family.add("c04_nesting_complexity")
def _(spark, sf):
    return as_code(Tables(spark, sf)).select("doc_id", C.nesting_complexity(F.col("text")).alias("nested"))


@family.add("c05_code_quality")
def _(spark, sf):
    return C.code_quality(as_code(Tables(spark, sf)), "doc_id")


def rule_test(name):
    """The rule as a DuckDB condition; its regular expressions have no look-ahead, so excused hosts are cut out first."""
    if name == "http_without_https":
        return "contains(regexp_replace(line, 'http://(localhost|127\\.0\\.0\\.1|0\\.0\\.0\\.0)', '', 'g'), 'http://')"
    return "regexp_matches(line, '{}')".format(C.SCAN_RULES[name][0].replace("'", "''"))


RULE_CASES = " union all ".join(
    f"select doc_id, line_no, '{k}' as rule_id, '{severity}' as severity, line from ln where {rule_test(k)}" for k, (_, severity) in C.SCAN_RULES.items())
LN_ROWS = "ln as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no from documents)"


@family.add("c06_rule_scan", f"""
with {LN_ROWS} select rule_id, severity, count(*) as n, count(distinct doc_id) as docs, sum(line_no)::bigint as line_sum from ({RULE_CASES}) group by 1, 2""")
def _(spark, sf):
    found = C.scan_rules(I.text_lines(Tables(spark, sf).documents))
    return found.groupBy("rule_id", "severity").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"), F.sum("line_no").cast("bigint").alias("line_sum"))


@family.add("c06_worst_findings", f"""
with {LN_ROWS} select rule_id, severity, doc_id, line_no::int as line_no, md5(left(trim(line), 200)) as snippet from ({RULE_CASES}) where severity <> 'info'
order by case severity when 'high' then 1 when 'medium' then 2 else 3 end, rule_id, doc_id, line_no""")
def _(spark, sf):
    found = C.worst_findings(C.scan_rules(I.text_lines(Tables(spark, sf).documents), at_least="low"), ["rule_id", "doc_id", "line_no"])
    return found.select("rule_id", "severity", "doc_id", "line_no", F.md5("snippet").alias("snippet"))


@family.add("c07_requirements", """
select p_partkey, name, version from (select p_partkey, replace(p_name, ' ', '-') as name, '>=' || p_size as version from part
union all select p_partkey, 'extra_' || p_size, null from part)""")
def _(spark, sf):
    body = F.concat(F.lit("# deps\n-r base.txt\n\n"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("[opt]>="), "p_size", F.lit("\n extra_"), "p_size", F.lit(" \nbad line here\n"))
    return C.requirement_rows(Tables(spark, sf).part.select("p_partkey", body.alias("text")), "p_partkey")


@family.add("c07_package_json", """
select p_partkey, 'lib' || p_size as name, '^' || p_size as version, false as is_dev from part union all select p_partkey, 'dev' || p_size, '1.0', true from part""")
def _(spark, sf):
    body = F.concat(F.lit('{"name":"x","dependencies":{"lib'), "p_size", F.lit('":"^'), "p_size", F.lit('"},"devDependencies":{"dev'), "p_size", F.lit('":"1.0"}}'))
    return C.package_json_rows(Tables(spark, sf).part.select("p_partkey", body.alias("text")), "p_partkey")


@family.add("c07_manifests", """
select p_partkey, 'serde' as name, '1.' || p_size as version from part union all select p_partkey, 'tokio', '2.0' from part union all select p_partkey, 'proptest', null from part
union all select p_partkey, 'numpy', '>=' || p_size from part""")
def _(spark, sf):
    p = Tables(spark, sf).part
    cargo = F.concat(F.lit('[package]\nname = "a"\n[dependencies]\nserde = "1.'), "p_size", F.lit('"\ntokio = { version = "2.0", features = [] }\n[dev-dependencies]\nproptest = { path = "x" }\n'))
    project = F.concat(F.lit('[project]\nname = "a"\ndependencies = [\n  "numpy>='), "p_size", F.lit('",\n]\n'))
    a = C.cargo_rows(p.select("p_partkey", cargo.alias("text")), "p_partkey").select("p_partkey", "name", "version")
    return a.unionByName(C.pyproject_rows(p.select("p_partkey", project.alias("text")), "p_partkey"))


@family.add("c08_detection", """
with f as (select case p_size % 5 when 0 then 'a/Cargo.toml' when 1 then 'x/.github/workflows/ci.yml' when 2 then 'package.json' when 3 then 'b/Makefile' else 'src/main.py' end as path from part)
select path, count(*) as n, case path when 'a/Cargo.toml' then 'cargo' when 'package.json' then 'npm' when 'b/Makefile' then 'make' else '' end as build, case when path like '%.github/workflows/%' then 'github-actions' else '' end as ci,
  case path when 'src/main.py' then 'fastapi' else '' end as frameworks from f group by 1""")
def _(spark, sf):
    names = ("a/Cargo.toml", "x/.github/workflows/ci.yml", "package.json", "b/Makefile", "src/main.py")
    path = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("p_size") % 5 + 1)
    files = Tables(spark, sf).part.groupBy(path.alias("path")).agg(F.count("*").alias("n"))
    join = lambda c: F.array_join(c, ",")
    p = F.col("path")
    return files.select("path", "n", join(lookups.build_systems(p)).alias("build"), join(lookups.ci_systems(p)).alias("ci"),
                        join(lookups.indicators_in(lookups.file_name(p), lookups.FRAMEWORK_WORDS)).alias("frameworks"))


LICENSE_CASE = "case " + " ".join(f"when regexp_matches(text, '(?i){p}') then '{n}'" for n, p in C.LICENSES) + " else 'none' end"


@family.add("c09_license", f"select {LICENSE_CASE} as license, count(*) as n from documents group by 1")
def _(spark, sf):
    return Tables(spark, sf).documents.groupBy(F.coalesce(C.license_of(F.col("text")), F.lit("none")).alias("license")).agg(F.count("*").alias("n"))


@family.add("c10_environment_names", r"""
select distinct w as name from (select unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) as w from documents)
where regexp_full_match(w, '[A-Z][A-Z0-9_]{2,}') and w not in ('TRUE', 'FALSE', 'NULL', 'NONE', 'TODO', 'FIXME', 'NOTE') order by name""")
def _(spark, sf):
    return C.environment_names(Tables(spark, sf).documents)


@family.add("c11_documentation_score", """
with f as (select case source when 'src0' then 'README.md' when 'src1' then 'docs/a.md' when 'src2' then 'CHANGELOG.md' else 'src/d' || lpad(doc_id::varchar, 7, '0') || '.py' end as path, text from documents),
c as (select * from f where path like '%.py')
select round(least(100, 20 + 15 + 10 + 25 * (select avg((contains(text, '#') or contains(text, '//') or contains(text, '/*') or contains(text, '\"\"\"') or contains(text, ''''''''))::int) from c)), 6)::double as score""")
def _(spark, sf):
    src = F.col("source")
    path = F.when(src == "src0", "README.md").when(src == "src1", "docs/a.md").when(src == "src2", "CHANGELOG.md").otherwise(
        F.concat(F.lit("src/d"), F.lpad(F.col("doc_id").cast("string"), 7, "0"), F.lit(".py")))
    out = C.documentation_score(Tables(spark, sf).documents.select(path.alias("path"), "text"))
    return out.select(F.round("score", 6).alias("score"))


def commit_log(t):
    zone = F.concat(F.lit("+0"), F.col("c_nationkey") % 3, F.lit(":00"))
    line = F.concat_ws("|", F.md5(F.col("o_orderkey").cast("string")), F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 7), "c_name",
                       F.concat("c_name", F.lit("@EXAMPLE.com")), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'01:30:00"), zone), F.concat(F.lit("fix | "), "o_orderpriority"))
    return C.parse_commits(t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(line.alias("line")))


COMMITS = "k as (select c_name, lower(c_name || '@EXAMPLE.com') as email, o_orderdate + interval 90 minute as l, o_orderdate + interval 90 minute - to_hours((c_nationkey % 3)::int) as u, o_orderkey from orders join customer on o_custkey = c_custkey)"


@family.add("a09_commit_cuts", f"""
with {COMMITS} select 'day' as cut, strftime(l, '%Y-%m-%d') as key, count(*) as n from k group by 2 union all select 'hour', hour(l)::varchar, count(*) from k group by 2
union all select 'weekday', (isodow(l) - 1)::varchar, count(*) from k group by 2 union all select 'month_author', strftime(l, '%Y-%m') || ' ' || email, count(*) from k group by 2""")
def _(spark, sf):
    return C.commit_cuts(commit_log(Tables(spark, sf)))


@family.add("c12_contributors", f"""
with {COMMITS} select email, max(c_name) as name, count(*) as commits, strftime(min(u), '%Y-%m-%d %H:%M') as first_commit, strftime(max(u), '%Y-%m-%d %H:%M') as last_commit from k group by 1""")
def _(spark, sf):
    out = C.contributors(commit_log(Tables(spark, sf)))
    return out.select("email", "name", "commits", *[F.date_format(c, "yyyy-MM-dd HH:mm").alias(c) for c in ("first_commit", "last_commit")])


def numstat(t):
    kind = F.when(F.col("l_returnflag") == "R", F.concat_ws("\t", F.lit("-"), F.lit("-"), F.concat(F.lit("f"), "l_partkey"))).otherwise(
        F.concat_ws("\t", F.col("l_quantity").cast("int"), "l_linenumber", F.concat(F.lit("f"), "l_partkey")))
    return C.parse_numstat(t.lineitem.select(kind.alias("line")))


@family.add("c12_change_totals", """
select sum(case when l_returnflag = 'R' then 0 else trunc(l_quantity) end)::bigint as insertions,
  sum(case when l_returnflag = 'R' then 0 else l_linenumber end)::bigint as deletions, count(*) as changes from lineitem""")
def _(spark, sf):
    return C.change_totals(numstat(Tables(spark, sf)))


@family.add("a09_most_changed", "select 'f' || l_partkey as path, count(*) as changes from lineitem group by 1 order by changes desc, path limit 50")
def _(spark, sf):
    return C.most_changed(numstat(Tables(spark, sf)), limit=50)


@family.add("c13_change_set", """
with n as (select 'f' || l_partkey as path, sum(case when l_returnflag <> 'R' then l_quantity::int else 0 end)::bigint as insertions, sum(case when l_returnflag <> 'R' then l_linenumber else 0 end)::bigint as deletions, bool_or(l_returnflag = 'R') as is_bin from lineitem group by 1),
s as (select 'f' || p_partkey as path, case when p_size < 10 then 'A' when p_size > 40 then 'R' else 'M' end as status, 'old' || p_partkey as old_path from part where p_size <> 20 union all select 'new' || s_suppkey, 'A', null from supplier)
select coalesce(n.path, s.path) as path, coalesce(status, 'M') as status, coalesce(case when status = 'R' then old_path end, '') as old_path, coalesce(insertions, 0) as insertions, coalesce(deletions, 0) as deletions, coalesce(is_bin, false) as is_binary from n full join s on n.path = s.path""")
def _(spark, sf):
    t = Tables(spark, sf)
    size = F.col("p_size")
    status = t.part.where("p_size <> 20").select(F.concat(F.lit("f"), "p_partkey").alias("path"), F.when(size < 10, "A").when(size > 40, "R097").otherwise("M").alias("status"), F.concat(F.lit("old"), "p_partkey").alias("old_path"))
    status = status.unionByName(t.supplier.select(F.concat(F.lit("new"), "s_suppkey").alias("path"), F.lit("A").alias("status"), F.lit(None).cast("string").alias("old_path")))
    return C.change_set(numstat(t), status).withColumn("old_path", F.coalesce("old_path", F.lit(""))).withColumnRenamed("binary", "is_binary")


def markdown_pages(t):
    prose = F.regexp_replace("text", r"[^\p{L}\p{N} ,.]", " ")  # the whole text, without marks of its own
    name = F.col("doc_id").cast("string")
    body = F.concat(
        F.when(F.col("lang") == "en", F.concat(F.lit('---\ntitle: "Page '), name, F.lit('"\ntags: x\n---\n'))).otherwise(""),
        F.lit("# Top "), name, F.lit("\n"), prose, F.lit("\n(sec-"), name, F.lit(")=\n## Part one\n```{figure} a.png\n:name: fig-"), name, F.lit("a\n```\n```{figure} b.png\n:name: fig-"), name,
        F.lit("b\n```\n$$\nx=1\n$$ (eq-"), name, F.lit(")\nSee {ref}`fig-"), name, F.lit("b` and {cite}`k"), name, F.lit("` with {term}`the plan <Plan>` or {term}`ghost`.\n"))
    return t.documents.select("doc_id", "lang", body.alias("text"))


@family.add("c14_markdown", """
select doc_id, case when lang = 'en' then 'Page ' || doc_id else 'Top ' || doc_id end as title, 2 as sections, 'figure,figure' as directives, 'k' || doc_id as citations, 'fig-' || doc_id || 'b,sec-' || doc_id as refs, 1 as equations from documents""")
def _(spark, sf):
    out = C.parse_markdown(markdown_pages(Tables(spark, sf)), "doc_id")
    j = lambda c: F.array_join(c, ",")
    return out.select("doc_id", "title", "sections", j("directives").alias("directives"), j("citations").alias("citations"), j("references").alias("refs"), "equations")


@family.add("c14_headings", r"""
with ln as (select doc_id, unnest(string_split(text, chr(10))) as l, unnest(range(1, len(string_split(text, chr(10))) + 1)) as n from (select doc_id, '# ' || replace(text, chr(10), chr(10) || '## ') as text from documents))
select doc_id, n::int as line_no, len(regexp_extract(l, '^(#{1,6})\s', 1))::int as level, md5(trim(regexp_extract(l, '^#{1,6}\s+(.+)$', 1))) as title from ln where regexp_matches(l, '^#{1,6}\s+.+$')""")
def _(spark, sf):
    d = Tables(spark, sf).documents.select("doc_id", F.concat(F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n## "))).alias("text"))
    return C.headings(d, "doc_id").select("doc_id", "line_no", "level", F.md5("title").alias("title"))


@family.add("c15_reference_targets", """
select doc_id, 'section' as type, 0 as number, 'sec-' || doc_id as label from documents union all select doc_id, 'figure', 1, 'fig-' || doc_id || 'a' from documents
union all select doc_id, 'figure', 2, 'fig-' || doc_id || 'b' from documents union all select doc_id, 'equation', 1, 'eq-' || doc_id from documents""")
def _(spark, sf):
    return C.reference_targets(markdown_pages(Tables(spark, sf)), "doc_id").withColumn("number", F.coalesce("number", F.lit(0)))


@family.add("c16_resolved_text", "select doc_id, '[Figure 2](#fig-' || doc_id || 'b)' as link, false as unresolved from documents")
def _(spark, sf):
    pages = markdown_pages(Tables(spark, sf))
    targets = C.reference_targets(pages, "doc_id")
    found = C.mentions(pages, "doc_id", "ref")
    known = J.resolve_references(found, targets, "ref", "label").join(targets.select(F.col("label").alias("resolved"), "type", "number"), "resolved", "left")
    shown = F.concat(F.lit("["), F.initcap("type"), F.lit(" "), "number", F.lit("](#"), "resolved", F.lit(")"))
    swaps = found.join(known.select("ref", F.coalesce(shown, F.concat(F.lit("*"), "ref", F.lit("*"))).alias("shown")), "ref")
    out = C.resolve_text(pages, swaps.select("doc_id", "position", "shown"), "doc_id", "ref")
    return out.select("doc_id", F.regexp_extract("text", r"See (.*?) and ", 1).alias("link"), F.col("text").contains("{ref}").alias("unresolved"))


@family.add("c16_reference_statistics", """
select 'section' as type, count(*) as targets, count(*) as labels from documents union all select 'figure', 2 * count(*), 2 * count(*) from documents union all select 'equation', count(*), count(*) from documents""")
def _(spark, sf):
    return C.reference_statistics(C.reference_targets(markdown_pages(Tables(spark, sf)), "doc_id"))


@family.add("c17_bibtex", """
select p_partkey, 'key' || p_partkey as cite_key, 'Ann Lee, Bo Ray (' || (1900 + p_size) || '). ' || p_name || '. *J of ' || p_brand || '*.' as apa, 'Ann Lee, Bo Ray. "' || p_name || '." ' || (1900 + p_size) || '.' as chicago from part
union all select p_partkey, 'b' || p_partkey, ' (n.d.). Untitled.', '. "Untitled." n.d..' from part""")
def _(spark, sf):
    body = F.concat(F.lit("@Article{key"), "p_partkey", F.lit(",\n title = {"), "p_name", F.lit("},\n author = {Ann Lee and Bo Ray},\n year = {"), F.col("p_size") + 1900,
                    F.lit("},\n journal = {J of "), "p_brand", F.lit("}\n}\n@book{b"), "p_partkey", F.lit(",\n note = {x}\n}\n"))
    rows = C.parse_bibtex(Tables(spark, sf).part.select("p_partkey", body.alias("text")), "p_partkey")
    return rows.select("p_partkey", "cite_key", C.citation_text("apa").alias("apa"), C.citation_text("chicago").alias("chicago"))


@family.add("c18_corpus_summary", f"""
with f as (select *, octet_length(encode(text)) as size, case source when 'src0' then 'Makefile' when 'src1' then 'notes.md' when 'src2' then 'Settings.py' else 'a.py' end as name from documents),
i as (select * from (values {', '.join(f"('{n}', '{w.lower()}')" for n, ws in lookups.FRAMEWORK_WORDS.items() for w in ws)}) v(framework, word)),
h as (select distinct framework from f, i where contains(lower(name), word) or (name like '%.py' and contains(lower(text), word)))
select count(*) as files, sum(size)::bigint as bytes, (select count(distinct case name when 'Makefile' then 1 when 'notes.md' then 2 else 3 end) from f)::bigint as languages,
  'python' as primary_language, 'make' as build_systems, (select string_agg(framework, ',' order by framework) from h) as frameworks from f""")
def _(spark, sf):
    path = F.when(F.col("source") == "src0", "Makefile").when(F.col("source") == "src1", "notes.md").when(F.col("source") == "src2", "Settings.py").otherwise("a.py")
    files = Tables(spark, sf).documents.select(path.alias("path"), "text", F.octet_length("text").cast("bigint").alias("size_bytes"))
    return C.corpus_summary(files).select("files", "bytes", "languages", "primary_language", "build_systems", "frameworks")


@family.add("c19_find_by_name", """
select distinct path from (select source || '/' || doc_id || '.txt' as path from documents where regexp_matches(doc_id || '.txt', '^1.*7\\.txt$')) order by path""")
def _(spark, sf):
    files = Tables(spark, sf).documents.select(F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"))
    return C.find_by_name(files, r"^1.*7\.txt$")


@family.add("c20_glossary", """
select doc_id, 0 as position, '[the plan](#glossary-plan)' as shown, true as known from documents union all select doc_id, 1, '*ghost*', false from documents""")
def _(spark, sf):
    pages = markdown_pages(Tables(spark, sf))
    glossary = Tables(spark, sf).nation.select(F.initcap("n_name").alias("term"), F.lit("a nation").alias("definition"))
    remote = spark.createDataFrame([("Plan", "what to do"), ("Peru", "far away")], "term string, definition string")
    merged = C.merge_reference_tables(glossary, remote, "term")
    return C.resolve_terms(C.mentions(pages, "doc_id", "term"), merged, "doc_id").select("doc_id", "position", "shown", "known")
