"""The registered queries of this subpackage, each over its whole table, and their DuckDB SQL where SQL can say it."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm import bpe, embeddings, jaccard, language, licenses, mixing, prefix_trie, quality, site_tree, toxicity, urls, warc, whitening

WORD = r"[^\x20\x09-\x0D]+"
TOXIC_AT = 0.7


def vocabulary() -> str:
    """The public vocabulary file; every executor has it at this path."""
    from public_tokenizers import path

    return path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by a model of the labelled rows whose crc32(doc_id) mod 3 is not 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held = language.crc_bucket(F.col("doc_id"), 3) == 1
    model = toxicity.fit_from(docs.where(~held), labels.where(~held))
    scored = toxicity.score(docs, model, offending=TOXIC_AT)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))


def op2_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the golden-ratio mix of all sources takes of every document."""
    return mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")).drop("source")


OP2_SQL = f"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as size from documents),
per as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as n from sized group by source),
caps as (
  select *, ((n - 1) % 3 + 1)::double as weight, 3.0::double * source_size as cap from per),
running as (
  select *, sum(source_size) over ()::double as total,
    coalesce(sum(cap) over (order by cap / weight, n rows between unbounded preceding and 1 preceding), 0)::double as capped,
    sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, n rows between unbounded preceding and 1 preceding), 0) as left_weight
  from caps),
levels as (
  select *, max(case when cap / weight >= (total - capped) / left_weight then (total - capped) / left_weight end) over () as level from running),
goals as (
  select source, source_size, least(cap, coalesce(level * weight, cap)) as target from levels),
laid as (
  select s.doc_id, s.size, g.source_size, g.target, round(g.target)::bigint as goal,
    sum(s.size) over (partition by s.source order by md5('mix:' || coalesce(s.doc_id::varchar, '')), s.doc_id, s.size rows unbounded preceding) - s.size as start
  from sized s join goals g on s.source is not distinct from g.source)
select doc_id, size, source_size, target,
  (select sum(greatest(0, least(start + e * source_size + size, goal) - (start + e * source_size))) from range(3) r(e))::bigint as taken
from laid
"""


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and of the decoded text of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return bpe.digests(bpe.encode_decode(docs, vocabulary())).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of 4-word shingle sets at a Jaccard similarity of 0.85 or more."""
    return jaccard.similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP4_SQL = rf"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as words from documents),
shingles as (
  select distinct doc_id, array_to_string(words[i:i + 3], ' ') as g from w, unnest(range(1, greatest(len(words) - 2, 2))) u(i) where len(words) > 0),
sizes as (
  select doc_id, count(*)::bigint as n from shingles group by doc_id),
common as (
  select a.doc_id as a, b.doc_id as b, count(*) as shared from shingles a join shingles b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (
  select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * shared >= 85 * (x.n + y.n - shared)),
ways as (
  select a, b from links union all select b, a from links),
reach as (
  select doc_id as a, doc_id as b from documents union select r.a, w.b from reach r join ways w on w.a = r.b)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, c.component_id
from documents d left join sizes s on s.doc_id = d.doc_id
join (select a, min(b) as component_id from reach group by a) c on c.a = d.doc_id
"""


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return site_tree.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


URL_RULES = (
    urls.Rule("allow", "org", "/"),
    urls.Rule("block", "example.org", "/es/"),
    urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"),
    urls.Rule("block", "com", "/de/"),
)


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict for the url of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return urls.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and representative of every vector at a cosine of 0.9 or more."""
    found = embeddings.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


OP7_SQL = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select x.vec_id as a, y.vec_id as b from v x join v y on x.vec_id <> y.vec_id and len(x.e) = len(y.e) where list_cosine_similarity(x.e, y.e) >= 0.9),
reach as (
  select vec_id as a, vec_id as b from embeddings union select r.a, l.b from reach r join links l on l.a = r.b)
select e.vec_id, coalesce(n.n, 0)::bigint as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e left join (select a, count(*) as n from links group by a) n on n.a = e.vec_id
join (select a, min(b) as component_id from reach group by a) c on c.a = e.vec_id
"""


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the short-circuit cascade for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    steps = quality.plan_cascade(docs)
    judged = quality.quality_cascade(docs, steps, always=quality.REPORTED)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judged.select("doc_id", *quality.REPORTED, failed.alias("base_failed"), "kept")


OP8_SQL = rf"""
with w as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{WORD}') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) as lines from documents),
windows as (
  select doc_id, i, array_to_string(words[i:i + 4], ' ') as g from w, unnest(range(1, len(words) - 3)) u(i)),
again as (
  select doc_id, i from windows qualify count(*) over (partition by doc_id, g) > 1),
covered as (
  select doc_id, count(distinct i + k) as n from again, range(5) r(k) group by doc_id),
counts as (
  select w.doc_id, len(words)::bigint as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, len(lines) as n_lines,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words
  from w left join covered c on c.doc_id = w.doc_id),
judged as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from counts)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 10 * n_symbols > n_words or 2 * n_dup_lines > n_lines or not word_chars between 2 * n_words and 20 * n_words) as kept
from judged
"""


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by models of the rows whose crc32(doc_id) mod 4 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = language.crc_bucket(F.col("doc_id"), 4) == 2
    model = language.learn(docs.where(~held))
    return language.identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit among the archive records of all pages, with what it resolves to."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    found = warc.resolve_revisits(warc.records_of(pages))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return found.select(F.col("record_id").alias("revisit_id"), "canonical_url", "status", "source_id", "digest", F.array_join(lines, "\n").alias("headers"))


OP10_SQL = r"""
with p as (
  select page_id, url, md5(coalesce(html, '')) as digest, length(coalesce(html, '')) as n, page_id % 3 > 0 as tagged from pages),
v as (
  select *, case when tagged then '"' || digest[1:16] || '"' end as tag, case when not tagged then 'day ' || (page_id % 7) end as day,
    regexp_replace(regexp_replace(trim(url), '(?s)#.*$', ''), '^[A-Za-z][A-Za-z0-9+.\-]*://', '') as rest from p),
c as (
  select *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '')
    || regexp_replace(regexp_extract(rest, '(?s)^[^/?]*([^?]*)', 1), '/+$', '') as place,
    list_sort(list_filter(string_split(regexp_extract(rest, '(?s)^[^?]*\?(.*)$', 1), '&'),
      lambda x: x <> '' and not regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) as params from v),
r as (
  select *, place || case when len(params) > 0 then '?' || array_to_string(params, '&') else '' end as canonical_url,
    case when tagged then 'etag: ' || case when page_id % 5 = 0 then 'W/' else '' end || tag else 'last-modified: ' || day end as shown from c),
again as (
  select *, page_id + 1 + page_id * 7919 % 1000 as moment from r),
seen as (
  select a.page_id, a.canonical_url, a.moment, a.shown, a.tagged, a.tag, a.day, f.page_id as source, f.digest as f_digest, f.n as f_n,
    f.shown as f_shown, f.tagged as f_tagged, f.tag as f_tag, f.day as f_day
  from again a asof left join r f on a.canonical_url = f.canonical_url and a.moment > f.page_id),
judged as (
  select *, case when source is null then 'orphan' when tagged and f_tagged and tag = f_tag then 'resolved'
    when not tagged and not f_tagged and day = f_day then 'resolved' else 'mismatch' end as status from seen)
select page_id * 2 + 1 as revisit_id, canonical_url, status, case when status = 'resolved' then source * 2 end as source_id,
  case when status = 'resolved' then f_digest end as digest,
  array_to_string(list_sort(case when status = 'resolved'
    then ['age: 0', 'content-length: ' || f_n, 'content-type: text/html', 'date: ' || moment, shown]
    else ['age: 0', 'content-length: 0', 'date: ' || moment, shown] end), chr(10)) as headers
from judged
"""


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    turns, turnless = prefix_trie.rebuilt(prefix_trie.ordered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    trie = prefix_trie.build(turns, turnless, F.col("conv") - F.col("conv") % 20)
    nodes = trie.nodes.join(prefix_trie.end_digests(trie.ends), prefix_trie.NODE, "left")
    return nodes.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


OP11_SQL = rf"""
with crc as (
  select list(list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t from range(256) r(i)),
turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as p
  from conversations where conv_id is not null),
own as (
  select conv_id, list({{'role': role, 'text': text}} order by p) as turns from turns group by conv_id),
hashed as (
  select conv_id, turns, conv_id - conv_id % 20 as base,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 4 as h
  from own, crc),
full_ones as (
  select a.conv_id, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) as turns from hashed a left join own b on b.conv_id = a.base),
members as (
  select conv_id, turns, d, sha256(array_to_string(list_transform(turns[1:d], lambda x: length(x.role) || ':' || length(x.text) || ':' || x.role || x.text), ';')) as node,
    case when d > 0 then sha256(array_to_string(list_transform(turns[1:d - 1], lambda x: length(x.role) || ':' || length(x.text) || ':' || x.role || x.text), ';')) end as parent
  from full_ones, unnest(range(len(turns) + 1)) u(d)),
nodes as (
  select d, node, min(parent) as parent, min(conv_id) as conv_id, count(*) as n,
    max(case when d > 0 then len(regexp_extract_all(turns[d].text, '{WORD}')) else 0 end) as words,
    string_agg(conv_id::varchar, ',' order by conv_id) filter (len(turns) = d) as ends
  from members group by d, node),
sons as (
  select d - 1 as d, parent as node, count(*) as n_children from nodes where d > 0 group by all),
valued as (
  select n.*, coalesce(s.n_children, 0) as n_children from nodes n left join sons s on s.d = n.d and s.node = n.node),
below as (
  select m.d, m.node, count(*) filter (v.n_children = 0) as n_leaves, sum((v.n - 1) * v.words) as saved_tokens
  from valued v join members o on o.conv_id = v.conv_id and o.d = v.d join members m on m.conv_id = o.conv_id and m.d <= v.d group by m.d, m.node)
select v.conv_id, v.d::bigint as depth, p.conv_id as parent_conv_id, v.n::bigint as n_convs, v.n_children::bigint as n_children, b.n_leaves::bigint as n_leaves,
  b.saved_tokens::bigint as saved_tokens, sha256(coalesce(v.ends, '')) as ends_sha256
from valued v join below b on b.d = v.d and b.node = v.node left join nodes p on p.d = v.d - 1 and p.node = v.parent
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every usable vector."""
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and labels of every document."""
    found = licenses.find_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined("base_labels"), joined("labels"), "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_mixture": op2_mixture,
    "op3_bpe": op3_bpe,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_main_text": op5_main_text,
    "op6_urls": op6_urls,
    "op7_embeddings": op7_embeddings,
    "op8_quality": op8_quality,
    "op9_language": op9_language,
    "op10_revisits": op10_revisits,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_whitening": op12_whitening,
    "op13_licenses": op13_licenses,
}
SQL: dict[str, str] = {"op2_mixture": OP2_SQL, "op4_jaccard_join": OP4_SQL, "op7_embeddings": OP7_SQL, "op8_quality": OP8_SQL, "op10_revisits": OP10_SQL, "op11_prefix_trie": OP11_SQL}
