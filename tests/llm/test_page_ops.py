"""Page text, URL filters, revisits and the pipeline: hand-made cases, brute force and awkward inputs."""
import math
import collections
import zlib

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from test_join_ops import brute_components
from test_text_ops import brute_counts, words
from millrace.llm import site_tree, urls, warc
from millrace.llm.queries import QUERIES, SQL, URL_RULES

PAGE = "page_id long, url string, html string, host string, text string, row string"


def pages(frame, htmls, url="http://a.example.org/{}"):
    return frame(PAGE, [(i, url.format(i) if url else None, h, "old", "old", "kept") for i, h in enumerate(htmls)])


def texts(df):
    return {r.page_id: r.text for r in df.collect()}


def test_article_without_its_surroundings(frame):
    html = (
        "<html><head><title>T</title><style>p{}</style><script>var t='</p><article>';</script></head><body><header>Site</header><nav><ul><li>Menu</li></ul></nav>"
        "<!-- note --><div class='ad'>Buy</div><div class='cookie notice'>We use cookies</div><article><h1>Head &amp; tail</h1><p>One\n  two<b>three</b> <a href=x>four</a><br>five"
        "<p>&eacute;&#233;&lt;b&gt;<form>Name <input></form><aside>See also</aside><ul><li>a<li>b</ul><table><tr><td>x<td>y</table><div id='comments'><p>First!</p></div></article>"
        "<section class=comments><p>me too</section><footer>&copy;</footer>"
    )
    assert texts(site_tree.extract(pages(frame, [html]))) == {0: "Head & tail\nOne twothree four five\néé<b>\na\nb\nx\ny"}


def test_style_tree_removes_what_a_host_repeats(frame):
    htmls = [f"<body><div class=x><p>Same line on all pages</p></div><div class=y><p>Story {i} is told here</p><p>And more of {i * i}</p></div></body>" for i in range(8)]
    got = texts(site_tree.extract(pages(frame, htmls)))
    assert got == {i: f"Story {i} is told here\nAnd more of {i * i}" for i in range(8)}
    tree = {r.path: r.importance for r in site_tree.style_tree(site_tree.parse(pages(frame, htmls).drop("text").withColumnRenamed("host", "old").selectExpr("page_id", "html", "'h' host"))).collect()}
    assert tree["/body/div.x"] < site_tree.THRESHOLD < tree["/body/div.y"]


def test_style_tree_judges_marked_articles(frame):
    """A share line inside every article goes; two pages with one article are too few to doubt the mark."""
    htmls = [f"<body><article><div class=x>Send this to a friend</div><p>Story {i} is told here</p></article></body>" for i in range(8)]
    assert texts(site_tree.extract(pages(frame, htmls))) == {i: f"Story {i} is told here" for i in range(8)}
    assert set(texts(site_tree.extract(pages(frame, ["<article><p>Same story</p></article>"] * 2))).values()) == {"Same story"}


def test_importance_by_hand(frame):
    """Four pages: a leaf with one text on all of them, one with a text on two and two unique ones."""
    htmls = [f"<body><p>all</p><h2>{t}</h2></body>" for t in ("two", "two", "c", "d")]
    rows = site_tree.parse(pages(frame, htmls).selectExpr("page_id", "html", "'h' host"))
    tree = {r.path: r.importance for r in site_tree.style_tree(rows).collect()}
    assert tree["/body/p"] == 0 and math.isclose(tree["/body/h2"], (2 * (1 - math.log(2, 4)) + 1 + 1) / 4)


def test_awkward_pages(frame):
    odd = [None, "", "no markup", "<p>open <b>tags <div>and more", "</div></p>stray", "<script>only", "<article></article>", "<p>" * 3000 + "deep", "<article>" + "<p>a &amp; b</p>" * 5000]
    got = texts(site_tree.extract(pages(frame, odd, None)))
    assert [got[i] for i in range(8)] == ["", "", "no markup", "open tags\nand more", "stray", "", "", "deep"] and got[8] == "\n".join(["a & b"] * 5000)
    out = site_tree.extract(pages(frame, ["<article>x"]))
    assert set(out.columns) == {"page_id", "url", "text", "row"} and out.first().row == "kept"
    assert site_tree.extract(pages(frame, [])).count() == 0


def test_rules_and_parts_of_urls(frame):
    cases = {
        "https://WWW.Example.ORG/es/1?x=/en/": ("www.example.org", "/es/1", "example.org/es/"), "http://example.org/en/15": ("example.org", "/en/15", "example.org/en/1"),
        "http://example.org/en/2": ("example.org", "/en/2", "org/"), "ftp://org": ("org", "", None), "http://notexample.org/es/1": ("notexample.org", "/es/1", "org/"),
        "http://x.com/fr/": ("x.com", "/fr/", "com/fr/"), "http://x.com#/fr/": ("x.com", "", None), "http://x.comm/fr/": ("x.comm", "/fr/", None), "plain/path": ("", "", None),
        None: ("", "", None), "": ("", "", None), "a://b://c/d": ("b:", "//c/d", None), "http://É.com/de/Ä": ("É.com", "/de/Ä", "com/de/"),
    }
    rows = frame("page_id long, url string, rule string, _row string", [(i, u, "old", "kept") for i, u in enumerate(cases)])
    for r in urls.filter_urls(rows, URL_RULES).collect():
        assert (r.host, r.path, r.rule) == cases[r.url] and r._row == "kept"
        assert r.rule is None or r.verdict == ("block" if r.rule in ("example.org/es/", "example.org/en/1", "com/de/") else "allow")


def test_character_models_against_brute_force(spark, data):
    """Witten-Bell models, mean difference and threshold computed letter by letter."""
    got = {r.page_id: r for r in urls.filter_urls(spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url"), URL_RULES).collect()}

    def codes(url):
        s = url.split("://", 1)[-1].lower()
        return [0, 0] + [urls.CLASSES.index("0" if c in "0123456789" else c if c in "abcdefghijklmnopqrstuvwxyz/.-" else "_") for c in s]

    count = {v: collections.Counter() for v in ("allow", "block")}
    ruled = {i: r for i, r in got.items() if r.rule}
    for r in ruled.values():
        if zlib.crc32(r.url.encode()) % 2 == 0:
            c = codes(r.url)
            for k in range(2, len(c)):
                for n in (0, 1, 2):
                    count[r.verdict][tuple(c[k - n : k + 1])] += 1

    def log_p(n_of, context, c):
        p = 1 / urls.N
        for n in range(len(context) + 1):
            before = context[len(context) - n :]
            total = sum(n_of[(*before, x)] for x in range(urls.N))
            kinds = sum(n_of[(*before, x)] > 0 for x in range(urls.N))
            if total:
                p = (n_of[(*before, c)] + kinds * p) / (total + kinds)
        return math.log(p)

    for i in sorted(got)[:25]:
        c = codes(got[i].url)
        want = sum(log_p(count["allow"], tuple(c[k - 2 : k]), c[k]) - log_p(count["block"], tuple(c[k - 2 : k]), c[k]) for k in range(2, len(c))) / (len(c) - 2)
        assert abs(want - got[i].score) < 1e-9
    for r in got.values():
        assert r.rule or r.verdict == ("allow" if r.score >= r.threshold else "block")


def test_url_filter_without_rows_or_labels(frame):
    assert urls.filter_urls(frame("page_id long, url string", []), URL_RULES).count() == 0
    got = urls.filter_urls(frame("page_id long, url string", [(1, "http://a.net/x"), (2, None), (3, "y" * 50_000)]), ()).collect()
    assert [(r.verdict, r.threshold, r.rule) for r in got] == [("allow", 0.0, None)] * 3


RECORD = "record_id long, kind string, url string, at long, etag string, last_modified string, headers map<string,string>, digest string, status string"


def test_revisits_by_hand(frame):
    u = "http://www.a.org/x/?utm_source=f&b=2&a=1#top"
    rows = [
        (1, "response", "https://a.org/x?a=1&b=2", 10, '"v1"', "mon", {"ETag": '"v1"', "Content-Length": "9", "X-Old": "1", "Date": "10"}, "d1", None),
        (2, "response", "https://a.org:443/x?b=2&a=1", 20, None, "tue", {"date": "20"}, "d2", None), (3, "response", "http://a.org/x?a=1&b=2", 20, 'W/"v3"', None, None, "d3", None),
        (4, "revisit", u, 10, '"v1"', None, {"DATE": "x"}, None, None), (5, "revisit", u, 11, 'W/"v1"', None, {"date": "11", "Content-Length": "0", "Age": "3"}, None, None),
        (6, "revisit", u, 21, '"v3"', "wed", None, None, None), (7, "revisit", u, 30, None, "tue", None, None, None), (8, "revisit", None, 30, None, None, None, None, None),
        (9, "revisit", u, None, '"v3"', None, None, None, None), (10, "response", None, 1, None, None, None, "d10", None), (11, "request", u, 5, None, None, None, None, None),
        (12, "response", "http://b.org", 1, None, None, {}, "d12", None), (13, "revisit", "http://b.org/", 5, None, None, {}, None, None), (13, "revisit", "http://b.org/", 5, None, None, {}, None, None),
    ]
    got = collections.defaultdict(list)
    for r in warc.resolve_revisits(frame(RECORD, rows), chunk_seconds=4).collect():
        got[r.record_id].append((r.status, r.source_id, r.digest, r.headers or {}))
    assert got == {
        4: [("orphan", None, None, {"date": "x"})], 5: [("resolved", 1, "d1", {"etag": '"v1"', "content-length": "9", "x-old": "1", "date": "11", "age": "3"})],
        6: [("resolved", 3, "d3", {})], 7: [("mismatch", None, None, {})], 8: [("orphan", None, None, {})], 9: [("orphan", None, None, {})],
        13: [("resolved", 12, "d12", {})] * 2,
    }
    assert warc.resolve_revisits(frame(RECORD, [])).count() == 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, data):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    df, rel = QUERIES[name](spark, data), con.sql(SQL[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    order = [rel.columns.index(c) for c in cols]
    assert sorted(repr(tuple(r)) for r in df.select(*cols).collect()) == sorted(repr(tuple(r[i] for i in order)) for r in rel.fetchall())


def test_registered_with_the_contract_columns(spark, data):
    queries = entry.queries()
    assert [n for n in queries if n.startswith("op")] == list(QUERIES) and len(QUERIES) == 10 and queries.keys() >= {"pipeline"}
    columns = {
        "op1_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op3_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
        "op5_main_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
        "op6_urls": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
        "op9_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    }
    for name, want in columns.items():
        assert want.items() <= dict(queries[name](spark, data).dtypes).items()


def test_pipeline_against_brute_force(spark):
    data = "/root/testdata/sf0.01"  # enough labels to learn from
    docs = spark.read.parquet(f"{data}/documents.parquet")
    stages, kept = dict(corpus_pipeline.STAGES), docs
    rows = {r.doc_id: r for r in docs.collect()}

    def good(t):
        n, chars, symbols, dup, repeat = brute_counts(t)
        return n >= 10 and 100 * repeat <= 20 * n and 10 * symbols <= n and 2 * dup <= sum(bool(words(x)) for x in t.split("\n")) and 2 * n <= chars <= 20 * n

    for name in ("quality_rules", "toxicity", "near_duplicates", "mixture"):
        before, kept = kept, stages[name](spark, kept, data).cache()
        assert kept.columns == docs.columns
        ids = [r.doc_id for r in kept.select("doc_id").collect()]
        was = [r.doc_id for r in before.select("doc_id").collect()]
        if name == "quality_rules":
            assert sorted(ids) == sorted(i for i in was if good(rows[i].text))
        if name == "toxicity":
            marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
            toxic, gone = {i for i, t in marks.items() if t} & set(was), (set(was) - set(ids)) & set(marks)
            assert gone and len(gone & toxic) >= 0.9 * len(gone) and len(toxic & set(ids)) <= 0.1 * len(toxic)
        if name == "near_duplicates":
            found = brute_components([(i, rows[i].text) for i in was], 5, 80)
            assert sorted(ids) == sorted(i for i, (_, c) in found.items() if i == c)
        if name == "mixture":
            assert max(collections.Counter(ids).values()) <= 3 and set(ids) < set(was)
    last = stages["bpe"](spark, kept, data)
    assert last.count() == kept.count() and {"doc_id", "n_tokens", "ids_sha256"} <= set(last.columns)


def test_pipeline_on_awkward_rows(spark, frame, data):
    """Nulls in every column, empty and very long texts, repeated rows and extra columns with names of all kinds."""
    good = "one two three four five six seven eight nine ten eleven twelve number "
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, kept int, row string, `a.b` int, tokens int, piece string"
    extra = ("s", 1, "r", 2, 3, "p")
    texts = [None, "", " \n ", good + "a", good + "a", "w%d " * 3, " ".join(f"w{k}" for k in range(60_000)), good + "b c d e f g h"]
    rows = [(i, t, None if i % 2 else "en", None if i % 3 else "src", None, *extra) for i, t in enumerate(texts)]
    docs = frame(schema, rows + rows[3:4] + [(None, good + "z", None, None, None, *[None] * 6)])
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, data).cache()
        if name != "bpe":
            assert docs.columns == before.columns
    assert {r.doc_id for r in docs.collect()} <= {3, 6, 7, None} and docs.count() > 0


def test_pipeline_without_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
    assert docs.count() == 0
