"""Small inputs with values worked out by hand."""
import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import predicates as P, text as X, values as V
from millrace.functions.ignore import ignored, read_rules
from millrace.operators import aggregates as A, anomaly as N, clean as E, features as G, kv, reshape as R, search as I, sets, state as S
from millrace.operators.forecast import seasonal_naive

DIRTY = [(1, "Alice", 25, 50000), (2, "Bob", None, 60000), (3, "Carol", 30, 70000), (1, "Alice", 25, 50000), (4, "Dan", 35, 80000)]


def column(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_dirty_rows(spark):
    df = spark.createDataFrame(DIRTY, "id int, name string, age int, income int")
    filled = E.fill_missing(df, "mean", ["age"])
    assert {r.id: r.age for r in filled.collect()}[2] == 28.75
    assert E.clean(df, E.CleanConfig(missing="mean")).count() == 4
    assert E.iqr_bounds(df, ["income"]).count() == 0  # fewer than 10 values
    assert {r["column"]: r.missing for r in E.missing_counts(df).collect()}["age"] == 1


def test_iqr_bounds_and_clip(spark):
    df = spark.createDataFrame([(float(v),) for v in [*range(1, 10), 100]], "v double")
    b = E.iqr_bounds(df, ["v"]).first()
    assert (b.low, b.high) == (-4.5, 15.5)
    assert max(column(E.outliers_iqr(df, ["v"], "clip"), "v")) == 15.5
    assert E.outliers_iqr(df, ["v"], "remove").count() == 9
    assert column(E.outliers_iqr(df, ["v"], "flag"), "v_outlier").count(True) == 1


SERIES = [10, 11, 9, 10, 12, 8, 10, 11, 9, 10, 10, 11, 9, 10, 30]


@pytest.fixture(scope="module")
def series(spark):
    return spark.createDataFrame([(i, "m", float(i), float(v)) for i, v in enumerate(SERIES)], "id int, m string, t double, v double")


def test_zscore(series):
    r = [x for x in N.zscore_anomalies(series, ["m"], "t", "v").collect() if x.id == 14][0]
    assert (r.win_n, r.severity, r.kind) == (15, "medium", "spike")
    assert r.win_mean == pytest.approx(11.3333, abs=1e-4) and r.win_std == pytest.approx(5.2599, abs=1e-4)
    assert r.deviation == pytest.approx(3.5489, abs=1e-4) and r.confidence == pytest.approx(0.55489, abs=1e-5)


def test_iqr_and_mad(series):
    r = [x for x in N.iqr_anomalies(series, ["m"], "t", "v", "id").collect() if x.id == 14][0]
    assert (r.win_q1, r.win_q3, r.deviation, r.severity) == (9.0, 11.0, 8.0, "critical")
    r = [x for x in N.mad_anomalies(series, ["m"], "t", "v", "id").collect() if x.id == 14][0]
    assert (r.win_median, r.win_mad, r.severity) == (10.0, 1.0, "critical") and r.deviation == pytest.approx(13.49)


def test_constant_series_has_no_anomaly(spark):
    df = spark.createDataFrame([(i, "m", float(i), 0.1) for i in range(40)], "id int, m string, t double, v double")
    assert N.detect(df, ["m"], "t", "v", "id").count() == 0


def test_trend_never_fires_at_three(spark):
    df = spark.createDataFrame([(i, "m", float(i), float(i >= 30) * 50 + i % 3) for i in range(60)], "id int, m string, t double, v double")
    assert N.trend_anomalies(df, ["m"], "t", "v", "id", threshold=3.0).count() == 0
    assert N.trend_anomalies(df, ["m"], "t", "v", "id").count() > 0


def test_cooldown_is_greedy(spark):
    df = spark.createDataFrame([("m", float(t)) for t in (0, 100, 299, 300, 350, 900, 1100, 1201)], "m string, t double")
    assert sorted(column(N.with_cooldown(df, ["m"], "t"), "t")) == [0, 300, 900, 1201]


def test_ema_and_failure_score(spark):
    df = spark.createDataFrame([("e", 1, 10.0), ("e", 2, 20.0)], "e string, t int, ms double")
    for chunk in (F.lit(0), F.col("t")):
        assert N.final_ema(df, ["e"], ["t"], chunk, "ms").first().ema == pytest.approx(8.1)
    seq = [1, 1, 0, 0, 0, 1, 1, 1, 0]  # 1 = failure
    df = spark.createDataFrame([("e", i, bool(b)) for i, b in enumerate(seq)], "e string, t int, bad boolean")
    for width in (1, 2, 4, 100):
        assert N.failure_score(df, ["e"], ["t"], F.floor(F.col("t") / width), F.col("bad")).first().failure_score == 2


def test_store_comparisons(spark):
    df = spark.createDataFrame([(None,)], "v int")
    tests = {("eq", None): True, ("ne", 1): True, ("nin", (1, 2)): False, ("in", (1, 2)): False, ("gt", 0): False, ("exists", False): True}
    for (op, val), want in tests.items():
        assert column(df, P.store_filter("v", op, val)) == [want], op


def test_aggregate_over_nothing(spark):
    df = spark.createDataFrame([], "v double")
    got = {op: column(kv.kv_aggregate(df, F.col("v"), op), "result")[0] for op in ("COUNT", "SUM", "AVG", "MIN")}
    assert got == {"COUNT": 0, "SUM": 0, "AVG": None, "MIN": None}
    nulls = spark.createDataFrame([(None,), (None,)], "v double")
    assert column(kv.kv_aggregate(nulls, F.col("v"), "AVG"), "result") == [0.0]


def test_limit_zero_means_all(spark):
    df = spark.range(5)
    assert kv.kv_page(df, [F.col("id")], 0, 0).count() == 5 and kv.kv_page(df, [F.col("id")], 1, 2).count() == 2


def test_topics(spark):
    df = spark.createDataFrame([("ml.train",), ("ml.train.done",), ("webhook.send",)], "t string")
    assert column(df, P.topic_matches(F.col("t"), "ml.*")) == [True, False, False]
    assert column(df, P.topic_matches(F.col("t"), "ml.**")) == [True, True, False]
    assert column(df, P.topic_matches(F.col("t"), "ml.**", loose_double_star=True)) == [True, True, True]


def test_conditions(spark):
    rows = ["12 >= 3", "9 > 10", "abc == 'abc'", "x != \"x\"", "10 < 9", "true", "maybe", "", "2 <= 10"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string").orderBy("i")
    assert column(df, P.condition_text(F.col("c"))) == [True, False, True, False, False, True, False, False, True]


def test_flatten(spark):
    df = spark.createDataFrame([(1, '{"a":{"b":1},"c":[5,{"d":2}],"e":{}}')], "id int, j string").withColumn("doc", F.parse_json("j"))
    assert {r.path: r.value for r in R.flatten_variant(df, "doc", ["id"]).collect()} == {"a.b": "1", "c.0": "5", "c.1.d": "2"}
    assert {r.path: r.value for r in R.flatten_variant(df, "doc", ["id"], max_depth=1).collect()}["a"] == '{"b":1}'


def test_defaults_keep_null(spark):
    df = spark.range(1).select(F.create_map(F.lit("x"), F.lit(None).cast("string")).alias("m"))
    assert column(df, R.with_defaults(F.col("m"), {"x": "1", "y": "2"})) == [{"x": None, "y": "2"}]


def test_unflatten_round_trip(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["a.b", "a.c.0", "a.c.2", "d"])
    row = R.unflatten_columns(df).first()
    assert row.a.b == 1 and row.a.c == [2, None, 3] and row.d == 4


def test_frequency_encoding(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id int, c string")
    assert [r.c__freq for r in G.frequency_encode(df, "c").orderBy("id").collect()] == [0.5, 0.5, 0.25, 0.25]


def test_histogram(spark):
    df = spark.createDataFrame([("k", 0.005), ("k", 0.2), ("k", 20.0)], "k string, v double")
    got = {r.le: r.n for r in A.histogram(df, ["k"], "v").collect()}
    assert (got["0.005"], got["0.25"], got["10"], got["+Inf"]) == (1, 2, 2, 3)


def test_versions(spark):
    df = spark.createDataFrame([("k", 1, "put", "a"), ("k", 2, "put", "b"), ("k", 3, "delete", None)], "key string, seq bigint, op string, value string")
    rows = S.history(df).orderBy("version").collect()
    assert [(r.version, r.operation) for r in rows] == [(1, "create"), (2, "update"), (3, "delete")]
    back = S.rollback(df, spark.createDataFrame([("k", 1)], "key string, version bigint"), F.col("seq") + 100)
    assert [r.value for r in S.current(back).collect()] == ["a"]
    assert S.rollback(df, spark.createDataFrame([("k", 3)], "key string, version bigint"), F.col("seq") + 100).count() == 3


def test_date_parts(spark):
    df = spark.range(1).select(F.lit("2026-12-01").cast("date").alias("d"))
    row = df.select(*[c.alias(n) for n, c in G.date_parts(F.col("d"), "d", weekend=True).items()]).first()
    assert (row.d_dayofweek, row.d_quarter, row.d_is_weekend) == (1, 4, 0)


def test_grams(spark):
    df = spark.range(1)
    a, b = X.ngrams(F.lit("spark")), X.ngrams(F.lit("sparks"))
    assert df.select(F.size(a), F.size(b), X.jaccard(a, b)).first()[:] == (7, 8, 0.5)


def test_maintainability(spark):
    score = V.maintainability(F.lit(20), F.lit(500))
    row = spark.range(1).select(score, V.letter_grade(score), V.maintainability(F.lit(3), F.lit(0))).first()
    assert row[0] == pytest.approx(38.41578, abs=1e-5) and row[1] == "D" and row[2] == 100.0


def test_ranked_search(spark):
    docs = spark.createDataFrame(
        [("d1", "spark", [], "spark engine", []), ("d2", "note", [], "spark", [])], "id string, title string, headings array<string>, content string, tags array<string>")
    postings = I.build_postings(docs)
    asked = spark.createDataFrame([(1, "spark")], "query_id int, query string")
    got = {r.id: r.score for r in I.ranked_search(postings, I.document_stats(docs, postings), asked).collect()}
    assert got == {"d1": pytest.approx(2.476703, abs=1e-6), "d2": pytest.approx(2.197802, abs=1e-6)}


def test_tag_positions_share_their_start(spark):
    docs = spark.createDataFrame([("d", "one two", ["three"], "four five", ["six seven", "eight"])], "id string, title string, headings array<string>, content string, tags array<string>")
    got = {r.term: r.position for r in I.occurrences(docs).collect()}
    assert got == {"one": 0, "two": 1, "three": 2, "four": 3, "five": 4, "six": 5, "seven": 6, "eight": 5}


def test_seasonal_naive(spark):
    df = spark.createDataFrame([("s", f"2024-01-0{i}", float(i)) for i in range(1, 7)], "s string, d string, y double").withColumn("d", F.col("d").cast("date"))
    rows = seasonal_naive(df, ["s"], "d", "y", 4, 3).orderBy("step").collect()
    assert [r.forecast for r in rows] == [4, 5, 6, 4] and str(rows[0]["at"])[:10] == "2024-01-07"
    assert [r.forecast for r in seasonal_naive(df, ["s"], "d", "y", 2, 9).orderBy("step").collect()] == [6, 6]


def test_ignore_rules(spark):
    rules = read_rules(["*.log", "!keep.log", "build/", "/top.txt", "a/b*"])
    paths = ["x.log", "d/x.log", "keep.log", "build/out.txt", "src/build/out.txt", "src/main.py", "top.txt", "a/bc", "z/a/bd", "buildx/f"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string").orderBy("i")
    assert column(df, ignored(F.col("p"), rules)) == [True, True, False, True, True, False, True, True, True, False]


def test_stemmer_matches_rules(spark):
    words = {"running": "runn", "relational": "relate", "cities": "city", "boxes": "boxe", "as": "as", "seed": "seed", "agreed": "agree", "sing": "sing", "spark": "spark"}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r.w: r.s for r in df.select("w", X.stem(F.col("w")).alias("s")).collect()}
    assert got == {w: X._stem_word(w) for w in words}
    assert got["relational"] == "relate" and got["cities"] == "city"


def test_smart_quotes_and_links_leave_code_alone(spark):
    text = 'say "hi" -- ok\n```\n"raw" http://a.b\n```\nsee http://a.b/c or me@x.org `"q"`'
    df = spark.createDataFrame([(text,)], "t string")
    linked, quoted = df.select(X.auto_link(F.col("t")), X.smart_quotes(F.col("t"))).first()
    assert "[http://a.b/c](http://a.b/c)" in linked and "[me@x.org](mailto:me@x.org)" in linked and '"raw" http://a.b\n' in linked
    assert "“hi” – ok" in quoted and '"raw"' in quoted and '`"q"`' in quoted


def test_limits_are_sequential(spark):
    times = [0.1, 0.2, 0.9, 5.0, 59.0, 60.5, 61.2, 61.3, 200.0]
    df = spark.createDataFrame([("c", t) for t in times], "c string, t double")
    out = {r.second: (r.accepted, r.rejected) for r in S.sliding_limit(df, "c", "t", 3, 60).collect()}
    assert out == {0: (3, 0), 5: (0, 1), 59: (0, 1), 60: (1, 0), 61: (2, 0), 200: (1, 0)}
    out = {r.second: (r.accepted, r.rejected) for r in S.token_bucket(df, "c", "t", 2, 0.1).collect()}
    assert out[0] == (2, 1) and out[5] == (0, 1) and out[59] == (1, 0) and out[200] == (1, 0)


def test_limits_over_one_long_run(spark):
    """100 000 busy seconds of one client without a pause, which must cost their number and not its square."""
    n = 100_000
    df = spark.range(n).select(F.lit("c").alias("c"), F.explode(F.sequence(F.lit(0), F.col("id") % 3)).alias("i"), F.col("id").cast("double").alias("t")).drop("i")
    df = df.unionByName(spark.createDataFrame([(None, 5.0), ("c", None), ("c", None)], "c string, t double"))
    sliding = {(r.c, r.second): (r.accepted, r.rejected) for r in S.sliding_limit(df, "c", "t", 4, 50).collect()}
    bucket = {(r.c, r.second): (r.accepted, r.rejected) for r in S.token_bucket(df, "c", "t", 3, 0.25).collect()}
    held, tokens, want_sliding, want_bucket = [], 3.0, {}, {}
    for t in range(n):
        asked = t % 3 + 1
        held = [h for h in held if h > t - 50]
        one = min(asked, 4 - len(held))
        held += [t] * one
        tokens = min(3.0, tokens + (0.25 if t else 0.0))
        two = min(asked, int(tokens))
        tokens -= two
        want_sliding["c", t], want_bucket["c", t] = (one, asked - one), (two, asked - two)
    for want in (want_sliding, want_bucket):
        want[None, 5], want["c", None] = (1, 0), (2, 0)
    assert sliding == want_sliding and bucket == want_bucket


def test_duplicate_members_one_row_each(spark):
    df = spark.createDataFrame([(f"p{i}", "x" * 200 if i % 2 else f"unique {i}" * 30) for i in range(20)], "path string, body string")
    out = sets.duplicate_members(df, F.col("body"), "path", F.length("body")).collect()
    assert len(out) == 10 and {r.copies for r in out} == {10} and {r.first_path for r in out} == {"p1"}


def test_quantile_normal_is_symmetric(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(101)], "i int, v double")
    s = {r.i: r.s for r in G.quantile_normal(df, "v", "s").collect()}
    assert s[50] == pytest.approx(0.0, abs=1e-9) and s[75] == pytest.approx(-s[25]) and s[75] == pytest.approx(0.6744898, abs=1e-6)
    assert not math.isinf(s[0])


def test_large_files_are_read_whole(spark, tmp_path):
    """A text above a million bytes, and a gzip file of two members above 64 MiB unpacked."""
    import gzip

    from millrace.sources import readers

    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "a.txt").write_text("x" * 1_000_001)
    assert [r.size_bytes for r in readers.read_text_corpus(spark, str(tmp_path / "texts")).collect()] == [1_000_001]
    assert readers.read_text_corpus(spark, str(tmp_path / "texts"), max_size=1_000_000).count() == 0
    (tmp_path / "packed").mkdir()
    (tmp_path / "packed" / "a.gz").write_bytes(gzip.compress(b"a" * (65 << 20), 1) + gzip.compress(b"b" * 10))
    files = spark.read.format("binaryFile").load(str(tmp_path / "packed"))
    read = lambda *limit: readers.gunzip_files(files, *limit).selectExpr("length(body) n", "truncated").first()
    assert tuple(read()) == ((65 << 20) + 10, False) and tuple(read(100)) == (100, True)
