"""Findings on time and size: tables of one file are dealt out, texts become rows without being shuffled."""
import glob
import gzip
import math
import random

import pytest
from pyspark.ml import Pipeline, regression as MR
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import models as M, search as I
from millrace.plans import spread
from millrace.session import cut
from millrace.sources import readers


def _line(spark, n=400):
    """Rows as one file gives them: in one partition."""
    return spark.range(0, n, 1, 1).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 7 * 2.0 + F.col("id") % 3).alias("label"))


def _parts(spark, label):
    folder = max(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/{label}-*"), key=lambda p: glob.os.path.getmtime(p))
    return len(glob.glob(f"{folder}/part-*"))


def test_select_model_deals_one_file_out(spark):
    pool = [c for c in M.candidates("regression") if c.name == "ridge"]
    df = _line(spark)
    board, _, name = M.select_model(df.where("id % 5 > 0"), df.where("id % 5 = 0"), M.preprocess(["a"]), pool, "regression", folds=2)
    assert name == "ridge" and board.first().error is None
    assert _parts(spark, "train") > 1 and _parts(spark, "test") > 1


def _fitted(spark, problem, parts=3):
    """600 rows whose ids are no row numbers and mostly one chunk, and a model fitted on them."""
    rng = random.Random(11)
    rows = []
    for i in rng.sample(range(40_000), 550) + rng.sample(range(40_000, 10**7), 50):
        a, b, c = rng.choice([None, *map(float, range(9))]), rng.random() * 4, rng.random()
        value = (a or 0) * 3 - b + rng.random()
        rows.append((i, a, b, c, value if problem == "regression" else float(value > 6), f"x{i}"))
    df = cut(spark.createDataFrame(rows, "id long, a double, b double, c double, label double, note string").repartition(parts), "fitted")
    name = "ridge" if problem == "regression" else "decision_tree"
    estimator = next(c.estimator for c in M.candidates(problem) if c.name == name)
    return df, Pipeline(stages=[*M.preprocess(["a", "b", "c"]), estimator]).fit(df)


@pytest.mark.parametrize("problem", ["regression", "classification"])
@pytest.mark.parametrize("at_once", [2, 8])
def test_permutation_importance_pairs_key_order_with_hash_order(spark, monkeypatch, problem, at_once):
    monkeypatch.setattr(M, "AT_ONCE", at_once, raising=False)
    monkeypatch.setattr(M, "ROWS_PER_PIECE", 100, raising=False)
    df, model = _fitted(spark, problem)
    rows = df.withColumn("h", F.xxhash64("id")).collect()
    by_key, by_hash = sorted(rows, key=lambda r: r.id), sorted(rows, key=lambda r: r.h)
    judge, want = M.evaluator(problem), {}
    base = judge.evaluate(model.transform(df))
    for c in ("a", "b", "c"):
        mixed = [tuple(o[c] if x == c else r[x] for x in df.columns) for r, o in zip(by_key, by_hash, strict=True)]
        score = judge.evaluate(model.transform(spark.createDataFrame(mixed, df.schema)))
        want[c] = base - score if judge.isLargerBetter() else score - base
    found = M.permutation_importance(df, model, ["a", "b", "c"], problem, "id").collect()
    assert {r.feature for r in found} == set(want) and all(math.isclose(r.importance, want[r.feature], rel_tol=1e-9, abs_tol=1e-12) for r in found)
    assert found[0].importance == max(r.importance for r in found) > 0.1


def test_a_further_column_is_paired_with_the_others(spark):
    df, model = _fitted(spark, "regression")
    context, jobs = spark.sparkContext, {}
    for columns in (["a"], ["a", "b", "c"]):
        context.setJobGroup(f"columns {len(columns)}", "")
        M.permutation_importance(df, model, columns, "regression", "id")
        jobs[len(columns)] = len(context.statusTracker().getJobIdsForGroup(f"columns {len(columns)}"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[3] - jobs[1] <= 2 * 2  # the evaluator alone


def _docs(spark, rows):
    return spark.createDataFrame(rows, "id int, title string, headings array<string>, content string, section string, tags array<string>")


def test_postings_of_single_rows_are_not_shuffled(spark):
    docs = _docs(spark, [(1, "Red fox", ["part one"], "foxes run, a fox runs", "en", ["fox"]), (2, None, None, "", "en", []), (3, "x1", None, "fox", "en", None)])
    postings = I.build_postings(docs, with_positions=True)
    assert "Aggregate" not in postings._jdf.queryExecution().executedPlan().toString()
    flat = I.occurrences(docs).groupBy("term", "id").agg(
        F.count("*").alias("n"), F.min("position").alias("first_position"), F.max("doc_len").alias("doc_len"), F.sort_array(F.collect_list("position")).alias("positions"))
    assert sorted(map(tuple, postings.collect())) == sorted(map(tuple, flat.collect())) != []


def test_postings_of_repeated_and_null_keys_are_merged(spark):
    docs = _docs(spark, [(1, "a1", None, "fox fox den", "en", None), (1, "a1", None, "fox", "en", None), (None, "b1", None, "fox", "en", None), (None, "b1", None, "fox", "en", None),
                         (2, "b1", None, "owl", "en", None)])
    got = {(r.term, r.id): (r.n, r.first_position, r.doc_len, r.positions) for r in I.build_postings(docs, with_positions=True).collect()}
    assert got[("fox", 1)] == (3, 1, 4, [1, 1, 2]) and got[("fox", None)] == (2, 1, 2, [1, 1]) and got[("owl", 2)][0] == 1 and len(got) == 7


def test_ranked_search_drops_only_what_cannot_place(spark):
    docs = _docs(spark, [(i, "t1", None, " ".join(["fox"] * (i % 9 + 1) + [f"w{i}"] * (i % 5)), "en", None) for i in range(600)])
    postings = I.build_postings(docs)
    asked = spark.createDataFrame([(0, "fox"), (1, "w7 fox"), (2, "w9"), (3, "nothing here")], "query_id int, query string")
    stats = I.document_stats(docs, postings)
    all_of = I.ranked_search(postings, stats, asked, limit=1000).collect()
    best = {(r.query_id, r.position): (r.id, r.score) for r in all_of if r.position <= 5}
    few = I.ranked_search(postings, stats, asked, limit=5)
    assert {(r.query_id, r.position): (r.id, r.score) for r in few.collect()} == best and len(best) == 11


def test_query_rows_from_the_driver_shuffle_no_postings(spark):
    docs = _docs(spark, [(i, "t1", None, f"fox w{i}", "en", None) for i in range(50)])
    postings = cut(I.build_postings(docs), "index")
    asked = spark.createDataFrame([(0, "fox")], "query_id int, query string")
    found = I.ranked_search(postings, I.document_stats(docs, postings), asked, limit=5)
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_columns_of_tokens_do_not_carry_the_line(spark):
    lines = spark.createDataFrame([(1, 1, "Foo bar foo"), (1, 2, ""), (2, 1, None)], "doc_id int, line_no int, line string")
    tokens = I.line_tokens(lines, split_camel=False)
    assert sorted(map(tuple, tokens.collect())) == [(1, 1, 0, "foo", 0), (1, 1, 1, "bar", 4), (1, 1, 2, "foo", 0)]
    assert "instr(lower(line" not in tokens._jdf.queryExecution().optimizedPlan().toString()


def test_large_texts_are_cut_into_more_pieces_than_cores(spark, monkeypatch):
    monkeypatch.setattr(spread, "BYTES_PER_PIECE", 64)
    df = spark.range(0, 100, 1, 1).withColumn("text", F.lit("some words"))
    assert spread.pieces(df, "id").rdd.getNumPartitions() > spark.sparkContext.defaultParallelism


def test_stem_takes_the_first_rule_that_fits(spark):
    words = ["relational", "conditional", "agencies", "ies", "flies", "es", "passes", "agreed", "bed", "ended", "running", "ing", "x", "", "hopefulness", "s", "generalli"]

    def plain(word):
        return next((word[:len(word) - len(s)] + e for s, e in X.SUFFIX_RULES if word.endswith(s) and len(word) >= len(s) + 2), word)

    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", X.stem(F.col("w")).alias("s")).collect()
    assert all(r.s == plain(r.w) for r in got)


def test_gunzip_hands_bodies_on_one_by_one(spark):
    packed = [bytearray(gzip.compress(b"x" * 1000)) for _ in range(5)] + [bytearray(b"plain"), bytearray(gzip.compress(b"broken off")[:-9])]
    files = spark.createDataFrame([(str(i), c) for i, c in enumerate(packed)], "path string, content binary").coalesce(1)
    got = readers.gunzip_files(files)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    assert [(r.path, len(r.body), r.truncated) for r in got.collect()] == [*[(str(i), 1000, False) for i in range(5)], ("5", 5, False), ("6", 10, True)]


def _measured(spark, n=3000):
    """Prepared rows of a continuous feature, one of seven values and one without any difference."""
    rng = random.Random(5)
    rows = [(rng.random() * 10, float(rng.randrange(7)), 1.0) for _ in range(n)]
    df = spark.createDataFrame([(a, b, c, a * b + 3 * (a > 6) + rng.random()) for a, b, c in rows], "a double, b double, c double, label double").repartition(3)
    return cut(Pipeline(stages=M.preprocess(["a", "b", "c"])).fit(df).transform(df).select("features", "label"), "measured")


def _variant(name):
    e = next(c.estimator for c in M.candidates("regression") if c.name == name)
    e = e.copy({e.featureSubsetStrategy: "all"}) if name == "random_forest" else e
    return e.copy({e.maxDepth: 4}) if e.hasParam("maxDepth") else e.copy({e.regParam: 0.05})


@pytest.mark.parametrize("name", ["ridge", "lasso", "elasticnet", "decision_tree", "random_forest", "gbt"])
def test_condensed_rows_give_the_fit_of_all_rows(spark, name):
    from millrace.operators.condensed import Condensed

    ready, judge, e = _measured(spark), M.evaluator("regression"), _variant(name)
    condensed = Condensed(ready, folds=2)
    assert condensed.fits([e])
    model, plain = condensed.fit(e), e.fit(ready)
    found, want = (judge.evaluate(m.transform(ready)) for m in (model, plain))
    assert type(model) is type(plain) and math.isclose(found, want, rel_tol=1e-6 if hasattr(model, "coefficients") else 0.1)
    half = condensed.fit(e, 0)
    rows = condensed.flat.where("fold = 0").selectExpr("array(x0, x1, x2) x", "y label").select(array_to_vector("x").alias("features"), "label")
    assert math.isclose(condensed.score(judge, e, half, 0), judge.evaluate(half.transform(rows)), rel_tol=1e-2 if name not in ("ridge", "lasso", "elasticnet") else 1e-9)
    if hasattr(model, "coefficients"):
        assert all(math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-9) for a, b in zip(model.coefficients, plain.coefficients))
    condensed.close()


def test_fits_of_a_selection_do_not_pass_over_all_rows(spark, monkeypatch):
    read = []
    for c in (MR.LinearRegression, MR.DecisionTreeRegressor):
        monkeypatch.setattr(c, "_fit", lambda self, df, plain=c._fit: (read.append(df.count()), plain(self, df))[1])
    pool = [c for c in M.candidates("regression") if c.name in ("ridge", "decision_tree")]
    rows = spark.range(0, 4000, 1, 2).selectExpr("id", "cast(id % 50 as double) a", "cast(id % 7 as double) b", "cast(id * 31 % 1009 as double) label")
    board, best, _ = M.select_model(rows.where("id % 5 > 0"), rows.where("id % 5 = 0"), M.preprocess(["a", "b"]), pool, "regression", folds=2)
    assert [r.error for r in board.collect()] == [None, None] and best.transform(rows).where("prediction is null").count() == 0
    assert len(read) == 2 * (2 * 2 + 1) and max(read) <= 2 * 32 * 7


def test_rows_that_share_no_cells_are_fitted_as_they_are(spark):
    from millrace.operators.condensed import Condensed

    ready = _measured(spark, 60)
    condensed, e = Condensed(ready), _variant("decision_tree")
    assert not condensed.fits([e]) and not Condensed(ready.withColumn("label", F.lit(None).cast("double"))).fits([_variant("ridge")])
    assert condensed.fit(e).toDebugString.split("\n")[1:] == e.fit(ready).toDebugString.split("\n")[1:]


def test_gunzip_in_pieces_holds_no_whole_body(spark):
    rng = random.Random(3)
    lines = [bytes(rng.choices(b"abcdef ", k=rng.randrange(300))) for _ in range(20_000)]
    body = b"\n".join(lines) + b"\n"
    half = len(body) // 2
    packed = {"whole": gzip.compress(body), "members": gzip.compress(body[:half]) + gzip.compress(body[half:]) + b"rest", "plain": body, "broken": gzip.compress(body)[:-9],
              "zeros": gzip.compress(b"0" * (5 << 20)), "empty": b"", "wrong": b"\x1f\x8b\x08" + b"\x00" * 7 + b"\xff" * 100}
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in packed.items()], "path string, content binary").coalesce(1)
    got = {k: [] for k in packed}
    for r in readers.gunzip_files(files, piece=1 << 18).collect():
        got[r.path].append((r.body, r.truncated))
    for k in ("whole", "members", "plain", "broken"):
        bodies = [bytes(b) for b, _ in got[k]]
        found = b"".join(bodies)
        assert len(bodies) > 2 and max(map(len, bodies)) < 2 << 20 and all(b.endswith(b"\n") for b in bodies[:-1])
        assert found == body if k != "broken" else body.startswith(found) and len(found) > len(body) - 1000
        assert [t for _, t in got[k]] == [False] * (len(bodies) - 1) + [k == "broken"]
    assert [bytes(b) for b, _ in got["zeros"]] == [b"0" * (5 << 20)] and got["empty"] == [] and got["wrong"] == [(None, False)]
