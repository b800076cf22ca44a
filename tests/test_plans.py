"""The skew-safe building blocks against plain Python, with one key holding most of the rows."""
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.plans import ranks, runs, topn, windows
from millrace.plans.joins import one_row, salted_join


@pytest.fixture(scope="module")
def hot(spark):
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None])
        rows.append((i, key, float(rng.randrange(0, 40000)), float(rng.choice([1, 2, 2, 3, rng.random() * 9])), rng.random() < 0.4))
    pdf = pd.DataFrame(rows, columns=["id", "key", "t", "x", "bad"])
    return spark.createDataFrame(rows, "id bigint, key string, t double, x double, bad boolean").cache(), pdf


def groups(pdf):
    return {k if isinstance(k, str) else None: g for k, g in pdf.groupby("key", dropna=False)}


def test_order_stats_with_null_key(hot):
    df, pdf = hot
    got = {r.key: r for r in ranks.index_quantiles(df, "x", {"q1": 0.25, "q3": 0.75, "p99": 0.99}, ["key"]).collect()}
    for key, g in groups(pdf).items():
        v = sorted(g.x)
        n = len(v)
        assert (got[key].n, got[key].q1, got[key].q3, got[key].p99) == (n, v[int(n * 0.25)], v[int(n * 0.75)], v[int(n * 0.99)])


def test_index_and_linear_quantiles_differ(spark):
    df = spark.createDataFrame([(float(v),) for v in [*range(1, 10), 100]], "v double")
    r = ranks.index_quantiles(df, "v", {"q1": 0.25, "q3": 0.75}).first()
    assert (r.n, r.q1, r.q3) == (10, 3.0, 8.0)
    r = ranks.linear_quantiles(df, "v", {"q1": 0.25, "mid": 0.5, "q3": 0.75}).first()
    assert (r.q1, r.mid, r.q3) == (3.25, 5.5, 7.75)


def test_median_matches_numpy_on_many_values(spark):
    rng = np.random.default_rng(3)
    values = rng.lognormal(size=5001).tolist()
    df = spark.createDataFrame([(v,) for v in values], "v double")
    r = ranks.linear_quantiles(df, "v", {"a": 0.5, "b": 0.9, "c": 0.001}).first()
    assert [r.a, r.b, r.c] == pytest.approx(np.quantile(values, [0.5, 0.9, 0.001]).tolist())


def test_running_sums_and_numbering(hot):
    df, pdf = hot
    out = runs.running_sums(df, ["key"], ["t", "id"], F.floor(F.col("t") / 1000), {"s": F.col("x"), "n": F.lit(1)}).toPandas()
    ref = pdf.fillna({"key": "?"}).sort_values(["key", "t", "id"])
    ref["s"], ref["n"] = ref.groupby("key").x.cumsum(), ref.groupby("key").cumcount() + 1
    both = out.merge(ref, on="id", suffixes=("", "_r"))
    assert len(both) == len(ref)
    assert (both.n == both.n_r).all() and np.allclose(both.s, both.s_r)


def test_numbers_of_a_whole_table_run_over_all_tasks(spark):
    rng = random.Random(5)
    keys = [rng.choice([None, 7, rng.randrange(-5000, 5000), rng.randrange(0, 40)]) for _ in range(3000)]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, i int").repartition(5)
    numbered = runs.in_order(df, "k", F.floor(F.col("k") / 10), 6)
    got = sorted(map(tuple, numbered.select("n", "k").collect()))
    assert [n for n, _ in got] == list(range(1, 3001))
    assert [k for _, k in got] == sorted(keys, key=lambda k: (k is not None, k))
    assert numbered.columns == ["k", "i", "n"] and len(set(r.i for r in numbered.collect())) == 3000
    assert numbered.select(F.spark_partition_id().alias("p")).distinct().count() > 3
    assert runs.in_order(df.where("false"), "k", F.floor(F.col("k") / 10), 6).count() == 0


def test_neighbours_cross_chunks(hot):
    df, pdf = hot
    out = runs.neighbours(df, ["key"], ["t", "id"], F.floor(F.col("t") / 500), {"p": "id"}, {"f": "id"}).toPandas().set_index("id")
    ref = pdf.fillna({"key": "?"}).sort_values(["key", "t", "id"]).set_index("id")
    assert len(out) == len(pdf)
    ref["i"] = ref.index
    p, f = ref.groupby("key").i.shift(1), ref.groupby("key").i.shift(-1)
    assert out.p.reindex(ref.index).fillna(-1).tolist() == p.fillna(-1).tolist()
    assert out.f.reindex(ref.index).fillna(-1).tolist() == f.fillna(-1).tolist()


def test_last_known_carries_over_empty_chunks(spark):
    rows = [(1, 0.0, 5), (2, 10.0, None), (3, 5000.0, None), (4, 9000.0, 7), (5, 9001.0, None)]
    df = spark.createDataFrame(rows, "id int, t double, v int")
    out = runs.last_known(df, [], ["t"], F.floor(F.col("t") / 100), {"f": "v"}).orderBy("id").collect()
    assert [r.f for r in out] == [5, 5, 5, 7, 7]


def test_sliding_windows_match_brute_force(hot):
    df, pdf = hot
    rows = df
    got = windows.sliding_moments(rows, ["key"], "t", "x", 700).toPandas().set_index("id")
    sums = windows.sliding_sums(rows, ["key"], "t", 700, {"s": F.when(F.col("bad"), 1).otherwise(0)}).toPandas().set_index("id")
    for key, g in groups(pdf).items():
        t, x, bad = g.t.to_numpy(), g.x.to_numpy(), g.bad.to_numpy()
        for i, row in enumerate(g.itertuples()):
            w = (t >= t[i] - 700) & (t <= t[i])
            assert got.win_n[row.id] == w.sum() and sums.s[row.id] == bad[w].sum()
            assert got.win_mean[row.id] == pytest.approx(x[w].mean())
            if w.sum() > 1:
                assert got.win_std[row.id] == pytest.approx(x[w].std(ddof=1), abs=1e-9)


def test_top_and_first_per_key(hot):
    df, pdf = hot
    top = topn.top_per_key(df, ["key"], [F.desc("x"), F.asc("id")], 7, ["id"]).toPandas()
    for key, g in groups(pdf).items():
        want = g.sort_values(["x", "id"], ascending=[False, True]).id.head(7).tolist()
        have = top[top.key.isna()] if key is None else top[top.key == key]
        assert sorted(have.id) == sorted(want)
    first = {r.key: r.id for r in topn.first_per_key(df, ["key"], ["t", "id"]).collect()}
    assert first["hot"] == pdf[pdf.key == "hot"].sort_values(["t", "id"]).id.iloc[0]


def test_salted_join_keeps_every_row_once(hot, spark):
    df, pdf = hot
    small = spark.createDataFrame([("hot", 1), ("a", 2)], "key string, v int")
    assert salted_join(df, small, ["key"], ["id"]).count() == pdf.key.isin(["hot", "a"]).sum()
    assert salted_join(df, small, ["key"], ["id"], "left").count() == len(pdf)
    assert salted_join(df, small, ["key"], ["id"], "left_anti").count() == (~pdf.key.isin(["hot", "a"])).sum()


def test_salted_copies_are_not_broadcast_as_one(spark):
    """200 000 keys of 8 bytes lie below Spark's limit of 10 MB, their sixteen copies do not."""
    big, small = spark.range(1_000_000), spark.range(200_000)
    out = salted_join(big, small, ["id"], ["id"], "left_anti")
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 800_000


def test_one_row_is_no_join(hot):
    df, _ = hot
    out = df.select((F.col("x") - one_row(df.agg(F.avg("x").alias("m")))["m"]).alias("d"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Subquery" in plan


def test_null_keys_are_groups_everywhere(hot):
    df, pdf = hot
    from millrace.operators.aggregates import stats_bundle
    from millrace.operators.anomaly import half_means, streaks

    bundle = {r.key: r for r in stats_bundle(df, ["key"], "x").collect()}
    none = pdf[pdf.key.isna()].x
    assert bundle[None]["count"] == len(none) and bundle[None].median == pytest.approx(none.median())
    assert bundle[None].mad == pytest.approx((none - none.median()).abs().median())
    assert half_means(df, ["key"], "t", "id", "x", 500).count() == len(pdf)
    assert streaks(df, ["key"], ["t", "id"], F.floor(F.col("t") / 900), F.col("bad")).count() == len(pdf)


def test_one_hot_window_is_spread_over_tasks(spark):
    """All rows of a metric lie inside one window; its cells still go to many tasks, and instants are counted once."""
    rng = random.Random(3)
    times = [rng.randrange(0, 900_000) / 1000 for _ in range(20_000)]
    df = spark.createDataFrame([(i, "hot", t, float(i % 7)) for i, t in enumerate(times)], "id int, key string, t double, x double")
    events = windows._events(windows._instants(df, ["key"], "t", {"n": F.count("*")}), 1000.0).where("_asks = 0")
    per_cell = [r["count"] for r in events.groupBy("_k", "_block", "_cell").count().collect()]
    assert len(per_cell) > 50 and max(per_cell) < 2 * sorted(per_cell)[len(per_cell) // 2]
    got = windows.sliding_moments(df, ["key"], "t", "x", 1000.0).agg(F.max("win_n"), F.sum("win_n")).first()
    order = sorted(times)
    assert got[0] == 20_000 and got[1] == sum(np.searchsorted(order, order, "right"))


def test_moments_far_from_zero_and_without_spread(spark):
    rows = [(i, float(i), 1e9 + i % 3) for i in range(400)] + [(1000 + i, 5000.0 + i, 0.1) for i in range(300)]
    got = {r.id: r for r in windows.sliding_moments(spark.createDataFrame(rows, "id int, t double, x double"), [], "t", "x", 50).collect()}
    for i in (3, 77, 399):
        window = [1e9 + k % 3 for k in range(max(0, i - 50), i + 1)]
        assert got[i].win_std == pytest.approx(np.std(window, ddof=1), rel=1e-9)
    assert all(got[1000 + i].win_std == 0 for i in range(1, 300)) and got[1000].win_std is None


def test_halves_match_brute_force(hot):
    from millrace.operators.anomaly import half_means

    df, pdf = hot
    got = half_means(df, ["key"], "t", "id", "x", 700).toPandas().set_index("id")
    assert len(got) == len(pdf)
    for key, g in groups(pdf).items():
        g = g.sort_values(["t", "id"])
        t, x = g.t.to_numpy(), g.x.to_numpy()
        for i, row in enumerate(g.itertuples()):
            w = x[(t >= t[i] - 700) & (t <= t[i])]
            assert got.second_mean[row.id] == pytest.approx(w[len(w) // 2 :].mean())
            if len(w) > 1:
                assert got.first_mean[row.id] == pytest.approx(w[: len(w) // 2].mean())


def test_wavelet_windows_match_brute_force():
    from millrace.plans.wavelet import sliding_stats

    rng = np.random.default_rng(1)
    for n, width in ((1, 5), (2, 5), (40, 3), (300, 1e9), (500, 20)):
        for values in (rng.normal(size=n), rng.integers(0, 4, n).astype(float), np.zeros(n)):
            times = np.sort(rng.integers(0, n, n)).astype(float)
            got = sliding_stats(times, values, width, np.arange(n))
            for i in range(n):
                w = np.sort(values[(times >= times[i] - width) & (times <= times[i])])
                k, mid = len(w), np.median(w)
                assert tuple(got[i]) == (k, w[k // 4], w[3 * k // 4], mid, np.median(np.abs(w - mid)))


def test_cooldown_on_a_key_that_is_never_quiet(spark, monkeypatch):
    from millrace.plans import silences

    monkeypatch.setattr(silences, "FAN", 3)  # a tree of several levels
    rng, rows = random.Random(8), []
    for key in ("busy", "rare", None):
        t = 0.0
        for _ in range(900 if key == "busy" else 40):
            t += rng.choice([0, 0.5, 1, 3]) if key == "busy" else rng.choice([0, 5, 40, 200])
            rows.append((key, t))
    got = silences.firings(spark.createDataFrame([*rows, ("busy", None)], "key string, t double"), ["key"], "t", 7.0, F.floor(F.col("_at") / 30)).collect()
    want = []
    for key in ("busy", "rare", None):
        last = float("-inf")
        for t in sorted({t for k, t in rows if k == key}):
            if t >= last + 7:
                want.append((key, t))
                last = t
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert silences.firings(spark.createDataFrame([], "key string, t double"), ["key"], "t", 7.0, F.floor(F.col("_at") / 30)).count() == 0


def test_pivots_are_refined_until_intervals_are_small(spark, monkeypatch):
    """Several keys and ranks at once: every round starts from the rows of the intervals that hold a rank, and from no others."""
    rng = random.Random(6)
    rows = [("hot", float(rng.randrange(10**6))) for _ in range(9000)] + [("small", float(i % 9)) for i in range(50)] + [(None, 4.0)]
    df = spark.createDataFrame(rows, "key string, x double")
    counts = df.groupBy(F.struct("key").alias("_k"), F.col("x").alias("_v")).agg(F.count("*").alias("_c")).withColumn("_iv", F.lit(0).cast("long"))
    wants = counts.groupBy("_k").agg(F.sum("_c").alias("n")).select(
        "_k", F.lit(0).cast("long").alias("_iv"), F.explode(F.array(F.struct(F.lit("a").alias("_rank"), F.lit(1).cast("long").alias("_want")), F.struct(F.lit("b").alias("_rank"), F.ceil(F.col("n") / 2).alias("_want"))))
    ).select("_k", "_iv", "col.*")
    left, _, sizes = ranks.refined(counts, wants, leaf=20, buckets=8)
    assert len(sizes) >= 4 and all(b < a for a, b in zip(sizes, sizes[1:])) and sizes[-1] < 100
    assert left.groupBy("_k", "_iv").count().agg(F.max("count")).first()[0] <= 20
    monkeypatch.setattr(ranks, "LEAF", 20)
    got = {r.key: r for r in ranks.index_quantiles(df, "x", {"low": 0.0, "q1": 0.25, "p99": 0.99}, ["key"]).collect()}
    for key in ("hot", "small", None):
        own = sorted(x for k, x in rows if k == key)
        assert got[key].n == len(own) and [got[key].low, got[key].q1, got[key].p99] == [own[0], own[len(own) // 4], own[int(len(own) * 0.99)]]
    assert ranks.index_quantiles(df.where("false"), "x", {"q": 0.5}).count() == 0
    ordered = {r.x: r["rank"] for r in ranks.value_ranks(df, "x", descending=False).collect()}
    every = sorted(x for _, x in rows)
    assert all(ordered[x] == every.index(x) + 1 for x in every[:: 500])
