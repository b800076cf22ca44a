"""Registered queries against their SQL twins. MILLRACE_ALL=1 runs all of them; by default a cross-section."""
import os

import duckdb
import pytest

import __spark_entry__ as entry
from millrace import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CROSS_SECTION = (
    "p01_chart_segment_month f06_nested_path f16_row_level_security p03_extract_rows p08_defaults j04_resolve_references j09_event_subscriptions "
    "j15_as_of_join a13_index_quantile a15_similar_events t07_value_counts_top w03_half_means w06_previous_next d02_duplicate_members x09_strip_markdown "
    "x22_embedded_files q01_profile q11_record_rules e03_fill_missing e12_scale m02_stratified_split m12_seasonal_naive i05_ranked_search i06_line_search "
    "c06_rule_scan c16_resolved_text n05_combined n11_outages v02_history k05_upsert_sink r08_windows_stream s03_read_any u03_steps"
).split()
SQL = entry.oracle_sql()
NAMES = sorted(n for n in SQL if n in catalog.all_queries()) if os.environ.get("MILLRACE_ALL") else CROSS_SECTION


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


def test_registry_is_consistent():
    queries = entry.queries()
    assert set(SQL) <= set(queries) and len(queries) > 200
    assert all(n[0] in "abcdefijkmnpqrstuvwx" and n[1:3].isdigit() for n in catalog.all_queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(name, spark, con, data):
    df = entry.queries()[name](spark, data)
    cols = sorted(df.columns)
    rel = con.sql(SQL[name])
    assert sorted(rel.columns) == cols
    order = [rel.columns.index(c) for c in cols]
    plain = lambda v: v + 0.0 if isinstance(v, float) else v
    got = sorted(repr(tuple(plain(v) for v in r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    want = sorted(repr(tuple(plain(r[i]) for i in order)) for r in rel.fetchall())
    assert got == want


def test_model_queries_try_every_candidate(spark, data):
    from millrace.operators import models

    every = {c.name for c in models.candidates("regression")}
    for name in ("m03_candidates", "m04_model_selection"):
        assert {r.model for r in entry.queries()[name](spark, data).collect()} == every
