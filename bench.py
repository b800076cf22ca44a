"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The session is warmed first; each query runs three times through the noop sink and the median counts.
"""
import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from millrace import catalog  # noqa: E402
from millrace.session import local_session  # noqa: E402

# Query and the table whose rows it is rated by.
HEADLINE = {
    "p01_chart_segment_month": "orders",
    "f16_row_level_security": "customer",
    "p04_flatten": "events",
    "a10_histogram": "events",
    "a12_stats_bundle": "events",
    "a19_box_plot": "lineitem",
    "a20_cube": "lineitem",
    "d01_deduplicate": "documents",
    "q01_profile": "part",
    "q03_completeness": "events",
    "q07_validate_rows": "events",
    "e03_fill_missing": "events",
    "e04_outliers_iqr": "events",
    "e09_frequency_encode": "events",
    "e17_clean_all": "orders",
    "n01_zscore": "events",
    "n10_endpoint_health": "events",
    "w05_numbering": "lineitem",
    "j15_as_of_join": "events",
    "i03_postings": "documents",
    "c02_line_metrics": "documents",
    "c06_rule_scan": "documents",
    "v02_history": "events",
    "r08_windows_stream": "events",
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(tempfile.mkdtemp(prefix="bench-"), "bench", cores)
    queries = catalog.all_queries()
    rows = {t: spark.read.parquet(f"{folder}/{t}.parquet").count() for t in sorted(set(HEADLINE.values()))}
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().write.format("noop").mode("overwrite").save()
    took, rate = {}, {}
    for name, table in HEADLINE.items():
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            queries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(statistics.median(runs), 3)
        rate[name] = round(rows[table] / took[name])
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "rows_per_sec": rate,
        "sf": folder.rsplit("sf", 1)[-1], "cores": int(cores), "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
