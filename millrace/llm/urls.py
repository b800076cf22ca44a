"""URL filters: explicit rules first, then a character language-model ratio, all in DataFrame functions.

Two smoothed variable-order Markov models, of accepted and of rejected URLs, predict each character from up to two
before it (Witten-Bell interpolation down to single characters). Characters fall into 32 classes: letters, digits as
one, ``/``, ``.``, ``-``, a start mark and all others. The model is therefore a dense table of 32^3 log-likelihood
differences, whatever the number of URLs. A URL's score is the mean difference per character; the threshold lies
halfway between the 5th percentile of accepted and the 95th of rejected URLs that the models were not trained on.

A null URL and one without ``://`` have empty host and path; texts without characters score 0. With nothing to learn
from, the threshold is 0 and such URLs are allowed.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from millrace.session import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CLASSES = f"^{LOWER}0/.-_"  # the place of a character is its class, counted from 0
N = len(CLASSES)
ACCEPTED_LOW, REJECTED_HIGH = 0.05, 0.95


@dataclass(frozen=True)
class Rule:
    """``host`` and all its subdomains, for paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    found = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as (rule, verdict), null if none fits; the first in the list on ties of length."""
    ordered = sorted(rules, key=lambda r: -len(r.text))
    found = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict")),
        )
        for r in ordered
    ]
    return F.coalesce(*found) if found else F.lit(None).cast("struct<rule:string,verdict:string>")


def classes(url: Column) -> Column:
    """Classes of the characters after ``://`` (of the whole URL without one), two start marks before them."""
    text = F.translate(F.coalesce(_rest(url), url, F.lit("")), UPPER, LOWER)
    text = F.regexp_replace(F.regexp_replace(text, "[0-9]", "0"), r"[^a-z0/.\-]", "_")
    marks = F.filter(F.split(F.concat(F.lit("^^"), text), ""), lambda c: c != "")
    return F.transform(marks, lambda c: F.call_function("locate", c, F.lit(CLASSES)).cast("int") - 1)


def _cells(codes: str) -> Column:
    """Index into the table of each character with the two before it."""
    places = F.sequence(F.lit(3), F.size(codes))
    at = lambda i: F.element_at(codes, i)
    cells = F.transform(places, lambda i: at(i - 2) * (N * N) + at(i - 1) * N + at(i))
    return F.when(F.size(codes) >= 3, cells).otherwise(F.array().cast("array<int>"))


def log_ratio(urls: DataFrame, cells: str, accepted: str) -> DataFrame:
    """One row with ``ratio``: ln P(accepted) - ln P(rejected) of every cell, from the cells of labelled URLs."""
    spark = urls.sparkSession
    seen = urls.select(F.col(accepted).alias("good"), F.explode(cells).alias("cell")).groupBy("good", "cell").agg(F.count("*").alias("n"))
    grid = spark.range(N**3).select(F.col("id").cast("int").alias("cell"), F.explode(F.array(F.lit(True), F.lit(False))).alias("good"))
    rows = grid.join(seen, ["good", "cell"], "left").withColumn("n3", F.coalesce("n", F.lit(0)))
    first, second, third = F.floor(F.col("cell") / (N * N)), F.pmod(F.floor(F.col("cell") / N), F.lit(N)), F.pmod("cell", F.lit(N))
    rows = rows.withColumns({"c1": first, "c2": second, "c3": third})
    over = lambda value, *by: F.sum(value).over(W.partitionBy("good", *by))
    rows = rows.withColumns({"n2": over("n3", "c2", "c3"), "n1": over("n3", "c3")})
    once2, once1 = F.col("c1") == 0, (F.col("c1") == 0) & (F.col("c2") == 0)
    rows = rows.withColumns({
        "s3": over("n3", "c1", "c2"), "k3": over((F.col("n3") > 0).cast("int"), "c1", "c2"),
        "s2": over("n3", "c2"), "k2": over((once2 & (F.col("n2") > 0)).cast("int"), "c2"),
        "s1": over("n3"), "k1": over((once1 & (F.col("n1") > 0)).cast("int")),
    })
    p: Column = F.lit(1.0 / N)
    for k in (1, 2, 3):
        n, total, kinds = F.col(f"n{k}"), F.col(f"s{k}"), F.col(f"k{k}")
        p = F.when(total > 0, (n + kinds * p) / (total + kinds)).otherwise(p)
    rows = rows.select("cell", (F.when(F.col("good"), F.log(p)).otherwise(-F.log(p))).alias("part"))
    cell = rows.groupBy("cell").agg(F.sum("part").alias("ratio"))
    return cell.agg(F.transform(F.sort_array(F.collect_list(F.struct("cell", "ratio"))), lambda x: x["ratio"]).alias("ratio"))


def _score(rows: DataFrame, model: DataFrame, cells: str) -> DataFrame:
    """Adds ``score``, the mean difference over the cells; 0 without any."""
    rows = rows.withColumn("_ratio", model.select("ratio").scalar())
    total = F.aggregate(cells, F.lit(0.0), lambda s, c: s + F.element_at("_ratio", c + 1))
    return rows.withColumn("score", F.coalesce(total / F.nullif(F.size(cells), F.lit(0)), F.lit(0.0))).drop("_ratio")


def filter_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """Adds host, path, rule (null if none fits), score, threshold and verdict; columns with these names are replaced.

    URLs that a rule decides are the labelled ones: those whose crc32 is even train the models, the others set the
    threshold. All others are allowed if their score reaches the threshold.
    """
    made = {"host", "path", "rule", "verdict", "score", "threshold"}
    kept = F.struct(*[F.col(f"`{c}`") for c in pages.columns if c not in made]).alias("_row")
    rows = pages.select(kept, F.col(url).alias("_url"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    rows = rows.withColumn("_rule", matched_rule(F.col("host"), F.col("path"), rules)).withColumn("_codes", classes(F.col("_url")))
    rows = rows.withColumn("_cells", _cells("_codes")).drop("_codes")
    labelled = rows.where(F.col("_rule").isNotNull()).select("_cells", (F.col("_rule.verdict") == "allow").alias("good"), (F.crc32("_url") % 2 == 0).alias("fit"))
    model = cut(log_ratio(labelled.where("fit"), "_cells", "good"), "ratio")
    held = _score(labelled.where(~F.col("fit")), model, "_cells")
    low = F.percentile_approx(F.when(F.col("good"), F.col("score")), ACCEPTED_LOW, 10000)
    high = F.percentile_approx(F.when(~F.col("good"), F.col("score")), REJECTED_HIGH, 10000)
    limit = cut(held.agg(((F.coalesce(low, high, F.lit(0.0)) + F.coalesce(high, low, F.lit(0.0))) / 2).alias("threshold")), "threshold")
    out = _score(rows, model, "_cells").withColumn("threshold", limit.scalar())
    judged = F.when(F.col("score") >= F.col("threshold"), "allow").otherwise("block")
    verdict = F.coalesce(F.col("_rule.verdict"), judged)
    return out.select("_row.*", "host", "path", F.col("_rule.rule").alias("rule"), "score", "threshold", verdict.alias("verdict"))
