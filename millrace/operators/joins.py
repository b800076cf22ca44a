"""Lookups, references, subscriptions and upserts as joins, plus event-time joins."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from millrace.plans.joins import salted_join
from millrace.plans.runs import last_known
from millrace.plans.windows import sliding_sums

# Reference prefixes in the order they are tried.
REFERENCE_PREFIXES = ("fig:", "table:", "eq:", "sec:", "code:")


def enriched(main: DataFrame, extra: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left join in which the main side's values win where present."""
    side = extra.select(*on, *[F.col(c).alias(f"_x_{c}") for c in columns])
    out = main.join(side, list(on), "left")
    both = set(main.columns)
    merged = {c: F.coalesce(c, f"_x_{c}") if c in both else F.col(f"_x_{c}") for c in columns}
    return out.withColumns(merged).drop(*[f"_x_{c}" for c in columns])


def having(main: DataFrame, links: DataFrame, on: Sequence[str]) -> DataFrame:
    return main.join(links.select(*on).distinct(), list(on), "left_semi")


def with_counts(main: DataFrame, detail: DataFrame, on: Sequence[str], name: str = "n") -> DataFrame:
    """Detail rows counted per key before the join; keys without detail get 0."""
    counts = detail.groupBy(*on).agg(F.count(F.lit(1)).alias(name))
    return main.join(counts, list(on), "left").withColumn(name, F.coalesce(name, F.lit(0)))


def resolve_references(refs: DataFrame, targets: DataFrame, ref: str = "ref", target: str = "target_id") -> DataFrame:
    """Distinct references with the target each resolves to, null where unresolved.

    Tried in order: the id itself, the id behind each known prefix, the id in any case. Every attempt is
    a candidate key with a rank; one equi-join finds them all and the lowest rank wins, so a target that
    is referenced very often costs one row.
    """
    names = refs.select(F.col(ref).alias("ref")).distinct()
    exact = [F.struct(F.lit(0).alias("rank"), F.concat(F.lit("="), "ref").alias("key"))]
    exact += [F.struct(F.lit(i + 1).alias("rank"), F.concat(F.lit("=" + p), "ref").alias("key")) for i, p in enumerate(REFERENCE_PREFIXES)]
    folded = F.struct(F.lit(99).alias("rank"), F.concat(F.lit("~"), F.lower("ref")).alias("key"))
    wanted = names.select("ref", F.explode(F.array(*exact, folded)).alias("e")).select("ref", "e.*")
    # Of several targets that differ only in case, the smallest id stands for all.
    given = targets.select(F.col(target).alias("target")).distinct()
    offered = given.select("target", F.explode(F.array(
        F.concat(F.lit("="), "target"), F.concat(F.lit("~"), F.lower("target")))).alias("key"))
    offered = offered.groupBy("key").agg(F.min("target").alias("target"))
    hits = wanted.join(offered, "key").groupBy("ref").agg(F.min_by("target", "rank").alias("resolved"), F.min("rank").alias("rank"))
    return names.join(hits, "ref", "left")


def unresolved_references(refs: DataFrame, targets: DataFrame, ref: str = "ref", target: str = "target_id") -> DataFrame:
    found = resolve_references(refs, targets, ref, target).where("resolved IS NOT NULL")
    return refs.select(F.col(ref).alias("ref")).distinct().join(found, "ref", "left_anti")


def _pattern_parts(pattern: Column) -> tuple[Column, Column, Column]:
    """Segments before the first ``**``, after the last one, and whether there is any."""
    parts = F.split(pattern, r"\.")
    first, last = F.array_position(parts, "**"), F.array_position(F.reverse(parts), "**")
    rest = first > 0
    head = F.when(rest, F.slice(parts, F.lit(1), first.cast("int") - 1)).otherwise(parts)
    tail = F.when(rest, F.slice(parts, F.size(parts) - last.cast("int") + 2, last.cast("int") - 1)).otherwise(F.array().cast("array<string>"))
    return head, tail, rest


def _pattern_regex(pattern: Column) -> Column:
    segment = lambda x: F.when(x == "**", ".+").when(x == "*", "[^.]+").otherwise(F.concat(F.lit(r"\Q"), x, F.lit(r"\E")))
    return F.concat(F.lit("^"), F.array_join(F.transform(F.split(pattern, r"\."), segment), r"\."), F.lit("$"))


def shaped_patterns(subscriptions: DataFrame, pattern: str) -> tuple[DataFrame, Column]:
    """Subscriptions with ``_form``, their shape and literal segments, and the distinct shapes as one literal array.

    A shape says which of the segments before the first ``**`` and after the last one are ``*``. There are few shapes,
    however many subscriptions.
    """
    head, tail, rest = _pattern_parts(F.col(pattern))
    stars = lambda parts: F.transform(parts, lambda x: x == "*")
    shape = F.struct(rest.alias("rest"), stars(head).alias("head"), stars(tail).alias("tail"))
    shapes = [r.shape for r in subscriptions.select(shape.alias("shape")).distinct().collect()]
    bools = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<boolean>")
    listed = F.array(*[F.struct(F.lit(x.rest).alias("rest"), bools(x.head).alias("head"), bools(x.tail).alias("tail")) for x in shapes])
    listed = listed if shapes else F.array().cast("array<struct<rest:boolean,head:array<boolean>,tail:array<boolean>>>")
    return subscriptions.withColumn("_form", F.struct(shape.alias("shape"), F.concat(head, F.array(F.lit("")), tail).alias("text"))), listed


def topic_forms(topic: Column, shapes: Column) -> Column:
    """What a topic looks like to every shape it is long enough for: its segments with ``*`` where the shape has one."""
    parts = F.split(topic, r"\.")
    n = F.size(parts)
    fits = F.filter(shapes, lambda s: F.when(s["rest"], n > F.size(s["head"]) + F.size(s["tail"])).otherwise(n == F.size(s["head"])))

    def form(s: Column) -> Column:
        head = F.transform(F.slice(parts, F.lit(1), F.size(s["head"])), lambda x, i: F.when(F.get(s["head"], i), F.lit("*")).otherwise(x))
        tail = F.transform(F.slice(parts, n - F.size(s["tail"]) + 1, F.size(s["tail"])), lambda x, i: F.when(F.get(s["tail"], i), F.lit("*")).otherwise(x))
        return F.struct(s.alias("shape"), F.concat(head, F.array(F.lit("")), tail).alias("text"))

    return F.transform(fits, form)


def match_subscriptions(events: DataFrame, subscriptions: DataFrame, topic: str, pattern: str) -> DataFrame:
    """One row per event and matching subscription: ``*`` is one segment, ``**`` one or more, anywhere and in any number.

    The distinct topics are masked once per shape of the subscriptions and meet them by an equi-join on shape and
    segments; what lies between two ``**`` is compared after that. Only then do the events join.
    """
    routes = routed(events.select(F.col(topic)).distinct(), subscriptions, topic, pattern)
    spread = [c for c in events.columns if c != topic] or [topic]
    return salted_join(events, routes, [topic], spread)


def routed(rows: DataFrame, subscriptions: DataFrame, topic: str, pattern: str) -> DataFrame:
    """Rows joined to the subscriptions that match their topic; also for a streaming frame."""
    given, shapes = shaped_patterns(subscriptions, pattern)
    wanted = rows.where(F.col(topic).isNotNull()).withColumn("_form", F.explode(topic_forms(F.col(topic), shapes)))
    return wanted.join(given, "_form").where(F.regexp_like(topic, _pattern_regex(F.col(pattern)))).drop("_form")


def merge_rows(current: DataFrame, incoming: DataFrame, keys: Sequence[str], latest: str | None = None) -> DataFrame:
    """Upsert frame: every key once, incoming values winning, with status created, updated or kept.

    Of several incoming rows of a key the one with the largest ``latest`` counts, or without it the largest row. Null
    is a key like any other.
    """
    values = [c for c in current.columns if c not in keys]
    key, row = F.struct(*keys).alias("_key"), F.struct(*values)
    old = current.select(key, row.alias("_old"))
    new = incoming.groupBy(key).agg((F.max_by(row, latest) if latest else F.max(row)).alias("_new"))
    both = old.join(new, "_key", "full")
    status = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNotNull(), "updated").otherwise("kept")
    picked = F.coalesce("_new", "_old")
    return both.select(*[F.col("_key")[c].alias(c) for c in keys], *[picked[c].alias(c) for c in values], status.alias("status"))


def compare_metrics(a: DataFrame, b: DataFrame, metrics: Mapping[str, Column]) -> DataFrame:
    """Two tables side by side: rows (metric, left, right, difference)."""

    def long(df: DataFrame, name: str) -> DataFrame:
        wide = df.agg(*[m.cast("double").alias(k) for k, m in metrics.items()])
        pairs = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias(name)) for k in metrics])
        return wide.select(F.explode(pairs).alias("e")).select("e.*")

    out = long(a, "left").join(long(b, "right"), "metric", "full")
    return out.withColumn("difference", F.col("right") - F.col("left"))


def bibliography(entries: DataFrame, cited: DataFrame | None = None) -> DataFrame:
    """Entries ordered by first author and year; with ``cited`` (key) only those that are cited."""
    if cited is not None:
        entries = entries.join(cited.select("key"), "key", "left_semi")
    first = F.coalesce(F.get("authors", F.lit(0)), F.lit(""))
    return entries.withColumn("first_author", first).orderBy("first_author", F.coalesce("year", F.lit(0)), "key")


def trailing_join(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, width: float, sums: Mapping[str, Column]) -> DataFrame:
    """Range join, aggregated: for each left row, sums over right rows of its key in the last ``width`` seconds.

    Both sides share one sliding pass, so no pair of rows is ever built.
    """
    sides = left.withColumn("_left", F.lit(True)).unionByName(right.withColumn("_left", F.lit(False)), allowMissingColumns=True)
    seen = {n: F.when(F.col("_left"), F.lit(0)).otherwise(F.coalesce(e, F.lit(0))) for n, e in sums.items()}
    out = sliding_sums(sides, keys, at, width, seen)
    return out.where("_left").select(*left.columns, *sums)


def as_of_join(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, values: Sequence[str], chunk_seconds: float = 86400.0) -> DataFrame:
    """Adds to each left row the values of the latest right row of its key at or before its time."""
    right = right.select(*keys, at, *values).withColumn("_left", F.lit(0))
    left_rows = left.withColumn("_left", F.lit(1))
    held = {f"asof_{v}": v for v in values}
    sides = left_rows.unionByName(right, allowMissingColumns=True)
    filled = last_known(sides, keys, [at, "_left"], F.floor(F.col(at) / chunk_seconds), held)
    return filled.where("_left = 1").select(*left.columns, *held)

