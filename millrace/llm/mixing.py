"""Mixing sources to target weights with a low-discrepancy schedule.

The mix is a row of slots of ``block`` tokens. Slot i owns the golden-ratio point frac((i + 1/2) * phi); the point,
looked up in the cumulative target shares, names the slot's source, so every stretch of the schedule is close to the
targets. The r-th slot of a source takes the r-th block of that source's shuffled documents, which repeat for up to
``max_epochs`` rounds in the same order. A source's slots stop at its target; its last block is cut there.

Nothing passes through one task but a row per source: points are ranked per (source, stretch of slots), documents are
laid out per (source, stretch of the shuffle), and both meet on (source, block).

Null sources are one source, the last in order. Documents without tokens get nothing. Repeated rows are separate
documents; rows that agree in source, key and tokens may change places among themselves, which changes no result.
An empty table gives an empty schedule and no rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from millrace.session import cut

BLOCK = 64
MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
PHI = 0.6180339887498949
STRETCH = 1 << 13
DOCS_PER_STRETCH = 1024
SLACK_SLOTS = 16


def token_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, block: int = BLOCK) -> DataFrame:
    """source, its rows and size, its target, the slots that takes and the share of the schedule before and up to it, one row per source.

    Shares are those of the slots, whole blocks, so a source of a few tokens has the share of one slot.

    Sources in order (code point, null last) weigh as ``weights``, repeating. A target stops at ``max_epochs`` times
    its source's size, and what it leaves over is shared again by weight: targets are min(cap, level * weight) at the
    level that makes them sum to all sizes. That level is found in one pass over the sources ordered by cap / weight.
    """
    everything = W.partitionBy(F.lit(0))
    order = everything.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    n = F.row_number().over(order)
    rows = rows.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(n - 1, F.lit(len(weights))) + 1).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * float(max_epochs))
    by_level = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = by_level.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({
        "_total": F.sum("source_size").over(everything).cast("double"),
        "_capped": F.coalesce(F.sum("cap").over(upto), F.lit(0.0)),
        "_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)),
    })
    # levels rise while sources with a cap below them leave and fall afterwards: the first source that stays sets the highest
    level = (F.col("_total") - F.col("_capped")) / F.col("_weight")
    rows = rows.withColumn("_level", F.max(F.when(F.col("cap") / F.col("weight") >= level, level)).over(everything))
    rows = rows.withColumn("target", F.least("cap", F.coalesce(F.col("_level") * F.col("weight"), F.col("cap"))))
    rows = rows.withColumn("need", F.ceil(F.round("target") / block).cast("long"))
    needs = F.sum("need").over(everything)
    rows = rows.withColumn("_share", F.when(needs > 0, F.col("need") / needs).otherwise(0.0))
    share = F.col("_share")
    rows = rows.withColumn("high", F.sum(share).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return rows.select("source", "n_docs", "source_size", "target", "need", (F.col("high") - share).alias("low"), "high")


def schedule(goals: DataFrame, slots: int, block: int = BLOCK) -> DataFrame:
    """(slot, source, rank, tokens): the source of every slot, its rank among that source's slots, the tokens it takes.

    ``goals`` is the result of ``targets``. Points meet shares through a grid of cells: a share covers whole cells but
    for its ends, so each point is compared with few sources, however many there are.
    """
    spark = goals.sparkSession
    grid = 1024
    wide = goals.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * grid).cast("int"), F.least(F.floor(F.col("high") * grid), F.lit(grid - 1)).cast("int")))).where("need > 0")
    # the integer part is taken off in two steps, so that the fraction stays precise for large slot numbers
    coarse = F.floor(F.col("id") / STRETCH)
    whole = PHI * STRETCH % 1
    point = F.pmod(F.pmod(coarse * F.lit(whole), F.lit(1.0)) + (F.pmod(F.col("id"), F.lit(STRETCH)) + 0.5) * F.lit(PHI), F.lit(1.0))
    points = spark.range(slots).select(F.col("id").alias("slot"), coarse.alias("stretch"), point.alias("u"), F.floor(point * grid).cast("int").alias("cell"))
    low = F.col("u") >= F.col("low")
    placed = points.join(wide, "cell").where(low & (F.col("u") < F.col("high")))
    key = F.struct("source").alias("key")
    placed = placed.select("slot", "stretch", key, "target")
    counts = placed.groupBy("key", "stretch").agg(F.count("*").alias("n"))
    ahead = W.partitionBy("key").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("key", "stretch", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    local = F.row_number().over(W.partitionBy("key", "stretch").orderBy("slot")) - 1
    ranked = placed.withColumn("local", local).join(counts, ["key", "stretch"])
    rank = F.col("local") + F.col("before")
    tokens = F.least(F.lit(block), F.round("target").cast("long") - rank * block)
    return ranked.select("slot", F.col("key.source").alias("source"), rank.alias("rank"), tokens.alias("tokens")).where("tokens > 0")


def enough_slots(goals: DataFrame) -> int:
    """Slots in which every source gets all it needs.

    Of n golden-ratio points two neighbours are less than 1.9 / n apart, so twice the sum of all needs is always enough; any
    stretch of points misses a share by a few points at most, which mostly needs less.
    """
    needed, least = goals.where("need > 0").agg(F.sum("need"), F.min("need")).first()
    return min(2 * needed, needed + -(-SLACK_SLOTS * needed // least)) + 1 if needed else 0


def blocks(docs: DataFrame, goals: DataFrame, block: int = BLOCK, max_epochs: int = MAX_EPOCHS, key: str = "doc_id", seed: str = "mix") -> DataFrame:
    """Pieces (source, rank, row columns, first, tokens): which tokens of which document each block of a source holds.

    Documents of a source follow each other in the order of a hash of ``key``. ``docs`` needs ``source`` and ``size``;
    ``first`` counts the tokens of the block before the piece.
    """
    rows = docs.where("size > 0").withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")))))
    ends = goals.select(F.struct("source").alias("_key"), "n_docs", "source_size", F.round("target").cast("long").alias("_goal"))
    rows = rows.withColumn("_key", F.struct("source")).join(ends, "_key")
    stretches = F.ceil(F.col("n_docs") / DOCS_PER_STRETCH)
    rows = rows.withColumn("_stretch", F.floor(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * stretches / F.lit(1 << 32)))
    totals = rows.groupBy("_key", "_stretch").agg(F.sum("size").alias("_sum"))
    ahead = W.partitionBy("_key").orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("_key", "_stretch", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_before"))
    inside = W.partitionBy("_key", "_stretch").orderBy("_h", key, "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_own", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(totals, ["_key", "_stretch"])
    start = F.col("_own") + F.col("_before") + F.col("_epoch") * F.col("source_size")
    rows = rows.withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1)))).withColumn("_start", start)
    rows = rows.withColumn("_end", F.least(F.col("_start") + F.col("size"), F.col("_goal"))).where("_start < _end")
    rank = F.explode(F.sequence(F.floor(F.col("_start") / block), F.floor((F.col("_end") - 1) / block)))
    rows = rows.withColumn("rank", rank)
    begin = F.greatest(F.col("_start"), F.col("rank") * block)
    stop = F.least(F.col("_end"), (F.col("rank") + 1) * block)
    rows = rows.withColumns({"first": begin - F.col("rank") * block, "piece": stop - begin})
    return rows.drop("_h", "_stretch", "_key", "_before", "_own", "_epoch", "_start", "_end", "_goal", "source_size", "n_docs")


def mix(docs: DataFrame, key: str = "doc_id", block: int = BLOCK, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(row, source, size, source_size, target, taken): the tokens that the mix takes of every document.

    ``docs`` has ``key``, ``source`` and ``text``; ``key`` need not be unique, each row is counted on its own.
    """
    numbered = cut(docs.select(key, "source", token_count(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("_row")), "sizes")
    goals = cut(targets(numbered, weights, max_epochs, block), "targets")
    slots = enough_slots(goals)
    plan = schedule(goals, slots, block)
    pieces = blocks(numbered, goals, block, max_epochs, key)
    on = [F.struct("source").alias("_key"), "rank"]
    held = plan.select(*on, F.col("tokens").alias("_limit")).join(pieces.select(*on, "_row", "first", "piece"), ["_key", "rank"])
    used = F.least(F.col("piece"), F.col("_limit") - F.col("first"))
    taken = held.groupBy("_row").agg(F.sum(F.greatest(used, F.lit(0))).alias("taken"))
    ends = goals.select(F.struct("source").alias("_key"), "source_size", "target")
    out = numbered.withColumn("_key", F.struct("source")).join(ends, "_key").join(taken, "_row", "left")
    return out.select(key, "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def repeated(docs: DataFrame, key: str = "doc_id", block: int = BLOCK, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it: taken / size rounded to whole documents."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    marked = cut(docs.select(F.monotonically_increasing_id().alias("mixed"), row), "mixed")
    taken = mix(marked.select("mixed", "row.source", "row.text"), "mixed", block, weights, max_epochs)
    times = taken.where("size > 0").select("mixed", F.round(F.col("taken") / F.col("size")).cast("int").alias("times")).where("times > 0")
    return marked.join(times, "mixed").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
