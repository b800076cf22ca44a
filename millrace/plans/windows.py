"""Trailing time windows over long keys, split below the width of a window.

Time is cut into blocks as wide as the window. A window then is the end of one block and the beginning of the next: the sum
from its start to the end of the first, plus the sum from the start of the second to the row. Both only add, so nothing is
lost by subtraction. Blocks are cut into ``CELLS`` cells; a task works on cells, and a block passes on one row per cell, so a
metric whose rows all lie inside one window still spreads. Rows at the same time are one instant, added up before the
shuffle, which bounds a cell by the resolution of its times and not by the rows.

Rows without a time are in no window and are left out. Null keys are a key.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CELLS = 64
_CELL = ["_k", "_block", "_cell"]


def _placed(rows: DataFrame, at: str, width: float) -> DataFrame:
    """Adds the block of a time and its cell in the block."""
    share = F.col(at) / F.lit(float(width))
    block = F.floor(share).cast("long")
    return rows.withColumns({"_block": block, "_cell": F.least(F.floor((share - block) * CELLS), F.lit(CELLS - 1)).cast("int")})


def _instants(df: DataFrame, keys: Sequence[str], at: str, aggregates: Mapping[str, Column]) -> DataFrame:
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))
    rows = df.where(F.col(at).isNotNull()).withColumn("_k", key).withColumn("_at", F.col(at))
    return rows.groupBy("_k", "_at").agg(*[e.alias(n) for n, e in aggregates.items()])


def _events(instants: DataFrame, width: float) -> DataFrame:
    """Every instant where it is, and once more, as a question, where its window begins, in the block before its own."""
    here = _placed(instants.withColumns({"_t": F.col("_at"), "_asks": F.lit(0)}), "_t", width)
    there = _placed(instants.withColumn("_own", F.floor(F.col("_at") / F.lit(float(width))).cast("long")).withColumns({"_t": F.col("_at") - F.lit(float(width)), "_asks": F.lit(1)}), "_t", width)
    before = F.col("_own") - 1
    edge = F.when(F.col("_block") > before, CELLS - 1).when(F.col("_block") < before, 0).otherwise(F.col("_cell")).cast("int")
    return here.unionByName(there.withColumns({"_cell": edge, "_block": before}).drop("_own"))


def _directions() -> tuple:
    """Frames over a cell: from its start up to a row, and from a row to its end, rows at the row's time included."""
    cell = W.partitionBy("_g")
    rows = (W.unboundedPreceding, W.currentRow)
    return cell.orderBy("_t", "_asks").rowsBetween(*rows), cell.orderBy(F.desc("_t"), "_asks").rowsBetween(*rows)


def _around() -> tuple:
    """Frames over the cells of a block: those before a cell, those after it."""
    block = W.partitionBy("_k", "_block").orderBy("_cell")
    return block.rowsBetween(W.unboundedPreceding, -1), block.rowsBetween(1, W.unboundedFollowing)


def _back(df: DataFrame, keys: Sequence[str], at: str, found: DataFrame, names: Sequence[str]) -> DataFrame:
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))
    rows = df.withColumns({"_k": key, "_at": F.col(at)})
    return rows.join(found.select("_k", "_at", *names), ["_k", "_at"]).select(*df.columns, *names)


def sliding_sums(df: DataFrame, keys: Sequence[str], at: str, width: float, sums: Mapping[str, Column]) -> DataFrame:
    """Adds sums over the trailing ``width`` seconds, current row and rows at its time included."""
    instants = _instants(df, keys, at, {n: F.sum(e) for n, e in sums.items()})
    asks = F.col("_asks") == 1
    events = _events(instants, width).withColumn("_g", F.struct(*_CELL))
    events = events.withColumns({n: F.when(~asks, F.col(n)) for n in sums})
    first, last = _around()
    totals = events.groupBy("_g").agg(*[F.sum(n).alias(n) for n in sums]).select("_g", "_g.*", *sums)
    carried = totals.select("_g", *[F.sum(n).over(first).alias(f"_b_{n}") for n in sums], *[F.sum(n).over(last).alias(f"_a_{n}") for n in sums])
    upto, on = _directions()
    local = events.withColumns({f"_u_{n}": F.sum(n).over(upto) for n in sums}).withColumns({f"_o_{n}": F.sum(n).over(on) for n in sums})
    joined = local.join(carried, "_g")
    # an instant's beginning of a block, or its end: nulls are sums over nothing
    part = {n: F.when(asks, _plus(F.col(f"_o_{n}"), F.col(f"_a_{n}"))).otherwise(_plus(F.col(f"_u_{n}"), F.col(f"_b_{n}"))) for n in sums}
    found = joined.select("_k", "_at", *[e.alias(n) for n, e in part.items()]).groupBy("_k", "_at").agg(*[F.sum(n).alias(n) for n in sums])
    return _back(df, keys, at, found, list(sums))


def _plus(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


def _merged(a: Column, b: Column) -> Column:
    """Count, mean and sum of squared distances of two groups together; means that differ by rounding alone are the same."""
    n = a["n"] + b["n"]
    apart = b["mean"] - a["mean"]
    apart = F.when(F.abs(apart) > 1e-13 * F.greatest(F.abs(a["mean"]), F.abs(b["mean"])), apart).otherwise(0.0)
    both = F.struct(n.alias("n"), (a["mean"] + apart * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + apart * apart * a["n"] * b["n"] / n).alias("m2"))
    return F.when(a.isNull() | (a["n"] == 0), b).when(b.isNull() | (b["n"] == 0), a).otherwise(both)


def _moments(n: Column, s: Column, q: Column, centre: Column) -> Column:
    """The group of ``n`` values with sums ``s`` and ``q`` of distances and squared distances from ``centre``; what rounding leaves of a
    group without spread is none."""
    m2 = q - s * s / n
    return F.when(n > 0, F.struct(n.alias("n"), (centre + s / n).alias("mean"), F.when(m2 > 1e-13 * q, m2).otherwise(0.0).alias("m2")))


def sliding_moments(df: DataFrame, keys: Sequence[str], at: str, value: str, width: float) -> DataFrame:
    """Adds ``win_n``, ``win_mean`` and ``win_std`` (sample) of the values in the trailing ``width`` seconds.

    Sums inside a cell are taken about the cell's mean, those over the cells of a block about the block's.
    """
    x = F.col(value)
    instants = _instants(df, keys, at, {"_n": F.count(x), "_mean": F.avg(x), "_m2": F.coalesce(F.var_pop(x), F.lit(0.0)) * F.count(x)})
    asks = F.col("_asks") == 1
    events = _events(instants, width).withColumn("_g", F.struct(*_CELL))
    events = events.withColumns({"_n": F.when(asks, 0).otherwise(F.col("_n")), "_m2": F.when(asks, 0.0).otherwise(F.col("_m2"))})
    cell = W.partitionBy("_g")
    weigh = F.col("_n") * F.col("_mean")
    events = events.withColumn("_mid", F.sum(weigh).over(cell) / F.nullif(F.sum("_n").over(cell), F.lit(0)))
    off = F.coalesce(F.col("_mean") - F.col("_mid"), F.lit(0.0))
    events = events.withColumns({"_s": F.col("_n") * off, "_q": F.col("_m2") + F.col("_n") * off * off})
    sums = [F.sum(c).alias(c) for c in ("_n", "_s", "_q")]
    totals = events.groupBy("_g").agg(F.max("_mid").alias("_mid"), *sums).select("_g", "_g.*", _moments(F.col("_n"), F.col("_s"), F.col("_q"), F.col("_mid")).alias("_all"))
    block = W.partitionBy("_k", "_block")
    n, mean = F.col("_all.n"), F.col("_all.mean")
    totals = totals.withColumn("_centre", F.sum(n * mean).over(block) / F.sum(n).over(block))
    apart = mean - F.col("_centre")
    terms = {"_n": n, "_s": n * apart, "_q": F.col("_all.m2") + n * apart * apart}
    around = [_moments(*[F.sum(e).over(w) for e in terms.values()], F.col("_centre")).alias(name) for w, name in zip(_around(), ("_before", "_after"))]
    carried = totals.select("_g", *around)
    upto, on = _directions()
    local = events.withColumns({f"_u{c}": F.sum(c).over(upto) for c in terms}).withColumns({f"_o{c}": F.sum(c).over(on) for c in terms})
    joined = local.join(carried, "_g")
    inside = lambda d: _moments(*[F.col(f"_{d}{c}") for c in terms], F.col("_mid"))
    part = F.when(asks, _merged(inside("o"), F.col("_after"))).otherwise(_merged(F.col("_before"), inside("u")))
    both = joined.select("_k", "_at", "_asks", part.alias("_part")).groupBy("_k", "_at").agg(
        F.max(F.when(asks, F.col("_part"))).alias("_end"), F.max(F.when(~asks, F.col("_part"))).alias("_start")
    )
    win = both.select("_k", "_at", _merged(F.col("_end"), F.col("_start")).alias("_w"))
    n = F.coalesce(F.col("_w.n"), F.lit(0).cast("long"))
    found = win.select("_k", "_at", n.alias("win_n"), F.col("_w.mean").alias("win_mean"), F.when(n > 1, F.sqrt(F.col("_w.m2") / (n - 1))).alias("win_std"))
    return _back(df, keys, at, found, ["win_n", "win_mean", "win_std"])


def block_prefixes(df: DataFrame, keys: Sequence[str], at: str, tie: str, value: str, width: float) -> DataFrame:
    """Adds, in the order of (at, tie): ``_i``, the row's number in its key; ``_hi``, that of the last row at its time; ``_block``; the sums of
    ``value`` from the start of the block up to the row (``_s``) and up to the last row at its time (``_shi``), and over the block
    (``_total``)."""
    key = F.struct(*keys, F.lit(0).alias("_all"))
    rows = _placed(df.where(F.col(at).isNotNull()).withColumn("_k", key), at, width).withColumn("_g", F.struct(*_CELL))
    one_by_one = W.partitionBy("_g").orderBy(at, tie).rowsBetween(W.unboundedPreceding, 0)
    with_peers = W.partitionBy("_g").orderBy(at).rangeBetween(W.unboundedPreceding, W.currentRow)
    own = rows.withColumns({"_i": F.count(F.lit(1)).over(one_by_one), "_s": F.sum(value).over(one_by_one), "_hi": F.count(F.lit(1)).over(with_peers), "_shi": F.sum(value).over(with_peers)})
    totals = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_sum")).select("_g", "_g.*", "_n", "_sum")
    block = W.partitionBy("_k", "_block").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("_g", "_k", "_block", F.coalesce(F.sum("_n").over(block), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_sum").over(block), F.lit(0.0)).alias("_s0"), "_n", "_sum")
    blocks = totals.groupBy("_k", "_block").agg(F.sum("_n").alias("_bn"), F.sum("_sum").alias("_total"))
    along = W.partitionBy("_k").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("_k", "_block", F.coalesce(F.sum("_bn").over(along), F.lit(0)).alias("_b0"), F.coalesce("_total", F.lit(0.0)).alias("_total"))
    before = totals.join(blocks, ["_k", "_block"]).select("_g", (F.col("_n0") + F.col("_b0")).alias("_n0"), "_s0", "_total")
    placed = own.join(before, "_g")
    return placed.withColumns({
        "_i": F.col("_i") + F.col("_n0"), "_hi": F.col("_hi") + F.col("_n0"), "_s": F.coalesce("_s", F.lit(0.0)) + F.col("_s0"), "_shi": F.coalesce("_shi", F.lit(0.0)) + F.col("_s0"),
    }).drop("_k", "_cell", "_g", "_n0", "_s0")
