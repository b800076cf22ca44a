"""Events that silence their key for a while, on keys that are never quiet.

What a chunk of times does is a step function: from the last firing before it to the last firing after it. It is given by
(start, end) pairs in order: the first start at or after the end of the silence leads to that pair's end; beyond the last
start nothing fires. Few steps remain, because firings from different starts soon fall together, and only starts within one
silence of the chunk's first time can be met. The functions of consecutive chunks compose; they are composed in a tree of
``FAN`` chunks a node, the state before each chunk comes down the tree, and the firings are replayed inside the chunks.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from millrace.session import cut

FAN = 64


def step_function(times: np.ndarray, silence: float) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of a chunk's ascending times."""
    after = np.searchsorted(times, times + silence, "left")
    last = np.where(after < len(times), after, np.arange(len(times)))
    while (last[last] != last).any():
        last = last[last]
    return _short(times, times[last], times[0], silence)


def _short(starts: np.ndarray, ends: np.ndarray, first: float, silence: float) -> tuple[np.ndarray, np.ndarray]:
    """Without starts that no silence reaches, and the last start of each run of equal ends only."""
    n = int(np.searchsorted(starts, first + silence, "left")) + 1
    starts, ends = starts[:n], ends[:n]
    kept = np.append(ends[1:] != ends[:-1], True)
    return starts[kept], ends[kept]


def follow(starts: np.ndarray, ends: np.ndarray, last: np.ndarray, silence: float) -> np.ndarray:
    """The last firing after a chunk for each last firing before it."""
    at = np.searchsorted(starts, last + silence, "left")
    return np.where(at < len(starts), ends[np.minimum(at, len(starts) - 1)], last)


def composed(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], first: float, silence: float) -> tuple[np.ndarray, np.ndarray]:
    """The function of two consecutive stretches, the first of which begins at ``first``."""
    return _short(np.concatenate([one[0], two[0]]), np.concatenate([follow(*two, one[1], silence), two[1]]), first, silence)


def replay(times: np.ndarray, last: float, silence: float) -> list[float]:
    out, at = [], int(np.searchsorted(times, last + silence, "left"))
    while at < len(times):
        out.append(float(times[at]))
        at = int(np.searchsorted(times, times[at] + silence, "left"))
    return out


def firings(df: DataFrame, keys: Sequence[str], at: str, silence: float, chunk: Column) -> DataFrame:
    """Rows (keys, at) that fire; ``chunk`` never falls along ``at``. Rows without a time are left out, repeated ones count once."""
    keys = list(keys)
    fields = [df.schema[k] for k in keys]
    number, array = T.LongType(), T.ArrayType(T.DoubleType())
    times = cut(df.where(F.col(at).isNotNull()).select(*keys, F.col(at).cast("double").alias("_at")).distinct().withColumn("_chunk", chunk.cast("long")), "times")
    times = times.select(*keys, "_chunk", "_at")

    def row(pdf: pd.DataFrame, **columns) -> pd.DataFrame:
        return pdf[keys].iloc[[0]].assign(**{c: [v] for c, v in columns.items()})

    def function(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.sort(pdf["_at"].to_numpy())
        starts, ends = step_function(own, silence)
        return row(pdf, _chunk=int(pdf["_chunk"].iloc[0]), _first=own[0], _starts=starts, _ends=ends)

    steps = [T.StructField("_first", T.DoubleType()), T.StructField("_starts", array), T.StructField("_ends", array)]
    found = times.groupBy(*keys, "_chunk").applyInPandas(function, T.StructType([*fields, T.StructField("_chunk", number), *steps]))
    along = W.partitionBy(*(keys or [F.lit(0)])).orderBy("_chunk")
    level = cut(found.withColumn("_no", F.row_number().over(along).cast("long") - 1), "steps")
    chunks = level.select(*keys, "_chunk", "_no")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_no")
        first = pdf["_first"].iloc[0]
        whole = pdf["_starts"].iloc[0], pdf["_ends"].iloc[0]
        for starts, ends in zip(pdf["_starts"].iloc[1:], pdf["_ends"].iloc[1:]):
            whole = composed(whole, (starts, ends), first, silence)
        return row(pdf, _no=int(pdf["_no"].iloc[0]) // FAN, _first=first, _starts=whole[0], _ends=whole[1])

    shape = T.StructType([*fields, T.StructField("_no", number), *steps])
    levels = [level.select(*shape.names)]
    while (levels[-1].agg(F.max("_no")).first()[0] or 0) > 0:
        group = F.floor(F.col("_no") / FAN).alias("_group")
        levels.append(cut(levels[-1].groupBy(*keys, group).applyInPandas(merge, shape), "steps"))

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        """The state before each stretch from that before the node they make up, which is the row without steps."""
        state = pdf.loc[pdf["_first"].isna(), "_last"].iloc[0]
        own = pdf[pdf["_first"].notna()].sort_values("_no")
        out = []
        for starts, ends in zip(own["_starts"], own["_ends"]):
            out.append(state)
            state = float(follow(starts, ends, np.array([state]), silence)[0])
        return own[[*keys, "_no"]].assign(_last=out)

    state = levels[-1].select(*keys, "_no", F.lit(float("-inf")).alias("_last"))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in steps]
    for level in reversed(levels[:-1]):
        both = level.select(*keys, F.floor(F.col("_no") / FAN).alias("_group"), "_no", *[f.name for f in steps], F.lit(None).cast("double").alias("_last"))
        both = both.unionByName(state.select(*keys, F.col("_no").alias("_group"), "_no", *none, "_last"))
        state = both.groupBy(*keys, "_group").applyInPandas(spread, T.StructType([*fields, T.StructField("_no", number), T.StructField("_last", T.DoubleType())]))

    same = [chunks[k].eqNullSafe(state[k]) for k in keys]
    before = chunks.join(state, [*same, chunks["_no"] == state["_no"]]).select(*[chunks[k] for k in keys], chunks["_chunk"], state["_last"])

    def fired(pdf: pd.DataFrame) -> pd.DataFrame:
        last = pdf.loc[pdf["_at"].isna(), "_last"].iloc[0]
        out = replay(np.sort(pdf["_at"].dropna().to_numpy()), last, silence)
        return pd.concat([pdf[keys].iloc[[0]]] * len(out)).assign(_at=out) if out else pdf[[*keys, "_at"]].iloc[:0]

    rows = times.withColumn("_last", F.lit(None).cast("double")).unionByName(before.withColumn("_at", F.lit(None).cast("double")))
    out = rows.groupBy(*keys, "_chunk").applyInPandas(fired, T.StructType([*fields, T.StructField("_at", T.DoubleType())]))
    return out.select(*keys, F.col("_at").cast(df.schema[at].dataType).alias(at))
