"""Training rows condensed to what a regression fit sees of them: moments for least squares, cells of split values for trees."""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool
from threading import RLock

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, inheritable_thread_target
from pyspark.ml import Estimator, Model, evaluation as ME, regression as MR
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.session import cut

SLOTS = 20  # features; wider rows are fitted as they are
ROWS_PER_CELL = 4  # on average; rows that share fewer cells are fitted as they are
TREES_AT_ONCE = 20  # bags drawn in one pass
ROWS_DRAWN = 1 << 18  # that a task holds for it
CELLS_PER_TASK = 100_000


def variants(estimator: Estimator, grid: Sequence[dict]) -> list[Estimator]:
    return [estimator.copy(g) for g in grid] or [estimator]


def kind(e: Estimator) -> str | None:
    """What of the rows this estimator's fit depends on: ``moments``, ``cells``, ``bags`` of cells, or the rows themselves."""
    if e.hasParam("weightCol") and e.isDefined("weightCol"):
        return None
    if isinstance(e, MR.LinearRegression):
        return "moments" if e.getLoss() == "squaredError" and e.getSolver() in ("auto", "normal") else None
    if not isinstance(e, MR.DecisionTreeRegressor | MR.RandomForestRegressor | MR.GBTRegressor) or e.getMinInstancesPerNode() > 1:
        return None
    if isinstance(e, MR.RandomForestRegressor):
        return "bags" if e.getBootstrap() and e.getNumTrees() > 1 else None
    if isinstance(e, MR.GBTRegressor):
        return "cells" if e.getLossType() == "squared" and e.getSubsamplingRate() == 1 and not e.isDefined("validationIndicatorCol") else None
    return "cells"


def nearest(x: Column, values: Sequence[float], first: int = 0) -> Column:
    """The place of the value next to x; limits are the means of neighbours, as the limits of a tree's bins are."""
    if len(values) == 1:
        return F.lit(first).cast("bigint")
    half = len(values) // 2
    return F.when(x <= (values[half - 1] + values[half]) / 2.0, nearest(x, values[:half], first)).otherwise(nearest(x, values[half:], first + half))


def drawn(rows: DataFrame, trees: Sequence[int], rate: float, seed: int) -> DataFrame:
    """Sums over parts of the rows (cell, dy): for each tree ``w``, how often a cell's rows are drawn, and ``s``, of their dy."""
    names = [f"{c}{t}" for t in trees for c in "ws"]

    def sums(cell: np.ndarray, dy: np.ndarray, rng: np.random.Generator) -> pa.RecordBatch:
        cells, at = np.unique(cell, return_inverse=True)
        columns = [pa.array(cells)]
        for _ in trees:
            times = rng.poisson(rate, len(dy))
            columns += [pa.array(np.bincount(at, x, len(cells))) for x in (times, times * dy)]
        return pa.RecordBatch.from_arrays(columns, ["cell", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, trees[0], TaskContext.get().partitionId()])
        held, size = [], 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            size += batch.num_rows
            if size >= ROWS_DRAWN:
                yield sums(*map(np.concatenate, zip(*held)), rng)
                held, size = [], 0
        if size:
            yield sums(*map(np.concatenate, zip(*held)), rng)

    parts = rows.select("cell", "dy").mapInArrow(run, "cell bigint, " + ", ".join(f"{c} double" for c in names))
    return parts.groupBy("cell").agg(*[F.sum(c).alias(c) for c in names])


class Condensed:
    """Rows (vector of features, label) for many fits, in folds where some are asked for.

    Least squares depends on the rows through their count, means and covariances only: a fit gets a few weighted points that have
    the same ones. A regression tree sees of a feature in which of at most ``maxBins`` bins it lies, and of the rows that share all
    bins their number and mean label: a fit gets one weighted row for each such cell, the features being the values next to which the
    bins lie. Every tree of a forest has its own draw of the rows, made before they become cells. All rows are passed over a fixed
    number of times, whatever the number of fits. Rows that a fit would refuse, and estimators that see more than this, are fitted as they are.
    """

    def __init__(self, ready: DataFrame, features: str = "features", label: str = "label", folds: int = 1, seed: int = 42) -> None:
        self.ready, self.features, self.label, self.folds, self.spark = ready, features, label, range(folds), ready.sparkSession
        self.slots: list[str] = []
        self._made: dict = {}
        self._lock = RLock()  # fits run side by side; what they share is made once
        first = ready.select(features).first()
        if first is None or first[0] is None or len(first[0]) > SLOTS:
            return
        width = len(first[0])
        flat = ready.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"), F.floor(F.rand(seed) * folds).cast("int").alias("fold"))
        self.flat = cut(flat.select(*[F.get("x", F.lit(i)).alias(f"x{i}") for i in range(width)], (F.size("x") != width).alias("odd"), "y", "fold"), "slots")
        slots = [f"x{i}" for i in range(width)]
        fine = reduce(lambda a, b: a & b, [F.abs(c) < math.inf for c in (*slots, "y")])
        facts = self.flat.groupBy("fold").agg(
            F.count_if(~F.coalesce(fine & ~F.col("odd"), F.lit(False))).alias("bad"), F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in (*slots, "y")]).collect()
        if len(facts) == folds and not any(r.bad for r in facts):
            self.slots, n = slots, sum(r.n for r in facts)
            self.centre = np.array([sum(r[c] for r in facts) / n for c in (*slots, "y")])
            self.rows = n

    def fits(self, pool: Sequence[Estimator]) -> bool:
        """Whether all of these can be fitted on condensed rows."""
        kinds = {kind(e) for e in pool} if self.slots else {None}
        if None in kinds or any(e.getFeaturesCol() != self.features or e.getLabelCol() != self.label for e in pool):
            return False
        return kinds == {"moments"} or all(math.prod(map(len, self.values(m))) < 2**48 and self.cells(m).count() * ROWS_PER_CELL <= self.rows for m in {e.getMaxBins() for e in pool})

    def fit(self, e: Estimator, left_out: int | None = None) -> Model:
        """The model of all rows, or of those outside a fold."""
        if not self.fits([e]):
            return e.fit(self.ready)
        if kind(e) == "moments":
            return e.fit(self.points([f for f in self.folds if f != left_out]), {e.weightCol: "w"})
        if kind(e) == "bags":
            return self.forest(e, left_out)
        rows = self.cells(e.getMaxBins())
        rows = rows if left_out is None else rows.where(F.col("fold") != left_out)
        return e.fit(rows, {e.weightCol: "w"})

    def score(self, judge: ME.RegressionEvaluator, e: Estimator, model: Model, fold: int) -> float:
        """A squared-error score on the rows of a fold; the labels of a cell become two with the same mean and variance."""
        if kind(e) == "moments":
            rows = self.points([fold])
        else:
            cells = self.cells(e.getMaxBins()).where(F.col("fold") == fold)
            sides = F.explode(F.array(F.col(self.label) - F.col("spread"), F.col(self.label) + F.col("spread")))
            rows = cells.select(self.features, sides.alias(self.label), (F.col("w") / 2).alias("w"))
        return judge.evaluate(model.transform(rows), {judge.weightCol: "w"})

    def cross_validate(self, pool: Sequence[Estimator], judge: ME.RegressionEvaluator, parallelism: int = 4) -> tuple[Model, list[float]]:
        """Every estimator's mean score over the folds, and the best of them fitted on all rows."""
        def one(job):
            e, fold = job
            return self.score(judge, e, self.fit(e, fold), fold)

        with ThreadPool(parallelism) as threads:
            found = threads.map(inheritable_thread_target(self.spark)(one), [(e, f) for e in pool for f in self.folds])
        means = [float(np.mean(found[i * len(self.folds):(i + 1) * len(self.folds)])) for i in range(len(pool))]
        return self.fit(pool[(np.argmax if judge.isLargerBetter() else np.argmin)(means)]), means

    def once(self, key, make):
        with self._lock:
            if key not in self._made:
                self._made[key] = make()
            return self._made[key]

    def moments(self) -> dict[int, tuple]:
        """Per fold the number of rows and the sums and products of their distances from the means."""
        columns = [*self.slots, "y"]
        at = {c: F.col(c) - float(m) for c, m in zip(columns, self.centre)}
        pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1)]
        sums = [F.sum(at[columns[i]] * at[columns[j]]).alias(f"p{i}_{j}") for i, j in pairs]
        made = {}
        for r in self.flat.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *[F.sum(at[c]).alias(c) for c in columns], *sums).collect():
            products = np.zeros((len(columns), len(columns)))
            for i, j in pairs:
                products[i, j] = products[j, i] = r[f"p{i}_{j}"]
            made[r.fold] = (r.n, np.array([r[c] for c in columns]), products)
        return made

    def points(self, folds: Sequence[int]) -> DataFrame:
        """Weighted points with the count, means and covariances of these folds."""
        moments = self.once("moments", self.moments)
        n, total, products = (sum(x) for x in zip(*(moments[f] for f in folds)))
        mean = total / n
        cov = products / n - np.outer(mean, mean)
        scale = np.sqrt(np.maximum(np.diag(cov), 0))
        unit = np.where(scale > 0, scale, 1)
        size, axes = np.linalg.eigh(cov / np.outer(unit, unit))
        steps = (scale[:, None] * axes * np.sqrt(np.maximum(size, 0) * len(mean))).T
        rows = [(Vectors.dense(p[:-1]), float(p[-1]), n / (2 * len(mean))) for p in self.centre + mean + np.concatenate([steps, -steps])]
        schema = T.StructType([T.StructField(self.features, VectorUDT()), T.StructField(self.label, T.DoubleType()), T.StructField("w", T.DoubleType())])
        return self.spark.createDataFrame(rows, schema).coalesce(1)

    def values(self, most: int) -> list[list[float]]:
        """For each feature up to ``most`` values that stand for all: its own where it has so few, else such of equal shares of the rows."""
        def make():
            kinds = self.flat.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in self.slots]).first()
            few = [c for c in self.slots if kinds[c] <= most * 1.25]  # the count is an estimate
            shares = [(i + 0.5) / most for i in range(most)]
            found = self.flat.agg(*[(F.collect_set(c) if c in few else F.percentile_approx(c, shares, 10_000)).alias(c) for c in self.slots]).first()
            many = [c for c in few if len(set(found[c])) > most]
            again = self.flat.agg(*[F.percentile_approx(c, shares, 10_000).alias(c) for c in many]).first() if many else found
            return [sorted(set((again if c in many else found)[c])) for c in self.slots]

        return self.once(("values", most), make)

    def binned(self, most: int) -> DataFrame:
        """Rows (cell, dy): the number of a fold and of the values that stand for the features, the distance from the mean label."""
        cell = F.col("fold").cast("bigint")
        for c, v in reversed([*zip(self.slots, self.values(most))]):
            cell = cell * len(v) + nearest(F.col(c), v)
        return self.flat.select(cell.alias("cell"), (F.col("y") - float(self.centre[-1])).alias("dy"))

    def named(self, cells: DataFrame, most: int) -> DataFrame:
        """Adds to cells their ``fold`` and features."""
        left, slots, size = F.col("cell"), [], 1
        for v in self.values(most):
            slots.append(F.get(F.array(*map(F.lit, v)), F.pmod(left, F.lit(len(v))).cast("int")))
            size *= len(v)
            left = F.expr(f"cell div {size}")
        kept = self.ready.schema[self.features].metadata
        return cells.select("*", left.cast("int").alias("fold"), array_to_vector(F.array(*slots)).alias(self.features, metadata=kept))

    def kept(self, cells: DataFrame) -> DataFrame:
        """Written once, then in memory, in as few tasks as its rows need: a fit of many steps pays for each task."""
        made = cut(cells, "cells")
        return made.coalesce(-(-max(made.count(), 1) // CELLS_PER_TASK)).cache()

    def cells(self, most: int) -> DataFrame:
        """Rows (fold, features, label, w, spread): mean label, number of rows and deviation of the label."""
        def make():
            sums = self.binned(most).groupBy("cell").agg(F.count(F.lit(1)).cast("double").alias("w"), F.sum("dy").alias("s"), F.sum(F.col("dy") * F.col("dy")).alias("q"))
            mean = F.col("s") / F.col("w")
            spread = F.sqrt(F.greatest(F.col("q") / F.col("w") - mean * mean, F.lit(0.0)))
            return self.kept(self.named(sums, most).select("fold", self.features, (mean + float(self.centre[-1])).alias(self.label), "w", spread.alias("spread")))

        return self.once(("cells", most), make)

    def bags(self, most: int, trees: Sequence[int], rate: float, seed: int) -> DataFrame:
        """Rows (fold, features, w0, s0, w1, s1, ...): cells of every tree's own draw of the rows, each taken a Poisson number of times."""
        return self.once(("bags", most, trees, rate, seed), lambda: self.kept(self.named(drawn(self.binned(most), trees, rate, seed), most).drop("cell")))

    def forest(self, e: MR.RandomForestRegressor, left_out: int | None) -> MR.RandomForestRegressionModel:
        """The trees of a forest, each fitted on its own draw, as one model."""
        n = e.getNumTrees()
        of = "onethird" if e.getFeatureSubsetStrategy() == "auto" else e.getFeatureSubsetStrategy()

        def one(t: int):
            first = t - t % TREES_AT_ONCE
            bags = self.bags(e.getMaxBins(), range(first, min(first + TREES_AT_ONCE, n)), e.getSubsamplingRate(), e.getSeed())
            mean = F.col(f"s{t}") / F.col(f"w{t}") + float(self.centre[-1])
            rows = bags.where(F.col(f"w{t}") > 0).select("fold", self.features, mean.alias(self.label), F.col(f"w{t}").alias("w"))
            rows = rows if left_out is None else rows.where(F.col("fold") != left_out)
            return e.fit(rows, {e.numTrees: 1, e.bootstrap: False, e.subsamplingRate: 1.0, e.featureSubsetStrategy: of, e.weightCol: "w", e.seed: e.getSeed() + t})

        with ThreadPool(4) as threads:
            trees = threads.map(inheritable_thread_target(self.spark)(one), range(n))
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        array = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
        for i, m in enumerate(trees):
            array[i] = m._java_obj.trees()[0]
        made = MR.RandomForestRegressionModel(jvm.org.apache.spark.ml.regression.RandomForestRegressionModel(e.uid, array, len(self.slots)))
        return e._copyValues(made)

    def close(self) -> None:
        for x in self._made.values():
            if isinstance(x, DataFrame):
                x.unpersist()
