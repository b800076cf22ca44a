"""Whitening of embeddings by a distributed block Jacobi-Davidson eigensolver.

The covariance is never formed. Its product with a few vectors is a job over the rows: every task centres its rows, multiplies
them with the block and back, and the partial sums, as large as the block, are added in groups of tasks. The solver keeps an
orthonormal basis and its products. Each round takes the Ritz pairs of the basis, locks those whose residual is at rounding
level, and solves for all others the correction equation (I - Q Q') (V - theta) (I - Q Q') t = -r, Q being the locked vectors and
the Ritz vectors, by a few steps of MINRES in lock step, one job a step for the whole block. The corrections widen the basis,
which starts anew from its best Ritz vectors when it is full.

Entries become whole numbers first, so sums and deviations are exact. Only blocks of dimension times components reach the
driver or are broadcast, whatever the number of rows.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from millrace.llm.batches import quoted
from millrace.session import cut

COMPONENTS = 32
SCALE = 64
OFFSET = 1_000_000
INNER = 8
ROUNDS = 60
WIDTH = 3
RESIDUAL = 2.0**-44
FLAT = 2.0**-40
FAN_IN = 64
ROWS = 1024
_FAR = 2.0**53


@dataclass(frozen=True)
class Spectrum:
    """Eigenvectors as columns, eigenvalues falling; ``sums`` are exact, less ``OFFSET`` a row."""

    rows: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float
    jobs: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.rows for s in self.sums]) if self.rows else np.zeros(len(self.sums))


def quantised(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, x): floor(64 * c) of each entry c of the usable vectors, ``OFFSET`` not yet added.

    Rows go whose vector is null, empty or holds null or non-finite entries, or entries beyond 2^53 / 64, whose floor no double
    gives exactly; and rows whose length is not the most frequent one (of equally frequent ones the longer). Keys may be null
    or repeat: every remaining row counts.
    """
    entry = lambda c: F.floor(c.cast("double") * SCALE)
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) * SCALE > _FAR)
    usable = vectors.select(F.col(quoted(key)).alias("key"), F.col(quoted(vector)).alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0))
    usable = usable.where(~F.exists("v", bad)).select("key", F.transform("v", entry).alias("x"))
    kept = cut(usable, "vectors")
    lengths = kept.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return kept.where(F.size("x") == (lengths.d if lengths else 0))


def _matrix(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    column = batch.column("x")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """Sum over all rows of ``part(x)``, a block of doubles of the given shape: per task, then per group of tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(shape)
        for piece in _pieces(batches):
            if piece.num_rows:
                total += part(_matrix(piece))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["task", "block"])

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("task")  # the same order, so the same rounding, in every attempt
        total = np.zeros(shape)
        for block in table.column("block"):
            total += np.frombuffer(block.as_buffer(), float).reshape(shape)
        return pa.table({"task": table.column("task").slice(0, 1), "block": pa.array([total.tobytes()], pa.binary())})

    blocks = rows.select("x").mapInArrow(run, "task long, block binary")
    tasks, span = rows.rdd.getNumPartitions(), 1
    while tasks > FAN_IN:
        span, tasks = span * FAN_IN, -(-tasks // FAN_IN)
        blocks = blocks.groupBy(F.floor(F.col("task") / span)).applyInArrow(add, "task long, block binary")
    return np.frombuffer(add(blocks.toArrow()).column("block")[0].as_py(), float).reshape(shape)


def exact_sums(rows: DataFrame, dimension: int) -> tuple[int, tuple[int, ...]]:
    """Number of rows and the exact sum of every dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = 0, [0] * dimension
        for piece in _pieces(batches):
            if piece.num_rows:
                x = _matrix(piece)
                count += len(x)
                for k, (high, low) in enumerate(zip((x >> 32).sum(0).tolist(), (x & 0xFFFFFFFF).sum(0).tolist())):
                    total[k] += (high << 32) + low
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dimension), pa.int32()), pa.array([str(v) for v in [count, *total]], pa.string())], ["k", "s"])

    added = rows.select("x").mapInArrow(run, "k int, s string").groupBy("k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    found = {r.k: int(r.s) for r in added}
    return found.get(-1, 0), tuple(found.get(k, 0) for k in range(dimension))


def minres(product: Callable[[np.ndarray], np.ndarray], rhs: np.ndarray, steps: int, small: float = 1e-3) -> np.ndarray:
    """``steps`` of MINRES for every column of ``rhs`` at once; columns stop by themselves when their residual is ``small``
    of the first or their Krylov space ends. ``product`` maps blocks, the operator of each column being symmetric."""
    norm = lambda a: np.sqrt((a * a).sum(0))
    safe = lambda a: np.where(a == 0, 1.0, a)
    x = np.zeros_like(rhs)
    beta = norm(rhs)
    start, live = beta.copy(), beta > 0
    v_old, v = np.zeros_like(rhs), rhs / safe(beta)
    w_old, w = np.zeros_like(rhs), np.zeros_like(rhs)
    c_old, c, s_old, s = np.ones(len(beta)), np.ones(len(beta)), np.zeros(len(beta)), np.zeros(len(beta))
    eta, beta = beta.copy(), np.zeros_like(beta)
    for _ in range(steps):
        if not live.any():
            break
        y = product(v)
        alpha = (v * y).sum(0)
        y = y - alpha * v - beta * v_old
        beta_new = norm(y)
        r1 = c * alpha - c_old * s * beta
        r2 = s * alpha + c_old * c * beta
        r3 = s_old * beta
        size = np.hypot(r1, beta_new)
        live &= size > 0
        c_new, s_new = np.where(live, r1 / safe(size), 1.0), np.where(live, beta_new / safe(size), 0.0)
        w_new = (v - r3 * w_old - r2 * w) / safe(size)
        x = np.where(live, x + (c_new * eta) * w_new, x)
        eta = np.where(live, -s_new * eta, eta)
        v_old, v, beta = v, y / safe(beta_new), beta_new
        w_old, w = w, w_new
        c_old, c, s_old, s = c, c_new, s, s_new
        live &= (np.abs(eta) > small * start) & (beta_new > 1e-14 * np.abs(alpha))
    return x


def orthonormal(new: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Columns of ``new`` made orthonormal to ``basis`` and each other; dependent ones are left out."""
    out = np.zeros((len(new), 0))
    for column in new.T:
        size = np.linalg.norm(column)
        if not size > 0:
            continue
        column = column / size
        for _ in range(3):
            column = column - basis @ (basis.T @ column)
            column = column - out @ (out.T @ column)
            left = np.linalg.norm(column)
            if left < 1e-10:
                break
            column = column / left
        else:
            out = np.column_stack([out, column])
    return out


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], dimension: int, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """(values, vectors, largest residual) of the ``wanted`` largest eigenpairs of the symmetric operator behind ``product``.

    Residuals end below ``RESIDUAL`` times the largest eigenvalue, or where ``ROUNDS`` rounds end.
    """
    wanted = min(wanted, dimension)
    most = min(dimension, max(WIDTH * wanted, wanted + 8))
    basis = orthonormal(np.random.default_rng(seed).normal(size=(dimension, min(dimension, wanted + 4))), np.zeros((dimension, 0)))
    images = product(basis)
    locked, locked_images = np.zeros((dimension, 0)), np.zeros((dimension, 0))
    for _ in range(ROUNDS):
        # Rayleigh-Ritz over locked vectors and basis together: a locked pair stays, cleaned by what the basis adds
        whole, image = np.column_stack([locked, basis]), np.column_stack([locked_images, images])
        small = whole.T @ image
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        ritz, ritz_images = whole @ turns, image @ turns
        top = ritz_images[:, :wanted] - ritz[:, :wanted] * values[:wanted]
        residual = np.sqrt((top * top).sum(0))
        limit = RESIDUAL * max(values[0], 0.0)
        done = residual <= limit
        if done.all() or whole.shape[1] >= dimension:
            break
        kept = ritz.shape[1] if ritz.shape[1] + (~done).sum() <= most else min(ritz.shape[1], wanted + 4)
        locked, locked_images = ritz[:, :wanted][:, done], ritz_images[:, :wanted][:, done]
        rest = np.r_[np.flatnonzero(~done), wanted:kept].astype(int)
        basis, images = ritz[:, rest], ritz_images[:, rest]
        open_, theta = ritz[:, :wanted][:, ~done], values[:wanted][~done]
        away = np.column_stack([locked, open_])  # orthonormal: all of them are Ritz vectors of one problem

        def projected(block: np.ndarray) -> np.ndarray:
            block = block - away @ (away.T @ block)
            block = product(block) - block * theta
            return block - away @ (away.T @ block)

        r = top[:, ~done] - away @ (away.T @ top[:, ~done])
        fresh = orthonormal(minres(projected, -r, INNER), np.column_stack([locked, basis]))
        if not fresh.shape[1]:  # corrections lie in the basis: go on from other directions
            fresh = orthonormal(np.random.default_rng(seed + basis.shape[1]).normal(size=(dimension, 1)), np.column_stack([locked, basis]))
        basis, images = np.column_stack([basis, fresh]), np.column_stack([images, product(fresh)])
    return values[:wanted], ritz[:, :wanted], float(residual.max(initial=0.0))


def spectrum(rows: DataFrame, components: int = COMPONENTS) -> Spectrum:
    """Leading eigenpairs of the covariance of the whole numbers in ``x``, divisor n; directions without variance are left out."""
    first = rows.select(F.size("x").alias("d")).first()
    d = first.d if first else 0
    n, sums = exact_sums(rows, d)
    if not n:
        return Spectrum(0, (), np.zeros(0), np.zeros((0, 0)), 0.0, 0.0, 0)
    mean = np.array([s / n for s in sums])
    trace = float(_summed(rows, lambda x: ((x - mean) ** 2).sum(0), (d,)).sum() / n)
    jobs = 0

    def product(block: np.ndarray) -> np.ndarray:
        nonlocal jobs
        jobs += 1
        sent = rows.sparkSession.sparkContext.broadcast(block)

        def part(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ sent.value)

        out = _summed(rows, part, block.shape) / n
        sent.unpersist()
        return out

    values, vectors, residual = jacobi_davidson(product, d, components)
    flat = values > FLAT * max(float(values[0]), 0.0)
    flat &= values > 0
    return Spectrum(n, sums, values[flat], vectors[:, flat], trace, residual, jobs)


def identity_error(rows: DataFrame, found: Spectrum) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity."""
    k = len(found.values)
    if not k:
        return 0.0
    turn, mean = found.vectors / np.sqrt(found.values), found.mean

    def part(x: np.ndarray) -> np.ndarray:
        white = (x - mean) @ turn
        return np.vstack([white.T @ white, white.sum(0)])

    both = _summed(rows, part, (k + 1, k)) / found.rows
    return float(np.abs(both[:k] - np.outer(both[k], both[k]) - np.eye(k)).max())


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Exact sum of (n * x - S)^2 of each row; null where it does not fit 64 bits."""
    reach = max(max((abs(v) for v in x.ravel().tolist()), default=0) * n + max(map(abs, sums)), 1)
    if reach * reach * x.shape[1] < 1 << 63:
        return ((x * n - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    exact = [sum((v * n - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): one row per usable vector and component.

    Which rows are usable says ``quantised``; the others are in no result. There are as many components as directions with
    variance, ``components`` at most, so a table whose vectors are all equal, or empty, has no row. ``key`` stays as it is, null
    or repeated; other columns are not read, whatever their names.
    """
    rows = quantised(vectors, key, vector)
    found = spectrum(rows, components)
    error = identity_error(rows, found)
    n, sums, mean, k = found.rows, found.sums, found.mean, len(found.values)
    turn = found.vectors / np.sqrt(found.values)
    explained = found.values / found.trace if k else found.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            if not piece.num_rows or not k:
                continue
            x = _matrix(piece)
            times = np.repeat(np.arange(piece.num_rows), k)
            again = lambda a: pa.array(np.tile(a, piece.num_rows))
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("key").take(pa.array(times)),
                    again(np.arange(1, k + 1, dtype=np.int32)),
                    pa.array(np.full(len(times), n, np.int64)),
                    pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(times)),
                    pa.array(((x - mean) @ turn).ravel()),
                    again(explained),
                    pa.array(np.full(len(times), error)),
                ],
                names,
            )

    schema = T.StructType([
        T.StructField(key, vectors.schema[key].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()),
        T.StructField("identity_error", T.DoubleType()),
    ])
    names = schema.names
    return rows.mapInArrow(run, schema)
