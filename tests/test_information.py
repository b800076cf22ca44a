"""Nearest-neighbour information against a brute-force version."""
import math
import random

import pytest

from millrace.operators import information as I


def _psi(n):
    return -0.57721566490153286 + math.fsum(1 / j for j in range(1, n))


def _brute(rows, k):
    rows = [(y, x) for y, x in rows if y is not None and x is not None and not math.isnan(x)]
    sizes = {y: sum(a == y for a, _ in rows) for y, _ in rows}
    rows = [(y, x) for y, x in rows if sizes[y] > 1]
    if not rows:
        return None
    total = []
    for i, (y, x) in enumerate(rows):
        own = min(k, sizes[y] - 1)
        r = sorted(abs(b - x) for j, (a, b) in enumerate(rows) if a == y and j != i)[own - 1]
        m = sum(abs(b - x) < r or (r == 0 and b == x) for _, b in rows)
        total.append(_psi(own) - _psi(sizes[y]) - _psi(m))
    return max(0.0, _psi(len(rows)) + math.fsum(total) / len(rows))


@pytest.mark.parametrize("leaf", [40, 65536])
def test_information_equals_brute_force(spark, leaf):
    rng, rows = random.Random(4), []
    for _ in range(700):
        y = "hot" if rng.random() < 0.6 else rng.choice(["a", "b", "c", None])
        shift = {"hot": 0.0, "a": 1.5, "b": 4.0}.get(y, 0.0)
        rows.append((y, rng.gauss(shift, 1), float(rng.randrange(6)), rng.choice([None, 0.1 * rng.randrange(30), float("nan")])))
    rows.append(("single", 0.5, 1.0, 2.0))
    got = {r["column"]: r.mi for r in I.nearest_information(spark.createDataFrame(rows, "y string, u double, v double, w double"), ["u", "v", "w"], "y", 3, leaf).collect()}
    for at, name in enumerate("uvw", 1):
        assert got[name] == pytest.approx(_brute([(r[0], r[at]) for r in rows], 3), abs=1e-9)
    assert got["u"] > 0.2 > got["v"]


def test_information_of_small_tables(spark):
    schema = "y string, u double"
    assert I.nearest_information(spark.createDataFrame([], schema), ["u"], "y").count() == 0
    assert I.nearest_information(spark.createDataFrame([("a", 1.0), ("b", 2.0)], schema), ["u"], "y").count() == 0
    rows = [("a", 1.0), ("a", 1.0), ("b", 5.0), ("b", 6.0)]
    got = I.nearest_information(spark.createDataFrame(rows, schema), ["u"], "y").first()
    assert got.mi == pytest.approx(_brute(rows, 3), abs=1e-12)
