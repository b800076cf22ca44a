"""Order statistics of many index ranges of one sequence, without looking at the points of a range."""
from __future__ import annotations

import numpy as np

QUERIES = 1 << 14


class WaveletMatrix:
    """Bit planes of rank-compressed values, highest bit first, each with the zeros before every place.

    The k-th smallest value of any range comes out of one step per plane. All queries go down together, so the work is
    proportional to (points + queries) times the planes, whatever the length of the ranges.
    """

    def __init__(self, values: np.ndarray) -> None:
        self.values, ranks = np.unique(values, return_inverse=True)
        ranks = ranks.astype(np.int32)
        self._zeros: list[np.ndarray] = []
        self._planes = max(1, (len(self.values) - 1).bit_length())
        for plane in reversed(range(self._planes)):
            clear = (ranks >> plane) & 1 == 0
            self._zeros.append(np.concatenate([[0], np.cumsum(clear)]).astype(np.int32))
            ranks = np.concatenate([ranks[clear], ranks[~clear]])

    def kth(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value with ``k`` others before it among the sorted values of [low, high)."""
        found = np.zeros(len(low), np.int64)
        for plane, zeros in zip(reversed(range(self._planes)), self._zeros):
            before, upto = zeros[low], zeros[high]
            inside = upto - before
            one = k >= inside
            k = np.where(one, k - inside, k)
            low = np.where(one, zeros[-1] + low - before, before)
            high = np.where(one, zeros[-1] + high - upto, upto)
            found |= one.astype(np.int64) << plane
        return self.values[found]


def sliding_stats(times: np.ndarray, values: np.ndarray, width: float, wanted: np.ndarray) -> np.ndarray:
    """Count, index quartiles, median and MAD of the values within ``width`` before and at each wanted place.

    ``times`` ascend; points at the same time count together. One row of (n, q1, q3, median, mad) per place in ``wanted``.
    """
    matrix = WaveletMatrix(values)
    high_all = np.searchsorted(times, times[wanted], "right")
    low_all = np.searchsorted(times, times[wanted] - width, "left")
    out = np.zeros((len(wanted), 5))
    for at in range(0, len(wanted), QUERIES):
        low, high = low_all[at : at + QUERIES], high_all[at : at + QUERIES]
        n = high - low
        kth = lambda k: matrix.kth(low, high, k)  # noqa: B023, E731
        middle = (kth((n - 1) // 2) + kth(n // 2)) / 2
        out[at : at + QUERIES] = np.column_stack([n, kth(n // 4), kth(3 * n // 4), middle, _mad(matrix, low, high, middle)])
    return out


def _mad(matrix: WaveletMatrix, low: np.ndarray, high: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """Median distance from ``middle``, the ranges' median.

    Distances ascend to the left and to the right of the median, so the first half of all distances is the first ``a`` on the
    left and the rest on the right; ``a`` is found by bisection.
    """
    n = high - low
    left = (n + 1) // 2  # values at or below the median
    right = n - left
    take = (n - 1) // 2 + 1
    far = np.inf

    def distance(j: np.ndarray, side: int) -> np.ndarray:
        """The j-th distance on a side; -inf before the first, inf after the last."""
        size = left if side < 0 else right
        place = left - 1 - j if side < 0 else left + j
        value = matrix.kth(low, high, np.clip(place, 0, n - 1))
        own = middle - value if side < 0 else value - middle
        return np.where(j < 0, -far, np.where(j >= size, far, own))

    first, last = np.maximum(0, take - right), np.minimum(take, left)
    while (first < last).any():
        a = (first + last) // 2
        more = distance(a, -1) < distance(take - a - 1, 1)  # the next on the left comes before the last taken on the right
        first, last = np.where(more & (first < last), a + 1, first), np.where(more, last, a)
    lower = np.maximum(distance(first - 1, -1), distance(take - first - 1, 1))
    upper = np.minimum(distance(first, -1), distance(take - first, 1))
    return np.where(n % 2 == 1, lower, (lower + np.where(np.isfinite(upper), upper, lower)) / 2)
