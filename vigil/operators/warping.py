"""Dynamic time warping of whole batches of series (items 65, 66, 68).

A cell of the cost table depends on three neighbours that lie on the two
anti-diagonals before it, so all cells of an anti-diagonal are computed at once,
and for all series of a block: a pair of lengths n and m takes n + m numpy steps
for a whole block instead of n x m steps a pair. Point cost is the squared
difference; infinite cost lies outside the table.

``nearest`` measures the centroid with the least lower bound first and skips a
centroid whose bound exceeds the best distance so far. Every point of one series
is matched with some point of the other, so its distance to the other's range
(the envelope of an unconstrained path) bounds the cost from below.
"""

from __future__ import annotations

import numpy as np

#: Cells that the tables of one block may hold together.
BLOCK_CELLS = 1 << 22


def by_length(series, cells: int = BLOCK_CELLS, other: int = 1):
    """(indices, matrix) of equally long series, in blocks bounded by cells."""
    size = np.array([len(v) for v in series], np.int64)
    for m in np.unique(size):
        at = np.flatnonzero(size == m)
        step = max(1, cells // max(1, int(m) * other))
        for a in range(0, len(at), step):
            own = at[a:a + step]
            yield own, np.array([series[i] for i in own], np.float64).reshape(len(own), int(m))


def _diagonals(c: np.ndarray, x: np.ndarray):
    """(first row, last row + 1, point costs) of every anti-diagonal. Row i of
    diagonal s is the cell (i, s - i) of the table of c against each x."""
    n, m = len(c), x.shape[1]
    for s in range(n + m - 1):
        lo, hi = max(0, s - m + 1), min(n, s + 1)
        yield lo, hi, (c[lo:hi] - x[:, s - np.arange(lo, hi)]) ** 2


def dtw_costs(c: np.ndarray, x: np.ndarray, steps: np.ndarray | None = None) -> np.ndarray:
    """DTW cost of ``c`` to each row of ``x``. ``steps`` (rows, n, m) takes the
    move into each cell: 0 from the diagonal, 1 from above, 2 from the left."""
    n, rows = len(c), len(x)
    one, two = np.full((rows, n + 1), np.inf), np.full((rows, n + 1), np.inf)  # the last two diagonals, shifted by one row
    two[:, 0] = 0.0  # the corner before the first cell
    for s, (lo, hi, cost) in enumerate(_diagonals(c, x)):
        moves = two[:, lo:hi], one[:, lo:hi], one[:, lo + 1:hi + 1]
        best = np.minimum(np.minimum(moves[1], moves[2]), moves[0])
        if steps is not None:
            kind = np.where(moves[0] == best, 0, np.where(moves[1] == best, 1, 2))
            i = np.arange(lo, hi)
            steps[:, i, s - i] = kind
        new = np.full((rows, n + 1), np.inf)
        new[:, lo + 1:hi + 1] = cost + best
        one, two = new, one
    return one[:, n] if n and x.shape[1] else np.full(rows, 0.0 if n == x.shape[1] else np.inf)


def dtw_distance(a, b) -> float:
    """DTW cost of one pair."""
    return float(dtw_costs(np.asarray(a, float), np.asarray(b, float)[None])[0])


def align(c: np.ndarray, x: np.ndarray):
    """For each row of ``x``: sums and counts of its points matched with each
    point of ``c`` on the best path (its part of the barycenter average)."""
    rows, n, m = len(x), len(c), x.shape[1]
    steps = np.zeros((rows, n, m), np.int8)
    dtw_costs(c, x, steps)
    total, count = np.zeros((rows, n)), np.zeros((rows, n))
    i, j, r = np.full(rows, n - 1), np.full(rows, m - 1), np.arange(rows)
    while len(r):
        total[r, i] += x[r, j]
        count[r, i] += 1
        move = steps[r, i, j]
        more = (i > 0) | (j > 0)
        i, j = i - (move != 2), j - (move != 1)
        r, i, j = r[more], i[more], j[more]
    return total, count


def soft_costs(c: np.ndarray, x: np.ndarray, gamma: np.ndarray, gradient: bool = False):
    """Soft-DTW value of ``c`` to each row of ``x`` and, if asked for, its
    gradient by ``c``. The soft minimum of a cell gives each of its three moves
    a weight; going back, these share out how much each cell matters."""
    n, (rows, m) = len(c), x.shape
    g = gamma[:, None]
    one, two = np.full((rows, n + 1), np.inf), np.full((rows, n + 1), np.inf)
    two[:, 0] = 0.0
    weights = []
    with np.errstate(invalid="ignore", over="ignore"):
        for lo, hi, cost in _diagonals(c, x):
            moves = two[:, lo:hi], one[:, lo:hi], one[:, lo + 1:hi + 1]
            least = np.minimum(np.minimum(moves[1], moves[2]), moves[0])
            parts = [np.exp((least - v) / g) for v in moves]  # 0 for what lies outside
            total = parts[0] + parts[1] + parts[2]
            new = np.full((rows, n + 1), np.inf)
            new[:, lo + 1:hi + 1] = cost + least - g * np.log(total)
            if gradient:
                weights.append([p / total for p in parts])
            one, two = new, one
    value = one[:, n]
    if not gradient:
        return value, None
    # how much each cell of the last two diagonals matters, and passes on by each move
    out = np.zeros((rows, n))
    after, corner = np.zeros((2, rows, n + 1)), np.zeros((rows, n + 1))  # to rows i (left, above) and i - 1 (diagonal)
    for s in range(n + m - 2, -1, -1):
        lo, hi = max(0, s - m + 1), min(n, s + 1)
        e = after[0, :, lo:hi] + after[1, :, lo + 1:hi + 1] + corner[:, lo + 1:hi + 1]
        if s == n + m - 2:
            e = e + 1.0
        diagonal, above, left = weights[s]
        out[:, lo:hi] += e * (c[lo:hi] - x[:, s - np.arange(lo, hi)])
        corner = np.zeros((rows, n + 1)) if s == n + m - 2 else passed
        passed = np.zeros((rows, n + 1))
        passed[:, lo:hi] = e * diagonal
        after = np.zeros((2, rows, n + 1))
        after[0, :, lo:hi], after[1, :, lo:hi] = e * left, e * above
    return value, 2 * out


def lower_bounds(c: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A bound below the DTW cost of ``c`` to each row of ``x``: what the points
    of either lie outside the range of the other."""
    outside = lambda v, low, high: (np.maximum(0, np.maximum(v - high, low - v)) ** 2).sum(axis=1)
    return np.maximum(outside(x, c.min(), c.max()), outside(np.broadcast_to(c, (len(x), len(c))), x.min(axis=1, keepdims=True), x.max(axis=1, keepdims=True)))


def nearest(centroids, x: np.ndarray):
    """(index, cost, measured) of each row's nearest centroid, ties to the
    first; ``measured`` counts the costs that had to be computed."""
    bounds = np.stack([lower_bounds(c, x) for c in centroids], axis=1)
    order = np.argsort(bounds, axis=1, kind="stable")
    rows = np.arange(len(x))
    best, index, measured = np.full(len(x), np.inf), np.full(len(x), len(centroids)), 0
    for k in range(len(centroids)):
        own = order[:, k]
        # a margin for sums in another order: skip only what lies clearly above
        open_ = ~(bounds[rows, own] * (1 - 1e-12) > best)
        for c in np.unique(own[open_]):
            at = np.flatnonzero(open_ & (own == c))
            d = dtw_costs(centroids[c], x[at])
            measured += len(at)
            better = (d < best[at]) | ((d == best[at]) & (c < index[at]))
            best[at[better]], index[at[better]] = d[better], c
    return index, best, measured
