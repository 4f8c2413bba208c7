"""Leaves of trees against a walk row by row, and how long they take."""

import time

import numpy as np
import pytest

from vigil.operators import boosting


def walk(bins, feature, cut, levels):
    """Each row's split looked up at every level."""
    node, first, rows = np.zeros(len(bins), np.int64), 0, np.arange(len(bins))
    for d in range(levels):
        at = first + node
        f = feature[at]
        node = 2 * node + ((f >= 0) & (bins[rows, f] > cut[at]))
        first += 1 << d
    return node


def tree(rng, levels, features):
    n = (1 << levels) - 1
    return rng.integers(-1, features, n), rng.integers(0, 65, n).astype(np.uint8)


@pytest.mark.parametrize("levels", [0, 1, 3, 4, 5, 9])
@pytest.mark.parametrize("order", ["C", "F"])
def test_leaves_are_those_of_a_walk(levels, order):
    rng = np.random.default_rng(levels)
    bins = np.array(rng.integers(0, 66, (2000, 6)), np.uint8, order=order)
    feature, cut = tree(rng, levels, 6)
    got = boosting.leaf_of(bins, feature, cut, levels)
    assert got.dtype == np.int64 and (got == walk(bins, feature, cut, levels)).all()
    assert len(boosting.leaf_of(bins[:0], feature, cut, levels)) == 0


def test_scores_of_many_rounds_take_a_fraction_of_a_walk():
    rng = np.random.default_rng(0)
    bins = rng.integers(0, 65, (10_000, 6)).astype(np.uint8)
    rounds = [(*(np.stack(v) for v in zip(*(tree(rng, 3, 6) for _ in range(7)), strict=True)), rng.normal(size=(7, 8))) for _ in range(20)]

    def slow():
        score = np.zeros((len(bins), 7))
        for feature, cut, leaf in rounds:
            for c in range(7):
                score[:, c] += leaf[c][walk(bins, feature[c], cut[c], 3)]
        return score

    def seconds(fn):
        best = np.inf
        for _ in range(3):
            began = time.perf_counter()
            fn()
            best = min(best, time.perf_counter() - began)
        return best
    assert (boosting.add_trees(np.zeros((len(bins), 7)), bins, rounds) == slow()).all()
    assert 2 * seconds(lambda: boosting.add_trees(np.zeros((len(bins), 7)), bins, rounds)) < seconds(slow)
