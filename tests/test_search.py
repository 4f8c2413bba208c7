"""Guided trials: a Gaussian process through all trials before each."""

import math
import random

import numpy as np
import pytest

from vigil.operators import classify

BOUNDS = {"x": (0.0, 1.0), "n": (1, 30), "kind": ["p", "q", "r"]}


def test_each_guided_trial_is_proposed_from_all_trials_before_it(monkeypatch):
    seen, real = [], classify.propose
    monkeypatch.setattr(classify, "propose", lambda trials, *a: seen.append(len(trials)) or real(trials, *a))
    classify.guided_search(lambda p: p["x"], BOUNDS, 20, 5, 1, parallelism=4)
    assert seen == [20, 21, 22, 23, 24]


def test_surface_is_that_of_a_gaussian_process():
    rng = np.random.default_rng(0)
    x, y, at = rng.random((9, 3)), rng.normal(size=9), rng.random((4, 3))
    s = classify.Surrogate(x, y)

    def kernel(a, b):
        d = math.sqrt(5) * math.dist(a, b) / s.scale
        return (1 + d + d * d / 3) * math.exp(-d)
    inverse = np.linalg.inv(np.array([[kernel(a, b) for b in x] for a in x]) + 1e-6 * np.eye(9))
    value, deviation = s(at)
    for i, p in enumerate(at):
        k = np.array([kernel(p, a) for a in x])
        assert value[i] == pytest.approx(y.mean() + k @ inverse @ (y - y.mean()), abs=1e-4)
        assert deviation[i] == pytest.approx(y.std() * math.sqrt(1 - k @ inverse @ k), abs=1e-4)
    assert np.allclose(s(x)[0], y, atol=1e-3) and (s(x)[1] < 0.01).all()  # it passes through the trials


def test_proposal_has_the_largest_upper_bound():
    rng = random.Random(3)
    trials = [(p, -(p["x"] - 0.7) ** 2 + 0.1 * (p["kind"] == "q")) for p in (classify.draw(BOUNDS, rng) for _ in range(20))]
    s = classify.Surrogate(np.array([classify.unit(p, BOUNDS) for p, _ in trials]), np.array([v for _, v in trials]))

    def bound(points):
        value, deviation = s(np.array([classify.unit(p, BOUNDS) for p in points]))
        return value + 2.576 * deviation
    assert bound([classify.propose(trials, BOUNDS, rng)])[0] >= bound([classify.draw(BOUNDS, rng) for _ in range(5000)]).max()


def test_trials_of_equal_value():
    trials = [(classify.draw(BOUNDS, random.Random(i)), 50.0) for i in range(3)] * 2
    assert classify.propose(trials, BOUNDS, random.Random(1))["n"] in range(1, 31)
