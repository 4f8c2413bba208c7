"""Supervised classifiers.

``fit_predict`` fits one independent model per target (machine status, failure
type) and predicts the test rows. Boosting and AdaBoost are ``boosting``, the
forest is ``bagging`` and the neural network ``neural``; each trains all
targets in the same passes over the data. Nothing is collected to the driver
except models and bounded sums.
"""

from __future__ import annotations

import math
import random
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import DataFrame

from . import bagging, boosting, neural, stats

SEED = 123


def assembled(train: DataFrame, features, classes, keys):
    """(cuts, kept blocks) of the training rows, for all passes of all forests."""
    return bagging.binned(train, features, classes, keys)


def fit_predict(train: DataFrame, test: DataFrame, kind: str, classes: dict[str, int], features, keys, params: dict | None = None) -> DataFrame:
    """``test`` with ``pred_<target>`` for every target of ``classes`` (column
    -> number of class codes). ``keys`` identify a row; ``kind`` is gbt,
    adaboost, forest or mlp, with ``params`` named as in the searches."""
    p = dict(params or {})
    if kind == "gbt":
        model = boosting.fit_boosting(train, features, classes, keys, rounds=int(p.get("n_estimators", 80)), depth=int(p.get("max_depth", 3)),
                                      rate=float(p.get("learning_rate", 0.1)), subsample=float(p.get("subsample", 1.0)), max_features=float(p.get("max_features", 1.0)))
        return boosting.predict_boosting(model, test)
    if kind == "adaboost":
        model = boosting.fit_adaboost(train, features, classes, keys, rounds=int(p.get("n_estimators", 80)), rate=float(p.get("learning_rate", 1.0)))
        return boosting.predict_adaboost(model, test)
    if kind == "mlp":
        return neural.predict_mlp(neural.fit_mlp(train, features, classes, keys, **p), test)
    if kind == "forest":
        cuts, base = assembled(train, features, classes, keys)
        trees, depth = int(p.get("n_estimators", 80)), int(p.get("max_depth", 8))
        model = bagging.fit_forest(cuts, base, classes, trees, depth, str(p.get("max_features", "0.9")), SEED)
        base.unpersist()
        return bagging.predict_forest(model, test, trees, depth)
    raise ValueError(kind)


# -------------------------------------------------------------- search
def space(kind: str, n_features: int) -> dict[str, tuple]:
    """Bounds of each family's parameters: (low, high) for numbers (whole ones
    where both bounds are), a list for choices."""
    if kind == "gbt":
        return {"max_depth": (2, 10), "max_features": (0.8, 1.0), "learning_rate": (0.01, 1.0), "n_estimators": (80, 150), "subsample": (0.8, 1.0)}
    if kind == "adaboost":
        return {"learning_rate": (0.01, 1.0), "n_estimators": (80, 150)}
    if kind == "forest":
        return {"max_depth": (3, 10), "max_features": (0.8, 1.0), "n_estimators": (80, 150)}
    if kind == "mlp":
        return {"validation_fraction": (0.0, 0.99), "momentum": (0.0, 1.0), "batch_size": (16, 256), "early_stopping": [True, False],
                "schedule": ["constant", "invscaling", "adaptive"], "activation": ["identity", "logistic", "tanh", "relu"], "solver": ["lbfgs", "sgd", "adam"],
                "neurons1": (n_features, int(5 / 2 * n_features)), "neurons2": (int(2 / 3 * n_features), int(3 / 2 * n_features)),
                "neurons3": (int(1 / 2 * n_features), n_features), "layers": (1, 3), "max_iter": (2000, 5000), "alpha": (0.00001, 0.01)}
    raise ValueError(kind)


def model_params(kind: str, p: dict) -> dict:
    """Parameters of ``fit_predict`` from a point of the space."""
    if kind != "mlp":
        return {k: str(v) if kind == "forest" and k == "max_features" else v for k, v in p.items()}
    out = {k: v for k, v in p.items() if k != "layers" and not k.startswith("neurons")}
    return out | {"hidden": tuple(p[f"neurons{i}"] for i in range(1, p["layers"] + 1))}


def draw(bounds: dict, rng: random.Random) -> dict:
    out = {}
    for name, b in bounds.items():
        if isinstance(b, list):
            out[name] = rng.choice(b)
        else:
            out[name] = rng.randint(*b) if all(isinstance(v, int) for v in b) else rng.uniform(*b)
    return out


def unit(p: dict, bounds: dict) -> np.ndarray:
    """A point as numbers from 0 to 1: one a number, one a choice."""
    out = []
    for name, b in bounds.items():
        out += [float(p[name] == c) for c in b] if isinstance(b, list) else [(p[name] - b[0]) / ((b[1] - b[0]) or 1)]
    return np.array(out)


class Surrogate:
    """Gaussian process (Matern 5/2, values brought to mean 0 and spread 1)
    through the trials, with the length scale of the largest likelihood."""

    def __init__(self, x: np.ndarray, y: np.ndarray, noise: float = 1e-6):
        self.x, self.mean, self.spread = x, y.mean(), y.std() or 1.0
        z, best = (y - self.mean) / self.spread, -np.inf
        for scale in np.geomspace(0.05, 20, 60):
            low = np.linalg.cholesky(self._kernel(x, scale) + noise * np.eye(len(x)))
            solved = np.linalg.solve(low.T, np.linalg.solve(low, z))
            likelihood = -0.5 * z @ solved - np.log(np.diag(low)).sum()
            if likelihood > best:
                best, self.scale, self.low, self.solved = likelihood, scale, low, solved

    def _kernel(self, x: np.ndarray, scale: float) -> np.ndarray:
        d = np.sqrt(5 * ((x[:, None] - self.x[None]) ** 2).sum(axis=2)) / scale
        return (1 + d + d * d / 3) * np.exp(-d)

    def __call__(self, x: np.ndarray):
        """(expected value, standard deviation) at points."""
        k = self._kernel(x, self.scale)
        gone = np.linalg.solve(self.low, k.T)
        return self.mean + self.spread * (k @ self.solved), self.spread * np.sqrt(np.maximum(1 - (gone ** 2).sum(axis=0), 0))


def propose(trials: list[tuple[dict, float]], bounds: dict, rng: random.Random, tries: int = 10_000, kappa: float = 2.576) -> dict:
    """The point of the largest upper confidence bound (expected value plus
    ``kappa`` deviations) of a Gaussian process through the trials: the best of
    ``tries`` drawn points, bettered by ever smaller steps around the best ten."""
    surface = Surrogate(np.array([unit(p, bounds) for p, _ in trials]), np.array([v for _, v in trials]))

    def ranked(points):
        value, deviation = surface(np.array([unit(p, bounds) for p in points]))
        return [points[i] for i in np.argsort(-(value + kappa * deviation), kind="stable")]

    def near(p, width):
        fresh = draw(bounds, rng)
        for name, b in bounds.items():
            if isinstance(b, list):
                fresh[name] = p[name] if rng.random() < 0.75 else fresh[name]
            else:
                v = min(b[1], max(b[0], rng.gauss(p[name], width * (b[1] - b[0]))))
                fresh[name] = round(v) if all(isinstance(e, int) for e in b) else v
        return fresh
    best = ranked([draw(bounds, rng) for _ in range(tries)])[:10]
    for width in (0.1, 0.03, 0.01, 0.003):
        best = ranked(best + [near(p, width) for p in best for _ in range(50)])[:10]
    return best[0]


def guided_search(objective, bounds: dict, n_random: int = 20, n_guided: int = 5, seed: int = 111, parallelism: int = 4, ahead=None) -> list[dict]:
    """``n_random`` seeded trials, ``parallelism`` at a time, then ``n_guided``,
    one after the other: each is proposed from all trials before it. A trial is
    params, value, guided. ``ahead`` gets the points of trials before they run."""
    rng, done = random.Random(seed), []

    def run(pool, points, guided):
        if ahead:
            ahead(points)
        done.extend((p, v, guided) for p, v in zip(points, pool.map(objective, points), strict=True))
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        run(pool, [draw(bounds, rng) for _ in range(n_random)], False)
        for _ in range(n_guided):
            run(pool, [propose([(p, v) for p, v, _ in done], bounds, rng)], True)
    return [{"trial": i, "params": p, "value": v, "guided": g} for i, (p, v, g) in enumerate(done)]


class ForestTrials:
    """The forests of a search on one binned table. Draws depend on the row and
    the tree only, so a trial's forest is the first trees of a larger one, cut
    off at its depth: each tree grows once, as deep as any trial needs it."""

    def __init__(self, train: DataFrame, classes: dict, features, keys):
        self.classes, self.names = classes, list(features)
        self.cuts, self.base = assembled(train, self.names, classes, keys)
        self.forests: dict[int, bagging.Forest] = {}

    def _of(self, p: dict):
        trees, depth = int(p.get("n_estimators", 80)), int(p.get("max_depth", 8))
        return bagging.features_per_node(str(p.get("max_features", "0.9")), len(self.names), trees), trees, depth

    def grow(self, points: list[dict]) -> None:
        need: dict[int, list] = {}
        for take, trees, depth in map(self._of, points):
            had = need.setdefault(take, [])
            had += [0] * (trees - len(had))
            had[:trees] = [max(d, depth) for d in had[:trees]]
        for take, depths in need.items():
            bagging.grow(self.base, self.forests.setdefault(take, bagging.Forest(self.cuts, self.classes, take, SEED)), depths)

    def predict(self, on: DataFrame, p: dict) -> DataFrame:
        take, trees, depth = self._of(p)
        return bagging.predict_forest(self.forests[take], on, trees, depth)


def search(train: DataFrame, kind: str, target: str, classes: dict[str, int], features, keys, n_random: int = 20, n_guided: int = 5,
           objective_on: DataFrame | None = None, parallelism: int = 4, fixed: dict | None = None) -> list[dict]:
    """Trials of one family; a trial is a fit, its value the balanced accuracy
    of ``target`` on ``objective_on`` (the training rows, as the reference)."""
    on, own = objective_on if objective_on is not None else train, {target: classes[target]}
    params = lambda p: model_params(kind, p) | (fixed or {})
    shared = ForestTrials(train, own, features, keys) if kind == "forest" else None

    def objective(p):
        pred = shared.predict(on.select(*features, target), params(p)) if shared else fit_predict(train, on, kind, own, features, keys, params(p))
        return float(stats.multiclass_metrics(pred, target, f"pred_{target}").first()["balanced_accuracy"] or 0.0)
    try:
        return guided_search(objective, space(kind, len(features)), n_random, n_guided, parallelism=parallelism,
                             ahead=(lambda points: shared.grow([params(p) for p in points])) if shared else None)
    finally:
        if shared:
            shared.base.unpersist()
