"""Boosted trees on binned features (items 77 and 78).

Features are cut at exact quantiles into at most ``BINS`` bins, once. The
training rows then live in blocks of bytes (``functions/blocks.py``), and every
pass adds up histograms on the executors: one cell per (score column, tree
node, feature, bin). Partial histograms meet in an ordinary grouped sum, and
the driver sees only the summed cells, whose number does not depend on the
rows, and picks the splits from them.

Gradient boosting is multinomial (binomial for two classes): all classes and
all targets grow their trees in the same passes, one pass for each level.
Gradients are added up as integers (2^-20), so the trees do not depend on how
rows are partitioned. Scores are recomputed from a base that is written anew
every ``REBASE`` rounds.

AdaBoost is SAMME on stumps: one pass a round, whose class histogram gives the
best stump and its weighted error at once.

Rows with a null feature take a bin of their own behind all others; rows
without a class are not trained on. A target with one class predicts it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..functions.quantiles import group_quantiles

BINS = 64
REBASE = 20
NARROW = 4  # levels whose nodes are compared one by one
UNIT = float(1 << 20)
CHUNK = 1 << 15  # rows taken at a time
ROW = float(1 << 34)  # a row in a sum that it shares with curvatures


# ------------------------------------------------------------------- binning
def quantile_cuts(df: DataFrame, features, bins: int = BINS) -> dict[str, list[float]]:
    """The distinct i/bins quantiles of each feature: at most bins - 1 numbers
    each. Nulls do not count."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features])).alias("f")).select("f.*")
    got = group_quantiles(long, "feature", "value", [i / bins for i in range(1, bins)]).collect()
    found = {r["feature"]: sorted(set(r["_q"])) for r in got}
    return {c: found.get(c, []) for c in features}


def encode(cuts: dict[str, list[float]]):
    """Matrix -> bins as bytes: how many cuts lie below; null behind all."""
    arrays = [np.asarray(c, float) for c in cuts.values()]

    def fn(x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint8)
        for j, c in enumerate(arrays):
            out[:, j] = np.where(np.isnan(x[:, j]), len(c) + 1, np.searchsorted(c, x[:, j], side="left"))
        return out
    return fn


def columns_of(classes: dict[str, int]) -> dict[str, slice]:
    """Score columns of each target: one for two classes, else one a class."""
    out, at = {}, 0
    for t, k in classes.items():
        n = 1 if k <= 2 else k
        out[t] = slice(at, at + n)
        at += n
    return out


# ------------------------------------------------------------- kernels (tasks)
def leaf_of(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Node that each row reaches after ``levels`` levels; a node's split sends
    bins above its cut to the right, and nowhere when its feature is -1. The
    upper levels compare whole columns and choose among the answers of a level
    by those above (fast on bins stored by column), deeper ones look up each
    row's split."""
    node, first, path = np.zeros(len(bins), np.uint8), 0, []
    for d in range(min(levels, NARROW)):
        said = [bins[:, feature[first + k]] > cut[first + k] if feature[first + k] >= 0 else None for k in range(1 << d)]
        for right in reversed(path):
            said = [_chosen(a, b, right) for a, b in zip(said[::2], said[1::2], strict=True)]
        path.append(said[0] if said[0] is not None else np.zeros(len(bins), bool))
        node *= np.uint8(2)
        node += path[-1].view(np.uint8)
        first += 1 << d
    node = node.astype(np.int64)
    rows = np.arange(len(bins)) if levels > NARROW else None
    for d in range(NARROW, levels):
        at = first + node
        f = feature[at]
        node = 2 * node + ((f >= 0) & (bins[rows, f] > cut[at]))
        first += 1 << d
    return node


def _chosen(a, b, right: np.ndarray):
    """``b`` where ``right``, else ``a``; None is false everywhere."""
    if a is None or b is None:
        return a & ~right if a is not None else b & right if b is not None else None
    return a ^ ((a ^ b) & right)


def add_trees(score: np.ndarray, bins: np.ndarray, rounds) -> np.ndarray:
    """``score`` plus the leaves of whole rounds (feature, cut, leaf arrays);
    fast on scores stored by column."""
    bins = np.asfortranarray(bins)
    for feature, cut, leaf in rounds:
        levels = int(leaf.shape[1]).bit_length() - 1
        for c in range(score.shape[1]):
            own = score[:, c]
            own += leaf[c].take(leaf_of(bins, feature[c], cut[c], levels))
    return score


def gradients(score: np.ndarray, y: np.ndarray, classes: dict[str, int]):
    """(gradient, curvature) of the log-likelihood for each score column."""
    g, h = np.empty_like(score), np.empty_like(score)
    for (t, s), own in zip(columns_of(classes).items(), y.T, strict=True):
        f = score[:, s]
        if classes[t] <= 2:
            p = 1.0 / (1.0 + np.exp(-np.clip(f, -40, 40)))
            g[:, s] = (own == 1)[:, None] - p
        else:
            e = np.exp(f - f.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            g[:, s] = (own[:, None] == np.arange(classes[t])) - p
        h[:, s] = p * (1.0 - p)
    return g, h


def _scores(batch: pa.RecordBatch, i: int, columns: int, start: np.ndarray, rows: int) -> np.ndarray:
    """Scores of a block, stored by column."""
    at = batch.schema.get_field_index("score")
    if at < 0:
        return np.asfortranarray(np.broadcast_to(start, (rows, columns)))
    return np.frombuffer(batch.column(at)[i].as_buffer(), np.float64).reshape(columns, rows).T.copy(order="F")


# -------------------------------------------------------------------- boosting
class Boosting:
    """A fitted model: cuts, classes, starting scores and rounds of trees."""

    def __init__(self, cuts, classes, start):
        self.cuts, self.classes, self.start = cuts, classes, start
        self.rounds: list = []


def _chunks(batches, features: int, columns: int, start: np.ndarray, targets: int, share: float, salt: int):
    """(bins, scores, classes) of up to CHUNK rows at a time, of the sampled rows
    only, arrays stored by column."""
    some, n = [], 0

    def whole():
        x, score, y = (np.concatenate(v, axis=1) for v in zip(*some, strict=True))
        return ((v[:, s:s + CHUNK].T for v in (x, score, y)) for s in range(0, x.shape[1], CHUNK))
    for b in batches:
        for i in range(b.num_rows):
            x, y, key = B.unpack(b, i, features, targets, np.uint8)
            score = _scores(b, i, columns, start, len(x))
            if share < 1:
                inside = B.hash_share(key, salt) < share
                x, score, y = x[inside], score[inside], y[inside]
            if some and n + len(x) > CHUNK:
                yield from whole()
                some, n = [], 0
            some.append((x.T, score.T, y.T))
            n += len(x)
    if some:
        yield from whole()


def _cells(x: np.ndarray, g: np.ndarray, h: np.ndarray, node, nodes: int, width: int, out: np.ndarray) -> None:
    """Add up gradient, curvature and rows of every (node, feature, bin) into
    ``out`` (3, nodes, features, bins). Curvatures and rows share one sum, in
    which they cannot meet: a curvature is at most UNIT / 4, CHUNK of them are
    less than ROW, and all of it is exact below 2^53."""
    both = h + ROW
    for j in range(x.shape[1]):
        at = x[:, j].astype(np.int64)
        if node is not None:
            at += node
        out[0, :, j] += np.bincount(at, g, nodes * width).reshape(nodes, width)
        hn = np.bincount(at, both, nodes * width).reshape(nodes, width)
        n = np.floor(hn / ROW)
        out[1, :, j] += hn - n * ROW
        out[2, :, j] += n


def _histogram(base: DataFrame, model: Boosting, recent, level: int, growing, width: int, share: float, salt: int, above=None):
    """Summed cells (columns, nodes, features, bins, 3): gradient, curvature
    (in units of 2^-20) and rows, one pass over the data. With the cells of the
    level ``above``, only the child with fewer rows of every node is counted;
    the other one has the rest (whole numbers, so exactly)."""
    classes, start, f = model.classes, model.start, len(model.cuts)
    c, nodes = len(start), 1 << level
    spark = base.sparkSession
    counted = np.ones((c, nodes), bool)
    if above is not None:
        for k in range(c):
            for up in range(nodes // 2):
                j, b = growing[0][k, nodes // 2 - 1 + up], growing[1][k, nodes // 2 - 1 + up]
                rows = above[k, up, max(j, 0), :, 2]
                fewer = int(j < 0 or 2 * rows[:b + 1].sum() > rows.sum())  # 1: the right child
                counted[k, 2 * up + 1 - fewer] = False
    shared = spark.sparkContext.broadcast((recent, growing, counted))  # a few trees

    def add(batches):
        recent, (feature, cut), counted = shared.value
        cells = np.zeros((3, c, nodes, f, width))
        for x, score, y in _chunks(batches, f, c, start, len(classes), share, salt):
            g, h = gradients(add_trees(score, x, recent), y, classes)
            g, h = np.rint(g * UNIT), np.rint(h * UNIT)
            for k in range(c):
                if not level:
                    _cells(x, g[:, k], h[:, k], None, nodes, width, cells[:, k])
                    continue
                node = leaf_of(x, feature[k], cut[k], level)
                rows = np.flatnonzero(counted[k].take(node))
                _cells(x.T.take(rows, axis=1).T, g[:, k].take(rows), h[:, k].take(rows), node.take(rows) * width, nodes, width, cells[:, k])
        flat = cells.reshape(3, -1)
        hit = np.flatnonzero(flat[2])
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), *(pa.array(flat[m][hit].astype(np.int64)) for m in range(3))], names=["cell", "g", "h", "n"])
    rows = (base.mapInArrow(add, "cell int, g long, h long, n long").groupBy("cell")
            .agg(*[F.sum(m).alias(m) for m in "ghn"]).toPandas())
    shared.unpersist()
    out = np.zeros((c * nodes * f * width, 3))
    out[rows["cell"].to_numpy(np.int64)] = rows[["g", "h", "n"]].to_numpy(float)
    out = out.reshape(c, nodes, f, width, 3)
    if above is not None:
        for k, node in zip(*np.nonzero(~counted), strict=True):
            out[k, node] = above[k, node // 2] - out[k, node ^ 1]
    return out


def best_split(cells: np.ndarray, allowed) -> tuple[int, int, np.ndarray, np.ndarray, float]:
    """(feature, cut, left sums, right sums, gain) of one node from its cells
    (features, bins, 3). Gain: what the split adds to sum(g)^2 / rows. The
    first feature and cut win ties; feature -1 if nothing can be split."""
    left = np.cumsum(cells, axis=1)
    total = left[:, -1:]
    right = total - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[..., 0] ** 2 / left[..., 2] + right[..., 0] ** 2 / right[..., 2] - total[..., 0] ** 2 / total[..., 2]
    gain[(left[..., 2] == 0) | (right[..., 2] == 0)] = -np.inf
    gain[[j for j in range(len(cells)) if j not in allowed]] = -np.inf
    j, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    if not gain[j, b] > 0:
        return -1, 0, total[0, 0], np.zeros(3), 0.0
    return int(j), int(b), left[j, b], right[j, b], float(gain[j, b])


def fit_boosting(train: DataFrame, features, classes: dict[str, int], keys, rounds: int = 80, depth: int = 3, rate: float = 0.1,
                 subsample: float = 1.0, max_features: float = 1.0, bins: int = BINS, seed: int = 123) -> Boosting:
    """Gradient boosting of all targets in ``classes`` (column -> number of
    class codes 0, 1, ...). ``keys`` identify a row for subsampling."""
    features = list(features)
    cuts = quantile_cuts(train, features, bins)
    base = B.kept(B.blocks(train, features, classes, keys, encode(cuts)))
    columns = columns_of(classes)
    c = max(s.stop for s in columns.values())
    model = Boosting(cuts, classes, np.zeros(c))
    model.start = _start(base, classes, len(features))
    width, recent = bins + 1, []
    take = max(1, math.ceil(max_features * len(features)))
    factor = np.concatenate([np.full(s.stop - s.start, 1.0 if classes[t] <= 2 else (classes[t] - 1) / classes[t]) for t, s in columns.items()])
    value = lambda sums, k: rate * factor[k] * sums[0] / sums[1] if sums[1] > 0 else 0.0
    for r in range(rounds):
        feature, cut, leaf = np.full((c, (1 << depth) - 1), -1), np.zeros((c, (1 << depth) - 1), np.uint8), np.zeros((c, 1 << depth))
        cells = None
        for level in range(depth):
            cells = _histogram(base, model, recent, level, (feature, cut), width, subsample, seed + r, cells)
            for k in range(c):
                for node in range(1 << level):
                    rng = np.random.default_rng([seed, r, k, level, node])
                    allowed = set(rng.permutation(len(features))[:take].tolist())
                    j, b, left, right, _ = best_split(cells[k, node], allowed)
                    at = (1 << level) - 1 + node
                    feature[k, at], cut[k, at] = j, b
                    if level == depth - 1:
                        leaf[k, 2 * node], leaf[k, 2 * node + 1] = value(left, k), value(right, k)
        model.rounds.append((feature, cut, leaf))
        recent.append(model.rounds[-1])
        if len(recent) == REBASE and r + 1 < rounds:
            old, base, recent = base, B.kept(_rebased(base, model, recent)), []
            base.count()
            old.unpersist()
    base.unpersist()
    return model


def first_split(train: DataFrame, features, target: str, keys, bins: int = BINS) -> list[tuple]:
    """The best first split of every feature that can be split, for a target of
    two classes: (feature, cut, rows up to the cut, gain)."""
    features, classes = list(features), {target: 2}
    cuts = quantile_cuts(train, features, bins)
    base = B.kept(B.blocks(train, features, classes, keys, encode(cuts)))
    model = Boosting(cuts, classes, np.zeros(1))
    model.start = _start(base, classes, len(features))
    empty = (np.zeros((1, 0), np.int64), np.zeros((1, 0), np.uint8))
    cells = _histogram(base, model, [], 0, empty, bins + 1, 1.0, 0)[0, 0]
    base.unpersist()
    out = []
    for i, name in enumerate(features):
        j, b, left, _, gain = best_split(cells, {i})
        if j >= 0 and b < len(cuts[name]):
            out.append((name, cuts[name][b], int(left[2]), gain / UNIT ** 2))
    return out


def _start(base: DataFrame, classes: dict[str, int], features: int) -> np.ndarray:
    """Starting scores: log-odds, or log shares, of the classes."""
    targets = list(classes)

    def count(batches):
        n = [np.zeros(max(k, 2), np.int64) for k in classes.values()]
        for b in batches:
            for i in range(b.num_rows):
                _, y, _ = B.unpack(b, i, features, len(targets), np.uint8)
                for t in range(len(targets)):
                    n[t] += np.bincount(y[:, t], minlength=len(n[t]))
        rows = [(t, k, int(v)) for t in range(len(targets)) for k, v in enumerate(n[t])]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*rows, strict=True)], names=["t", "k", "n"])
    got = {(r["t"], r["k"]): r["n"] for r in base.mapInArrow(count, "t long, k long, n long").groupBy("t", "k").agg(F.sum("n").alias("n")).collect()}
    out = []
    for t, k in enumerate(classes.values()):
        n = np.array([got.get((t, j), 0) for j in range(max(k, 2))], float)
        share = np.clip(n / max(n.sum(), 1), 1e-12, 1)
        out += [math.log(share[1] / share[0])] if k <= 2 else np.log(share).tolist()
    return np.array(out)


def _rebased(base: DataFrame, model: Boosting, recent) -> DataFrame:
    """The blocks with their scores after ``recent`` written into them."""
    f, classes, start = len(model.cuts), model.classes, model.start

    def step(batches):
        for b in batches:
            score = []
            for i in range(b.num_rows):
                x, _, _ = B.unpack(b, i, f, len(classes), np.uint8)
                score.append(add_trees(_scores(b, i, len(start), start, len(x)), x, recent).tobytes(order="F"))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in ("x", "y", "key")), pa.array(score, pa.binary())],
                                             names=["x", "y", "key", "score"])
    return base.mapInArrow(step, "x binary, y binary, key binary, score binary")


def _predicted(df: DataFrame, features, targets, classify) -> DataFrame:
    """``df`` and an integer column pred_<target> for each target."""
    names = [f"pred_{t}" for t in targets]
    kept = df.drop(*names)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields]

    def predict(batches):
        for b in batches:
            pred = classify(B.matrix(b, features))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(p.astype(np.int32)) for p in pred)], names=[*b.schema.names, *names])
    return kept.mapInArrow(predict, ", ".join([*fields, *(f"`{n}` int" for n in names)]))


def predict_boosting(model: Boosting, df: DataFrame) -> DataFrame:
    """``df`` with pred_<target>: the class of the highest score, ties to the
    lower code."""
    shared = df.sparkSession.sparkContext.broadcast((model.start, model.rounds))
    cuts, classes = model.cuts, model.classes

    def classify(x):
        start, rounds = shared.value
        score = add_trees(np.asfortranarray(np.tile(start, (len(x), 1))), encode(cuts)(x), rounds)
        return [(score[:, s.start] > 0).astype(int) if classes[t] <= 2 else score[:, s].argmax(axis=1) for t, s in columns_of(classes).items()]
    return _predicted(df, list(cuts), list(classes), classify)


# -------------------------------------------------------------------- AdaBoost
class Stumps:
    """A fitted model: for each target a list of (feature, cut, class of bins
    up to the cut, class of those above, weight)."""

    def __init__(self, cuts, classes):
        self.cuts, self.classes = cuts, classes
        self.rounds: dict[str, list] = {t: [] for t in classes}


def stump_classes(bins: np.ndarray, stump) -> np.ndarray:
    j, b, low, high, _ = stump
    return np.where(bins[:, j] > b, high, low)


def best_stump(cells: np.ndarray):
    """(feature, cut, low class, high class, error) with the least Gini
    impurity from weights (features, bins, classes); None if there is no cut."""
    left = np.cumsum(cells, axis=1)
    total = left[:, -1:]
    right = total - left
    wl, wr = left.sum(axis=2), right.sum(axis=2)
    floor = 1e-15 * total[0].sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        pure = (left ** 2).sum(axis=2) / wl + (right ** 2).sum(axis=2) / wr
    pure[(wl <= floor) | (wr <= floor)] = -np.inf
    j, b = np.unravel_index(int(np.argmax(pure)), pure.shape)
    if not np.isfinite(pure[j, b]):
        return None
    low, high = int(left[j, b].argmax()), int(right[j, b].argmax())
    return int(j), int(b), low, high, float(1 - (left[j, b, low] + right[j, b, high]) / total[j].sum())


def fit_adaboost(train: DataFrame, features, classes: dict[str, int], keys, rounds: int = 80, rate: float = 1.0, bins: int = BINS) -> Stumps:
    """SAMME boosting of stumps for all targets, one pass a round. A target
    stops early when a stump makes no error, or is no better than chance."""
    features = list(features)
    cuts = quantile_cuts(train, features, bins)
    base = B.kept(B.blocks(train, features, classes, keys, encode(cuts)))
    model, f, width, names = Stumps(cuts, classes), len(features), bins + 1, list(classes)
    most = max(max(classes.values()), 2)
    open_, scale = set(names), dict.fromkeys(names, 0.0)  # log of the weights' sum
    for _ in range(rounds):
        if not open_:
            break
        shared = train.sparkSession.sparkContext.broadcast((model.rounds, scale, [t in open_ for t in names]))

        def weigh(batches, shared=shared):
            stumps, scale, active = shared.value
            cells = np.zeros((len(names), f, width, most))
            for b in batches:
                for i in range(b.num_rows):
                    x, y, _ = B.unpack(b, i, f, len(names), np.uint8)
                    for t, name in enumerate(names):
                        if not active[t]:
                            continue
                        w = np.full(len(x), -scale[name])
                        for s in stumps[name]:
                            w += s[4] * (stump_classes(x, s) != y[:, t])
                        w = np.exp(w)
                        for j in range(f):
                            cells[t, j] += np.bincount(x[:, j] * np.int64(most) + y[:, t], w, width * most).reshape(width, most)
            flat = cells.reshape(-1)
            hit = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(flat[hit])], names=["cell", "w"])
        rows = base.mapInArrow(weigh, "cell int, w double").groupBy("cell").agg(F.sum("w").alias("w")).toPandas()
        shared.unpersist()
        cells = np.zeros(len(names) * f * width * most)
        cells[rows["cell"].to_numpy(np.int64)] = rows["w"].to_numpy(float)
        for t, name in enumerate(names):
            if name not in open_:
                continue
            k = max(classes[name], 2)
            own = cells.reshape(len(names), f, width, most)[t, :, :, :k]
            found = best_stump(own)
            if found is None or found[4] >= 1 - 1 / k:
                if not model.rounds[name]:  # no cut at all: the most frequent class
                    top = int(own[0].sum(axis=0).argmax())
                    model.rounds[name].append((0, 0, top, top, 1.0))
                open_.discard(name)
                continue
            j, b, low, high, error = found
            error = max(error, 1e-10)
            weight = rate * (math.log((1 - error) / error) + math.log(k - 1))
            model.rounds[name].append((j, b, low, high, weight))
            scale[name] += math.log(own[0].sum()) + math.log(error * math.exp(weight) + 1 - error)
            if error <= 1e-10:
                open_.discard(name)
    base.unpersist()
    return model


def predict_adaboost(model: Stumps, df: DataFrame) -> DataFrame:
    """``df`` with pred_<target>: the class with the most weighted votes."""
    shared = df.sparkSession.sparkContext.broadcast(model.rounds)
    cuts, classes = model.cuts, model.classes

    def classify(x):
        bins, out = encode(cuts)(x), []
        for t, k in classes.items():
            votes = np.zeros((len(x), max(k, 2)))
            for s in shared.value[t]:
                votes[np.arange(len(x)), stump_classes(bins, s)] += s[4]
            out.append(votes.argmax(axis=1))
        return out
    return _predicted(df, list(cuts), list(classes), classify)
