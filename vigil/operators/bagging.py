"""Random forests on binned features (item 79).

Features are cut at exact quantiles into at most ``BINS`` bins, once, and the
training rows live in blocks of bytes (``functions/blocks.py``): some twenty
bytes a row, whatever the number of trees. How often a tree draws a row
(Poisson, as for a bootstrap) follows from a hash of the row and the tree, so
neither draws nor node numbers are stored, and a forest does not depend on how
rows are partitioned.

All trees of all targets grow in the same passes, one for each level: tasks
count (feature, bin, class) cells of every open node, partial counts are
shuffled by node, and the best split of a node (Gini) is found where they meet.
The driver sees one row for each node. Each node keeps its class counts, so a
tree cut off at any depth is the tree of that depth, and a forest's first trees
are the smaller forest: ``grow`` adds what a larger or deeper one lacks.

Rows with a null feature take a bin of their own behind all others; rows
without a class are not trained on.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import blocks as B
from .boosting import BINS, _predicted, encode, quantile_cuts

#: Rows of a partition, on average; each sends its own counts of every node.
PART_ROWS = 3_000_000
#: Nodes whose counts one pass adds up at most (trees wait for their turn).
OPEN_NODES = 1 << 14
#: Rows taken at a time, whose working arrays fit a core's cache.
PIECE = 1 << 15
LEAF = 255  # a cut above all bins


def features_per_node(strategy: str, features: int, trees: int) -> int:
    """Features tried at a node: a share, a number or a name, as in MLlib."""
    named = {"all": features, "sqrt": math.ceil(math.sqrt(features)), "log2": max(1, math.ceil(math.log2(features))), "onethird": math.ceil(features / 3)}
    named["auto"] = features if trees == 1 else named["sqrt"]
    if strategy in named:
        return named[strategy]
    return min(int(strategy), features) if strategy.isdigit() else math.ceil(float(strategy) * features)


# ------------------------------------------------------------- kernels (tasks)
def _poisson() -> np.ndarray:
    """Draws of a row by a 16-bit hash: Poisson of mean 1."""
    p = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(9)])
    return np.searchsorted(p, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


_DRAWS = _poisson()


def draws(key: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often ``tree`` draws each row; one hash serves four trees."""
    h = key.view(np.uint64) + np.uint64((seed * 1_000_003 + tree // 4 + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(31)
    return _DRAWS.take((h >> np.uint64(16 * (tree % 4))).astype(np.uint16))


def walk(bins: np.ndarray, rows: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, levels: int) -> np.ndarray:
    """Node that each of ``rows`` reaches after ``levels`` levels. A node's
    right child is ``left`` + 1; a leaf is its own left child."""
    node = np.zeros(len(rows), np.int64)
    if not levels:
        return node
    flat, at = bins.reshape(-1), rows * bins.shape[1]
    for s in range(0, len(rows), PIECE):
        own = at[s:s + PIECE]
        n = left[0] + (flat.take(own + feature[0]) > cut[0])
        for _ in range(levels - 1):
            here = flat.take(own + feature.take(n)) > cut.take(n)
            n = left.take(n)
            n += here
        node[s:s + PIECE] = n
    return node


def best_splits(cells: np.ndarray, widths, classes: int, allowed: np.ndarray | None):
    """(feature, cut, left counts, right counts) of every node from its counts
    (nodes, summed widths x classes). The first feature and cut win ties;
    feature -1 if no cut lowers the impurity."""
    nodes, at = len(cells), 0
    best, feature, cut = np.full(nodes, -np.inf), np.full(nodes, -1), np.zeros(nodes, np.int64)
    every = np.arange(nodes)
    first = cells[:, :widths[0] * classes].reshape(nodes, widths[0], classes).sum(axis=1)
    low, n = first.copy(), first.sum(axis=1)
    pure = (first.astype(float) ** 2).sum(axis=1) / np.maximum(n, 1)
    for j, width in enumerate(widths):
        left = np.cumsum(cells[:, at:at + width * classes].reshape(nodes, width, classes), axis=1)[:, :-1]
        at += width * classes
        right = first[:, None] - left
        nl, nr = left.sum(axis=2), right.sum(axis=2)
        gain = (left.astype(float) ** 2).sum(axis=2) / np.maximum(nl, 1) + (right.astype(float) ** 2).sum(axis=2) / np.maximum(nr, 1) - pure[:, None]
        gain[(nl == 0) | (nr == 0) | (gain <= 1e-12 * n[:, None])] = -np.inf
        if allowed is not None:
            gain[~allowed[:, j]] = -np.inf
        b = gain.argmax(axis=1)
        better = gain[every, b] > best
        best[better], feature[better], cut[better], low[better] = gain[every, b][better], j, b[better], left[every, b][better]
    return feature, cut, low, first - low


# ---------------------------------------------------------------------- forest
class Tree:
    """Nodes of a tree in order of growth, and those still open."""

    def __init__(self, classes: int):
        self.feature, self.cut, self.left = np.zeros(1, np.int64), np.full(1, LEAF, np.uint8), np.zeros(1, np.int64)
        self.counts, self.open, self.levels = np.zeros((1, classes), np.int64), np.zeros(1, np.int64), 0

    def split(self, node, feature, cut, low, high) -> None:
        """The next level: children of the nodes that were split."""
        if not self.levels:
            self.counts[node] = low + high
        done = feature >= 0
        node, low, high = node[done], low[done], high[done]
        n = len(self.left)
        self.feature[node], self.cut[node], self.left[node] = feature[done], cut[done], n + 2 * np.arange(len(node))
        children = np.stack([low, high], axis=1).reshape(-1, self.counts.shape[1])
        more = n + np.arange(len(children))
        self.feature, self.cut = np.append(self.feature, np.zeros(len(children), np.int64)), np.append(self.cut, np.full(len(children), LEAF, np.uint8))
        self.left, self.counts = np.append(self.left, more), np.concatenate([self.counts, children])
        self.open, self.levels = more[(children > 0).sum(axis=1) > 1], self.levels + 1

    def shares(self) -> np.ndarray:
        return self.counts / np.maximum(self.counts.sum(axis=1, keepdims=True), 1)


class Forest:
    """A fitted model: cuts, classes, and for each target its trees."""

    def __init__(self, cuts, classes, take: int, seed: int):
        self.cuts, self.classes, self.take, self.seed = cuts, dict(classes), take, seed
        self.trees: dict[str, list[Tree]] = {t: [] for t in classes}


def binned(train: DataFrame, features, classes: dict[str, int], keys) -> tuple[dict, DataFrame]:
    """(cuts, kept blocks) of the training rows, for any number of fits. A
    row is told from others by its key, features and classes."""
    features = list(features)
    cuts = quantile_cuts(train, features, BINS)
    return cuts, B.kept(B.blocks(train, features, classes, [*keys, *features, *classes], encode(cuts), part_rows=PART_ROWS, early=True))


def _counts(base: DataFrame, forest: Forest, todo):
    """Counts of the open nodes of ``todo`` (target number, tree number):
    rows (target, tree, node, counts) that are still to be added up."""
    names, f, seed = list(forest.classes), len(forest.cuts), forest.seed
    ks = [max(k, 2) for k in forest.classes.values()]
    widths = [len(c) + 2 for c in forest.cuts.values()]
    own = [(t, i, forest.trees[names[t]][i]) for t, i in todo]
    shared = base.sparkSession.sparkContext.broadcast([(t, i, v.feature, v.cut, v.left, v.levels, v.open) for t, i, v in own])

    def count(x, y, key):
        pre, of = [], None
        for t, i, feature, cut, left, levels, open_ in shared.value:
            k = ks[t]
            if of != t:  # cell of each row in each feature, within a node
                pre, of = [x[:, j].astype(np.int32) * k + y[:, t] for j in range(f)], t
            size = sum(widths) * k
            cells, place = np.zeros((len(open_), size), np.int64), np.full(len(left), -1)
            place[open_] = np.arange(len(open_))
            step = max(PIECE, 2 * len(open_) * size)  # rows that fit the caches, but not fewer than cells
            for s in range(0, len(key), step):
                w = draws(key[s:s + step], i, seed)
                rows = np.flatnonzero(w)
                at = place.take(walk(x[s:s + step], rows, feature, cut, left, levels))
                met = np.flatnonzero(at >= 0)
                if len(met) < len(at):
                    rows, at = rows.take(met), at.take(met)
                weight, begin = w.take(rows).astype(float), 0
                for j, width in enumerate(widths):
                    idx = at * (width * k)
                    idx += pre[j][s:s + step].take(rows)
                    cells[:, begin:begin + width * k] += np.bincount(idx, weight, len(open_) * width * k).reshape(len(open_), -1).astype(np.int64)
                    begin += width * k
            most = cells.max(axis=1)
            for kind, low, high in ((np.uint8, 0, 1 << 8), (np.uint16, 1 << 8, 1 << 16), (np.uint32, 1 << 16, 1 << 32)):
                some = np.flatnonzero((most > low - (low > 0)) & (most < high))
                if len(some):
                    data = cells[some].astype(kind)
                    ends = np.arange(len(some) + 1, dtype=np.int32) * (data.shape[1] * data.itemsize)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(some), t, np.int32)), pa.array(np.full(len(some), i, np.int32)), pa.array(open_[some].astype(np.int32)),
                         pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(ends), pa.py_buffer(data)])], names=["target", "tree", "node", "cells"])

    def add(batches):
        some, n = [], 0
        for b in batches:
            for i in range(b.num_rows):
                x, y, key = B.unpack(b, i, f, len(names), np.uint8)
                some.append((x, y, key))
                n += len(key)
                if n >= PART_ROWS:  # a task holds no more rows at once
                    yield from count(*map(np.concatenate, zip(*some, strict=True)))
                    some, n = [], 0
        if some:
            yield from count(*map(np.concatenate, zip(*some, strict=True)))
    return base.mapInArrow(add, "target int, tree int, node int, cells binary"), shared


def _level(base: DataFrame, forest: Forest, todo) -> None:
    """One more level for the trees of ``todo``."""
    from ..llm.common import settings
    names, f, take, seed = list(forest.classes), len(forest.cuts), forest.take, forest.seed
    ks = [max(k, 2) for k in forest.classes.values()]
    widths = [len(c) + 2 for c in forest.cuts.values()]

    def split(batches):
        sums = [{} for _ in ks]
        for b in batches:
            blobs = b.column(3)
            for i, (t, tree, node) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)), strict=True)):
                blob, size = blobs[i].as_buffer(), sum(widths) * ks[t]
                got = np.frombuffer(blob, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(blob) // size])
                if (tree, node) in sums[t]:
                    sums[t][tree, node] += got
                else:
                    sums[t][tree, node] = got.astype(np.int64)
        for t, found in enumerate(sums):
            ids = list(found)
            for s in range(0, len(ids), 256):
                some, allowed = ids[s:s + 256], None
                if take < f:
                    allowed = np.zeros((len(some), f), bool)
                    for i, (tree, node) in enumerate(some):
                        allowed[i, np.random.default_rng([seed, tree, node]).permutation(f)[:take]] = True
                feature, cut, low, high = best_splits(np.stack([found[i] for i in some]), widths, ks[t], allowed)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), t, np.int32)), *(pa.array(np.array(v, np.int32)) for v in zip(*some, strict=True)), pa.array(feature.astype(np.int32)),
                     pa.array(cut.astype(np.int32)), *(pa.array([r.tobytes() for r in v], pa.binary()) for v in (low, high))],
                    names=["target", "tree", "node", "feature", "cut", "low", "high"])
    spark = base.sparkSession
    counts, shared = _counts(base, forest, todo)
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        got = (counts.repartition(spark.sparkContext.defaultParallelism, "target", "tree", "node")
               .mapInArrow(split, "target int, tree int, node int, feature int, cut int, low binary, high binary").collect())
    shared.unpersist()
    by = {}
    for r in sorted(got, key=lambda r: (r["target"], r["tree"], r["node"])):
        by.setdefault((r["target"], r["tree"]), []).append(r)
    for t, i in todo:
        rows, k = by.get((t, i), []), ks[t]
        counts = [np.array([np.frombuffer(r[c], np.int64) for r in rows], np.int64).reshape(-1, k) for c in ("low", "high")]
        forest.trees[names[t]][i].split(*(np.array([r[c] for r in rows], np.int64) for c in ("node", "feature", "cut")), *counts)


def grow(base: DataFrame, forest: Forest, depths) -> None:
    """Grow tree i of every target to ``depths[i]`` levels where it has less."""
    for t, k in forest.classes.items():
        forest.trees[t] += [Tree(max(k, 2)) for _ in range(len(depths) - len(forest.trees[t]))]
    while True:
        todo, n = [], 0
        for t, trees in enumerate(forest.trees.values()):
            for i, depth in enumerate(depths):
                if trees[i].levels < depth and len(trees[i].open) and (not todo or n + len(trees[i].open) <= OPEN_NODES):
                    todo.append((t, i))
                    n += len(trees[i].open)
        if not todo:
            return
        _level(base, forest, todo)


def fit_forest(cuts, base: DataFrame, classes: dict[str, int], trees: int, depth: int, max_features: str = "0.9", seed: int = 123) -> Forest:
    """A forest for every target of ``classes`` on ``binned`` rows."""
    forest = Forest(cuts, classes, features_per_node(max_features, len(cuts), trees), seed)
    grow(base, forest, [depth] * trees)
    return forest


def predict_forest(forest: Forest, df: DataFrame, trees: int, depth: int, targets=None) -> DataFrame:
    """``df`` with pred_<target> by the first ``trees`` trees, cut off at
    ``depth``: the class of the largest summed share, ties to the lower code."""
    names = [t for t in forest.classes if targets is None or t in targets]
    shared = df.sparkSession.sparkContext.broadcast([[(v.feature, v.cut, v.left, min(v.levels, depth), v.shares()) for v in forest.trees[t][:trees]] for t in names])
    cuts = forest.cuts

    def classify(x):
        bins, out = encode(cuts)(x), []
        rows = np.arange(len(bins))
        for own in shared.value:
            score = np.zeros((len(bins), own[0][4].shape[1]))
            for feature, cut, left, levels, share in own:
                score += share.take(walk(bins, rows, feature, cut, left, levels), axis=0)
            out.append(score.argmax(axis=1))
        return out
    return _predicted(df, list(cuts), names, classify)
