"""Isolation forest as a step function (item 62).

With one feature an isolation tree is a step function of the value: between two
neighbouring cuts the path length is constant. So a forest of one (fold, key)
is the mean of its trees' step functions, itself a step function, and scoring a
reading is looking up the step it falls on.

1. ``forest_samples`` draws the rows of each tree by arithmetic on the fold,
   the tree and a running number; they are fetched by an equi-join on the
   position, so no reading is copied once for every tree.
2. ``forest_steps`` grows the trees, some of one (fold, key) at a time: a group
   holds ``TREES_TOGETHER`` samples, never a training window. Their steps are
   added up by lower bound and running sum, and cut into pieces of ``PIECE``.
3. ``forest_scores`` finds each reading's piece, meets it by an equi-join, and
   looks the step up, all in expressions. Readings are never grouped.

Scores are 2^(-mean path length / mean c(rows of a tree)). A null value has no
score; a (fold, key) without training rows leaves its readings unscored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .detect import _c, _tree_leaves

TREES_TOGETHER = 16
PIECE = 256


def hash32(x):
    """Mixing of whole numbers below 2^32 by plain arithmetic (any SQL has it)."""
    for _ in range(2):
        x = (x.bitwiseXOR(F.shiftright(x, 16)) * F.lit(73244475)) % F.lit(1 << 32)
    return x.bitwiseXOR(F.shiftright(x, 16))


def forest_samples(train: DataFrame, sizes: DataFrame, keys=("fold", "sensor"), pos: str = "pos", value: str = "value", seed: int = 0) -> DataFrame:
    """keys, tree, pos, value: the rows of every tree. A tree of ``samples`` or
    more rows than there are takes each row once; others draw ``samples``
    positions, of which equal ones count once. ``train`` has one row for each
    position of a range."""
    keys = list(keys)
    span = train.groupBy(*keys).agg(F.min(pos).alias("_lo"), (F.max(pos) - F.min(pos) + 1).alias("_rows"))
    draws = (sizes.select(*keys, "samples", "trees").join(span, keys)
             .withColumn("tree", F.explode(F.sequence(F.lit(0).cast("long"), F.col("trees") - 1)))
             .withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.least("samples", "_rows") - 1))))
    unit = hash32((F.col(keys[0]).cast("long") * 1000003 + F.col("tree") * 65537 + F.col("_j") + F.lit(1 + 7919 * seed)) % F.lit(1 << 32))
    at = F.when(F.col("samples") >= F.col("_rows"), F.col("_j")).otherwise(F.floor(unit * F.col("_rows") / F.lit(float(1 << 32))))
    draws = draws.select(*keys, "tree", (F.col("_lo") + at).cast("long").alias(pos)).distinct()
    return draws.join(train.select(*keys, F.col(pos).cast("long").alias(pos), value), [*keys, pos]).where(F.col(value).isNotNull()).select(*keys, "tree", pos, value)


def forest_steps(samples: DataFrame, keys=("fold", "sensor"), value: str = "value", seed: int = 0) -> DataFrame:
    """keys, from, path, trees, norm: the summed path length of readings from
    ``from`` up to the next step, the number of trees and their summed c."""
    keys = list(keys)
    key_types = ", ".join(f"`{k}` {dict(samples.dtypes)[k]}" for k in keys)

    def grow(key, rows):
        import numpy as np
        import pandas as pd
        lows, jumps, norm, trees = [], [], 0.0, 0
        for tree, own in rows.groupby("tree", sort=True):
            own = np.sort(own[value].to_numpy(dtype=float))
            salt = int(np.random.SeedSequence([seed, hash_of(key), int(tree)]).generate_state(1)[0])
            lo, _, path = _tree_leaves(own, salt)
            last = np.append(lo[1:] != lo[:-1], True)  # empty steps end where they begin
            lo, path = lo[last], path[last]
            lows.append(lo)
            jumps.append(np.diff(path, prepend=0.0))
            norm += float(_c(len(own)))
            trees += 1
        lo, at = np.unique(np.concatenate(lows), return_inverse=True)
        out = pd.DataFrame({"from": lo, "jump": np.bincount(at, np.concatenate(jumps)), "trees": 0, "norm": 0.0})
        out.loc[0, ["trees", "norm"]] = [trees, norm]  # counted at the first step, from -infinity
        for k, v in zip(keys, key, strict=False):
            out[k] = v
        return out.astype({"trees": "int64"})[[*keys, "from", "jump", "trees", "norm"]]

    def hash_of(key):
        import zlib
        return zlib.crc32(repr(tuple(map(str, key[:-1]))).encode())

    grown = (samples.withColumn("_part", F.floor(F.col("tree") / TREES_TOGETHER)).groupBy(*keys, "_part")
             .applyInPandas(grow, f"{key_types}, `from` double, jump double, trees long, norm double"))
    steps = grown.groupBy(*keys, "from").agg(F.sum("jump").alias("jump"), F.sum("trees").alias("trees"), F.sum("norm").alias("norm"))
    upto = Window.partitionBy(*keys).orderBy("from").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(*keys, "from", F.sum("jump").over(upto).alias("path"), F.sum("trees").over(upto).alias("trees"), F.sum("norm").over(upto).alias("norm"))


def forest_scores(readings: DataFrame, steps: DataFrame, keys=("fold", "sensor"), value: str = "value", piece: int = PIECE) -> DataFrame:
    """``readings`` with their score."""
    keys = list(keys)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("from")) - 1
    pieces = (steps.withColumn("_piece", F.floor(number / piece).cast("int")).groupBy(*keys, "_piece")
              .agg(F.sort_array(F.collect_list(F.struct("from", "path"))).alias("_steps"), F.max("trees").alias("_trees"), F.max("norm").alias("_norm")))
    heads = pieces.groupBy(*keys).agg(F.sort_array(F.collect_list(F.col("_steps")[0]["from"])).alias("_heads"))
    count = lambda below: F.size(below).cast("int")
    at = readings.join(heads, keys, "left").withColumn("_piece", count(F.filter("_heads", lambda h: h <= F.col(value))) - 1).drop("_heads")
    met = at.join(pieces, [*keys, "_piece"], "left")
    path = F.element_at("_steps", F.greatest(count(F.filter("_steps", lambda s: s["from"] <= F.col(value))), F.lit(1)))["path"]
    score = F.when(F.col("_norm") > 0, F.pow(F.lit(2.0), -(path / F.col("_norm")))).when(F.col("_trees").isNotNull(), F.lit(0.5))
    return met.withColumn("score", F.when(F.col(value).isNotNull(), score)).drop("_piece", "_steps", "_trees", "_norm")
