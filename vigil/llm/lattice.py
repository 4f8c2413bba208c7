"""Near-duplicate vectors by E8 lattice hashing (operator 12).

Two vectors of the same label link when their cosine reaches ``COSINE``.

1. Vectors with equal label and components are one node with a count of copies,
   so copies never become pairs.
2. Each of ``TABLES`` tables projects the unit vector on ``BLOCKS`` x 8 random
   directions, scales and shifts it, and decodes each 8 numbers to the nearest
   point of the E8 lattice. These points, the label and the table are the
   node's home cell. It also probes the ``PROBES`` cells next nearest to it:
   combinations of the blocks' points and their nearest minimal neighbours,
   by what they add to the squared distance. Two nodes meet when one probes, or
   lives in, the home of the other.
3. Cells are counted from narrow rows first; only those in which somebody
   lives and somebody else calls get the vectors.
4. A cell of more than ``BLOCK`` rows is cut into blocks by a hash of the node,
   and each pair of blocks is a group of its own, so no task holds a large
   cell whole. A group compares its vectors in double precision and returns, for
   each node that links there, the copies it links with and the least node that
   is reached inside the group: no pairs. A pair that meets in several cells is
   counted in the first of them only, which both signatures tell.
5. The links inside groups give the components.

All cells are looked into whole: nothing is capped. Of pairs at the threshold
itself the tables miss about one in 20,000 (measured on random pairs; fewer
above it), and none below it is linked.

Null labels, null or zero vectors and vectors with null or non-finite
components link with nothing. Vectors of different lengths link with nothing.
Repeated rows and repeated vec_ids are vectors of their own; a null vec_id is
larger than all others. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import write_table
from .components import components
from .vectors import blocks, packed, unpacked

COSINE = 0.98
TABLES = 6
BLOCKS = 2
PROBES = 6
#: Size of the lattice's cells: a unit vector's projections are stretched by
#: this and the root of its length, so that near vectors differ alike in all.
SCALE = 0.625
#: Rows of a cell that one block holds on average.
BLOCK = 512
#: Rows of small groups that are compared in one go.
TOGETHER = 4096
SEED = 42

_CELLS = "cell long, node binary, home boolean"


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2
    with an even number of minus signs."""
    whole = [v for v in itertools.product((-1, 0, 1), repeat=8) if sum(map(abs, v)) == 2]
    half = [v for v in itertools.product((-0.5, 0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(whole + half, np.float64)


def _even_sum(x: np.ndarray) -> np.ndarray:
    """Nearest integer point with an even sum (the lattice D8)."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(axis=1) % 2)
    worst = np.abs(x[odd] - r[odd]).argmax(axis=1)
    r[odd, worst] += np.where(x[odd, worst] >= r[odd, worst], 1.0, -1.0)
    return r


def nearest_point(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row: of D8 or of D8 moved by one half."""
    a, b = _even_sum(x), _even_sum(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


@functools.lru_cache(maxsize=16)
def _directions(width: int, table: int):
    """Random orthonormal directions (fewer dimensions: padded with zeros),
    rounded to 2^-20 so that projections do not depend on the order of sums."""
    rng = np.random.default_rng([SEED, table, width])
    n = 8 * BLOCKS
    q = np.linalg.qr(rng.normal(size=(max(width, n), max(width, n))))[0][:width, :n]
    return np.rint(q * 2 ** 20), rng.random(n) * 2, rng.integers(1, 2 ** 63, (BLOCKS, 8), dtype=np.uint64) | np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows divided by their length (by their largest component first, so
    squares neither overflow nor vanish); zero rows become NaN."""
    with np.errstate(invalid="ignore", divide="ignore"):
        x = x / np.abs(x).max(axis=1, keepdims=True, initial=0.0)
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cells(u: np.ndarray, label: np.ndarray, table: int) -> np.ndarray:
    """(rows, 1 + PROBES) cell numbers of unit vectors, the home cell first."""
    q, shift, factor = _directions(u.shape[1], table)
    # both factors are whole numbers below 2^21, so the products add up exactly
    y = (np.rint(u * 2 ** 20) @ q) * (SCALE * max(u.shape[1], 8 * BLOCKS) ** 0.5 / 2 ** 40) + shift
    more, code = np.zeros((len(u), 1)), np.zeros((len(u), 1), np.uint64)
    for b in range(BLOCKS):
        part = y[:, 8 * b:8 * b + 8]
        home = nearest_point(part)
        gain = (part - home) @ _MINIMAL.T
        near = np.argpartition(-gain, PROBES, axis=1)[:, :PROBES]
        cost = 2.0 - 2.0 * np.take_along_axis(gain, near, axis=1)
        points = np.concatenate([home[:, None], home[:, None] + _MINIMAL[near]], axis=1)
        number = ((points * 2).astype(np.int64).view(np.uint64) * factor[b]).sum(axis=2)
        more = (more[:, :, None] + np.concatenate([np.zeros((len(u), 1)), cost], axis=1)[:, None]).reshape(len(u), -1)
        code = (_mix(code)[:, :, None] + number[:, None]).reshape(len(u), -1)
        least = np.argsort(more, axis=1, kind="stable")[:, :1 + PROBES]
        more, code = np.take_along_axis(more, least, axis=1), np.take_along_axis(code, least, axis=1)
    return _mix(code + _mix(label.view(np.uint64) + np.uint64(table * 1000 + u.shape[1]))[:, None]).view(np.int64)


_MINIMAL = minimal_vectors()


def keyed(rows: DataFrame) -> DataFrame:
    """vec_id, and for rows that can link the digest of label and components
    (key), the label's hash, the vector's length and its packed components."""
    def key(batches):
        for b in batches:
            n = b.num_rows
            keys, widths, vectors = [None] * n, np.zeros(n, np.int32), [None] * n
            known = b.column(2).is_valid().to_numpy(zero_copy_only=False)
            label = b.column(1).to_pylist()
            for at, x in blocks(b.column(3)):
                x = x + 0.0  # -0.0 is 0.0
                for i, v in zip(at, x, strict=True):
                    if known[i] and v.any():
                        raw = v.tobytes()
                        keys[i], vectors[i], widths[i] = hashlib.blake2b(raw, digest_size=16, person=b"vector", key=str(label[i]).encode()[:64]).digest(), raw, len(v)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(keys, pa.binary()), pa.array(widths), pa.array(vectors, pa.binary())],
                                             names=["vec_id", "label", "key", "width", "vector"])
    label = F.when(rows["label"].isNotNull(), F.xxhash64(rows["label"]))
    text = F.sha2(rows["label"].cast("string"), 256)
    return rows.select(rows["vec_id"].cast("long").alias("vec_id"), text.alias("text"), label.alias("label"), rows["embedding"]).mapInArrow(
        key, "vec_id long, label long, key binary, width int, vector binary")


def node_name(vec_id, key):
    """A binary name that sorts by vec_id (null last) and tells rows of equal
    vec_id apart."""
    number = F.unhex(F.lpad(F.hex(vec_id.bitwiseXOR(F.expr("-9223372036854775807L - 1L"))), 16, "0"))
    return F.concat(F.when(vec_id.isNull(), F.unhex(F.lit("01" + "0" * 16))).otherwise(F.concat(F.unhex(F.lit("00")), number)), key)


def vec_id_of(node):
    number = F.conv(F.hex(F.substring(node, 2, 8)), 16, 10).cast("decimal(20,0)") - F.lit("9223372036854775808").cast("decimal(20,0)")
    return F.when(F.hex(F.substring(node, 1, 1)) == "00", number.cast("long"))


def _matrices(batch: pa.RecordBatch):
    """(rows, unit vectors) for each vector length of a batch."""
    width = batch.column(batch.schema.get_field_index("width")).to_numpy()
    vector = batch.column(batch.schema.get_field_index("vector"))
    for n in np.unique(width):
        at = np.flatnonzero(width == n)
        yield at, unit(unpacked(vector.take(pa.array(at)), np.float64, int(n)))


def cell_rows(nodes: DataFrame) -> DataFrame:
    """One narrow row for each cell that a node lives in or probes."""
    def spread(batches):
        for b in batches:
            label = b.column(b.schema.get_field_index("label")).to_numpy()
            name = b.column(b.schema.get_field_index("node"))
            for at, u in _matrices(b):
                for t in range(TABLES):
                    cell = cells(u, label[at], t)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell.reshape(-1)), name.take(pa.array(np.repeat(at, cell.shape[1]))),
                         pa.array(np.tile(np.arange(cell.shape[1]) == 0, len(at)))], names=["cell", "node", "home"])
    return nodes.select("node", "label", "width", "vector").mapInArrow(spread, _CELLS)


def first_meeting(mine: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The first cell in which each pair meets; signatures are (pairs, tables,
    1 + PROBES), the home first, ``mine`` being the smaller node's."""
    a = (other == mine[:, :, :1]).any(axis=2)
    b = (mine == other[:, :, :1]).any(axis=2)
    at = (a | b).argmax(axis=1)
    row = np.arange(len(mine))
    return np.where(a[row, at], mine[row, at, 0], other[row, at, 0])


def group_links(u, label, copies, home, cell, side, group, cosine: float):
    """Links inside groups of rows that stand together and in the order of
    their nodes: for each row the copies it links with (those counted here and
    not in an earlier cell) and the least row that is reached, itself if none.
    ``side`` is the row's block, or -1 in a group of one block."""
    n = len(u)
    links, root = np.zeros(n, np.int64), np.arange(n)
    found = [np.zeros((2, 0), np.int64)]
    for s, e in itertools.pairwise([0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), n]):
        lives = s + np.flatnonzero(home[s:e])
        if e - s < 2 or not len(lives):
            continue
        near = u[lives] @ u[s:e].T >= cosine
        if side[s] >= 0:  # two blocks meet: only pairs across them
            near &= side[lives][:, None] != side[None, s:e]
        i, j = np.nonzero(near)
        i, j = lives[i], j + s
        keep = (i != j) & (~home[j] | (i < j))
        found.append(np.stack([np.minimum(i, j)[keep], np.maximum(i, j)[keep]]))
    a, b = np.concatenate(found, axis=1)
    if not len(a):
        return links, root
    while True:  # least row along the links, until nothing changes
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    used = np.unique(np.concatenate([a, b]))
    place = np.full(n, -1)
    place[used] = np.arange(len(used))
    sign = np.stack([cells(u[used], label[used], t) for t in range(TABLES)], axis=1)
    for k in range(0, len(a), 1 << 14):
        x, y = a[k:k + (1 << 14)], b[k:k + (1 << 14)]
        here = first_meeting(sign[place[x]], sign[place[y]]) == cell[x]
        np.add.at(links, x[here], copies[y[here]])
        np.add.at(links, y[here], copies[x[here]])
    return links, root


def links_of(groups: DataFrame, cosine: float) -> DataFrame:
    """Per group and linking node: node, root (least node reached) and links.
    ``groups`` is sorted within its partitions by cell, pair of blocks, node.
    Groups are compared some at a time, each with itself only."""
    def linked(held):
        b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        col = lambda c: b.column(b.schema.get_field_index(c))
        number = lambda c: col(c).to_numpy(zero_copy_only=False)
        cell, left, right = number("cell"), number("left"), number("right")
        new = np.concatenate([[False], (cell[1:] != cell[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])])
        group, side = np.cumsum(new), np.where(left != right, number("block"), -1)
        links, root = np.zeros(len(cell), np.int64), np.arange(len(cell))
        for at, u in _matrices(b):  # a cell's hash holds the length: hardly ever two in a group
            links[at], r = group_links(u, *(number(c)[at] for c in ("label", "copies", "home")), cell[at], side[at], group[at], cosine)
            root[at] = at[r]
        hit = np.flatnonzero((links > 0) | (root != np.arange(len(root))))
        return pa.RecordBatch.from_arrays([col("node").take(pa.array(hit)), col("node").take(pa.array(root[hit])), pa.array(links[hit])],
                                          names=["node", "root", "links"])

    def compare(batches):
        held: list[pa.RecordBatch] = []
        rows, last = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(b.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("cell", "left", "right")], axis=1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            if last is not None and (key[0] != last).any():
                cuts = np.concatenate([[0], cuts])
            start = 0
            for c in cuts.tolist():  # a group ends before row c
                if rows + c - start >= TOGETHER:
                    if c > start:
                        held.append(b.slice(start, c - start))
                    yield linked(held)
                    held, rows, start = [], 0, c
            held.append(b.slice(start))
            rows, last = rows + b.num_rows - start, key[-1]
        if held:
            yield linked(held)
    return groups.mapInArrow(compare, "node binary, root binary, links long")


def near_vectors(rows: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """Per row: vec_id, n_links, component_id and kept."""
    rows = write_table(keyed(rows), "vector-keys")
    nodes = rows.where("key is not null").groupBy("key").agg(
        F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"),
        F.first("width").alias("width"), F.first("vector").alias("vector"))
    nodes = write_table(nodes.select(node_name(F.col("vec_id"), F.col("key")).alias("node"), "key", "copies", "label", "width", "vector"), "vector-nodes")

    spread = write_table(cell_rows(nodes), "cells")
    met = spread.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.bool_or("home").alias("lived")).where("lived and n > 1")
    parts = F.ceil(F.col("n") / block).cast("int")
    at = (spread.join(met, "cell").withColumn("parts", parts)
          .withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
          .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
          .select("node", "cell", "home", "block", F.least("block", "_other").alias("left"), F.greatest("block", "_other").alias("right")))
    key = ("cell", "left", "right")
    groups = at.join(nodes.drop("key"), "node").repartition(*key).sortWithinPartitions(*key, "node")
    found = write_table(links_of(groups, cosine), "vector-links")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = (nodes.select("node", "key", "copies").join(links, "node", "left").join(roots, "node", "left")
             .where("copies > 1 or links is not null")
             .select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                     vec_id_of(F.coalesce("root", "node")).alias("component_id"), F.lit(True).alias("_known")))
    component = F.when(F.col("_known"), F.col("component_id")).otherwise(F.col("vec_id"))
    return rows.select("vec_id", "key").join(known, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"))


def op12_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and component among those of its label."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs of a label, compared one by one (equal when no pair is missed).
OP12_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, [CAST(c AS DOUBLE) FOR c IN embedding] AS x FROM embeddings),
u AS (SELECT vec_id, label, x, sqrt(list_sum([c * c FOR c IN x])) AS n FROM v
      WHERE label IS NOT NULL AND x IS NOT NULL AND len([c FOR c IN x IF c IS NULL OR NOT isfinite(c)]) = 0),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
      WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.98),
reach AS (SELECT vec_id, vec_id AS r FROM v UNION SELECT reach.vec_id, p.b FROM reach JOIN p ON p.a = reach.r),
least AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT v.vec_id, coalesce(k.n, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN least USING (vec_id) LEFT JOIN (SELECT a, count(*) AS n FROM p GROUP BY 1) k ON k.a = v.vec_id
"""
