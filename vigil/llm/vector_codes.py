"""Vector codes with adaptive bounds on the distances (operator 13).

A vector is cut into ``PARTS`` equal parts; each part position has a codebook
of ``ENTRIES`` integer entries, trained by ``ROUNDS`` rounds of assignment and
componentwise floored means, all in integers.

Assignment by Drake and Hamerly's adaptive bounds. The state of a part, written
between the rounds, holds its b closest entries in order, a lower bound on the
distance to each but the first, and one outer bound for all entries that are
not listed. When entries move, the distance to the first is taken anew and the
bounds shrink by the entries' movements. If the distance lies below all bounds
the assignment stands; if it lies below all from the z-th on, only the entries
before that are measured and put in order again; else all are. b begins at
``LISTED`` and is lowered after each round to the least that would have served
``COVER`` of the parts that the lists decided. Bounds are floating point with a margin; whatever they leave open, ties
included, is settled with integer distances, so the codes are those of a full
search.

A task holds one Arrow batch; the codebooks (PARTS x ENTRIES entries) and their
sums are all that the driver sees. Each round's state is a table in the shared
folder, and the one before it is deleted.

Null vectors and those with null or non-finite components are dropped; so are
vectors that differ in length from the one with the smallest vec_id, or whose
length is 0 or no multiple of ``PARTS``. Components must be below 65,536 in
size (an error otherwise). Rows that tie in vec_id seed the codebook in the
order of their components; a null vec_id comes last. Fewer rows than entries
give as many entries as rows; an empty table gives no rows. Repeated rows are
rows of their own; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, drop_table, write_table
from .vectors import blocks, packed, unpacked

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
LISTED = 8
COVER = 0.95
#: Relative margin of the floating-point bounds; closer calls go to integers.
MARGIN = 1e-5


def whole_vectors(rows: DataFrame, width: int, scale: int = SCALE) -> DataFrame:
    """vec_id, label and the components floor(scale * x) as packed integers of
    the rows whose vector has ``width`` finite components."""
    def cut(batches):
        for b in batches:
            for at, x in blocks(b.column(2)):
                if x.shape[1] == width and len(at):
                    x = np.floor(x * scale)
                    if np.abs(x).max() >= 2.0 ** 28:
                        raise ValueError("vector components must be below 65536 in size")
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), packed(x.astype(np.int32))],
                                                     names=["vec_id", "label", "parts"])
    return rows.mapInArrow(cut, f"vec_id long, label {dict(rows.dtypes)['label']}, parts binary")


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows x entries) of integer vectors."""
    out = np.zeros((len(x), len(entries)), np.int64)
    for j in range(x.shape[1]):
        d = x[:, j, None].astype(np.int64) - entries[None, :, j]
        out += d * d
    return out


def squared_to(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row to an entry (or entries) of its own."""
    d = x.astype(np.int64).reshape((len(x),) + (1,) * (entries.ndim - 2) + (-1,)) - entries
    return (d * d).sum(axis=-1)


def _down(v):
    return (v * (1 - MARGIN)).astype(np.float32)


def full_search(x: np.ndarray, book: np.ndarray, listed: int):
    """(ids, bounds): the ``listed`` nearest entries in order, ties to the
    lower index, and lower bounds for all but the first and for the rest."""
    d = squared(x, book)
    order = np.argsort(d, axis=1, kind="stable")
    near = np.sqrt(np.take_along_axis(d, order[:, 1:listed + 1], axis=1).astype(np.float64))
    if near.shape[1] < listed:  # every entry is listed: nothing lies beyond
        near = np.concatenate([near, np.full((len(x), listed - near.shape[1]), np.inf)], axis=1)
    return order[:, :listed].astype(np.uint8), _down(near)


def shrunk(bounds: np.ndarray, ids: np.ndarray, moved: np.ndarray) -> np.ndarray:
    """The bounds, in double precision, after the entries moved."""
    far = np.concatenate([moved[ids[:, 1:]], np.full((len(ids), 1), moved.max())], axis=1)
    return bounds.astype(np.float64) * (1 - MARGIN) - far


def search(x: np.ndarray, ids: np.ndarray, bounds: np.ndarray, book: np.ndarray, moved: np.ndarray):
    """One assignment of the parts ``x`` after the entries moved. Returns ids
    and bounds (changed in place) and how many entries each part had to
    measure: 1 where the bounds decided, ``len(book)`` in a full search."""
    listed = ids.shape[1]
    bounds[:] = shrunk(bounds, ids, moved)
    now = np.sqrt(squared_to(x, book[ids[:, 0]]).astype(np.float64)) * (1 + MARGIN)
    # the least bound from each place on: below it, nothing from there is nearer
    beyond = np.minimum.accumulate(bounds[:, ::-1], axis=1)[:, ::-1]
    clear = now[:, None] < beyond
    used = np.where(clear.any(axis=1), clear.argmax(axis=1) + 1, len(book))
    for z in range(2, listed + 1):
        at = np.flatnonzero(used == z)
        if len(at):
            mine = ids[at, :z].astype(np.int64)
            d = squared_to(x[at], book[mine])
            order = np.lexsort((mine, d), axis=1)
            ids[at, :z] = np.take_along_axis(mine, order, axis=1)
            bounds[at, :z - 1] = _down(np.sqrt(np.take_along_axis(d, order, axis=1)[:, 1:].astype(np.float64)))
    at = np.flatnonzero(used > listed)
    if len(at):
        ids[at], bounds[at] = full_search(x[at], book, listed)
    return ids, bounds, used


def _arrays(batch: pa.RecordBatch, width: int, listed: int):
    x = unpacked(batch.column(2), np.int32, width).reshape(-1, PARTS, width // PARTS)
    if batch.num_columns == 3:
        return x, None, None
    return (x, unpacked(batch.column(3), np.uint8, PARTS * listed).reshape(-1, PARTS, listed).copy(),
            unpacked(batch.column(4), np.float32, PARTS * listed).reshape(-1, PARTS, listed).copy())


def assign(state: DataFrame, books: np.ndarray, moved: np.ndarray | None, before: int, listed: int, width: int) -> DataFrame:
    """The next state: per row its parts, and for each part the ``listed``
    closest entries, their bounds and how many entries were measured."""
    shared = state.sparkSession.sparkContext.broadcast((books, moved))

    def step(batches):
        books, moved = shared.value
        for b in batches:
            x, ids, bounds = _arrays(b, width, before)
            n = len(x)
            out_ids, out_bounds = np.empty((n, PARTS, listed), np.uint8), np.empty((n, PARTS, listed), np.float32)
            used = np.zeros((n, PARTS), np.uint8)
            for p in range(PARTS):
                if ids is None:
                    out_ids[:, p], out_bounds[:, p] = full_search(x[:, p], books[p], listed)
                    continue
                mine, bound = ids[:, p], bounds[:, p]
                if listed < before:  # entries that leave the list fall under the outer bound
                    rest = bound[:, listed - 1:].min(axis=1, keepdims=True)
                    bound, mine = np.concatenate([bound[:, :listed - 1], rest], axis=1), mine[:, :listed].copy()
                out_ids[:, p], out_bounds[:, p], used[:, p] = search(x[:, p], mine, bound, books[p], moved[p])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), packed(out_ids.reshape(n, -1)), packed(out_bounds.reshape(n, -1)), packed(used)],
                                             names=["vec_id", "label", "parts", "ids", "bounds", "used"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema.fields[:3])
    return state.mapInArrow(step, f"{fields}, ids binary, bounds binary, used binary")


def sums(state: DataFrame, entries: int, listed: int, width: int):
    """Exact sums and counts of the assigned parts, {(part, entry, component):
    (sum, count)}, and of how many parts 1, 2, ... entries were measured."""
    d = width // PARTS

    def add(batches):
        count, total, used = np.zeros((PARTS, entries), np.int64), np.zeros((PARTS, entries, d), np.int64), np.zeros(entries + 1, np.int64)
        for b in batches:
            x, ids, _ = _arrays(b, width, listed)
            used += np.bincount(unpacked(b.column(5), np.uint8, PARTS).reshape(-1), minlength=entries + 1)
            for p in range(PARTS):
                own = ids[:, p, 0].astype(np.int64)
                count[p] += np.bincount(own, minlength=entries)
                np.add.at(total[p], own, x[:, p].astype(np.int64))
        part, entry = np.nonzero(count)
        got = [(int(p), int(e), int(count[p, e]), total[p, e].tolist()) for p, e in zip(part, entry, strict=True)]
        got += [(-1, z, int(n), [0]) for z, n in enumerate(used.tolist()) if n]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            zip(*got, strict=True) if got else [[]] * 4, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())), strict=True)],
            names=["part", "entry", "n", "total"])
    # a sum for each part, entry and component, and ``entries`` counts, reach the driver
    rows = (state.mapInArrow(add, "part int, entry int, n long, total array<long>")
            .select("part", "entry", "n", F.posexplode("total").alias("at", "x"))
            .groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect())
    return ({(r["part"], r["entry"], r["at"]): (int(r["x"]), r["n"]) for r in rows if r["part"] >= 0},
            {r["entry"]: r["n"] for r in rows if r["part"] < 0})


def next_length(listed: int, used: dict, entries: int) -> int:
    """The least list length that would have served ``COVER`` of the parts
    decided by their lists; never longer than now nor below entries / 8."""
    decided = [used.get(z, 0) for z in range(1, listed + 1)]
    enough = np.flatnonzero(np.cumsum(decided) >= COVER * sum(decided))[0] + 1 if sum(decided) else listed
    return int(max(1, entries // 8, min(listed, enough)))


def moved_books(books: np.ndarray, added: dict):
    """The entries replaced by their parts' floored means (unused ones stay),
    and how far each has moved, rounded up."""
    new = books.copy()
    for (p, e, j), (x, n) in added.items():
        new[p, e, j] = x // n
    far = np.sqrt(((new - books) ** 2).sum(axis=2).astype(np.float64)) * (1 + MARGIN)
    return new, far


def book_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def vector_codes(rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, listed: int = LISTED, scale: int = SCALE):
    """(codes, books, log): per kept row vec_id, label, ids (an entry for each
    part) and error; the trained codebooks (part, entry, component); and for
    each round the list length and how many parts measured 1, 2, ... entries."""
    rows = rows.select(rows["vec_id"].cast("long").alias("vec_id"), rows["label"], rows["embedding"])
    spark = rows.sparkSession
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    first = rows.where(good).orderBy(F.asc_nulls_last("vec_id"), "embedding").select(F.size("embedding").alias("n")).first()
    width = first["n"] if first and first["n"] % PARTS == 0 else 0
    label = dict(rows.dtypes)["label"]
    if not width:
        return spark.createDataFrame([], f"vec_id long, label {label}, ids array<int>, error long"), np.zeros((PARTS, 0, 0), np.int64), []

    vectors = write_table(whole_vectors(rows, width, scale), "vectors")
    seeds = rows.where(good & (F.size("embedding") == width)).orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries)
    seeds = np.floor(np.array([r["embedding"] for r in seeds.collect()], np.float64) * scale).astype(np.int64)
    books = np.ascontiguousarray(seeds.reshape(len(seeds), PARTS, width // PARTS).transpose(1, 0, 2))
    entries = len(seeds)
    listed = before = max(1, min(listed, entries))
    state, moved, log = vectors, None, []
    for r in range(rounds + 1):
        old, state = state, write_table(assign(state, books, moved, before, listed, width), "assigned")
        drop_table(old)
        before = listed
        if r < rounds:
            added, used = sums(state, entries, listed, width)
            log.append((listed, used))
            books, moved = moved_books(books, added)
            if r:  # the first round measures everything and says nothing about the bounds
                listed = next_length(listed, used, entries)

    shared = spark.sparkContext.broadcast(books)

    def finish(batches):
        books = shared.value
        for b in batches:
            x, ids, _ = _arrays(b, width, before)
            own = ids[:, :, 0].astype(np.int64)
            error = sum(squared_to(x[:, p], books[p][own[:, p]]) for p in range(PARTS))
            codes = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * PARTS), pa.array(own.reshape(-1).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), codes, pa.array(error)], names=["vec_id", "label", "ids", "error"])
    return state.mapInArrow(finish, f"vec_id long, label {label}, ids array<int>, error long"), books, log


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code and error, its label's error, the codebooks' digest."""
    codes, books, _ = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    codes = write_table(codes, "codes")
    by_label = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").cast("long").alias("label_error"))
    by_label = broadcast_if_small(write_table(by_label, "label-errors"), 32)
    code = F.concat_ws("", F.transform("ids", lambda i: F.lpad(F.lower(F.hex(i)), 2, "0")))
    return codes.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", code.alias("code"), "error", "label_error", F.lit(book_digest(books)).alias("codebooks_sha256"))


def _op13_sql() -> str:
    """The rounds written out, one group of common table expressions each."""
    d = ["v AS (SELECT vec_id, label, [CAST(floor(4096 * CAST(c AS DOUBLE)) AS BIGINT) FOR c IN embedding] AS x FROM embeddings "
         "WHERE embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0)",
         f"p AS MATERIALIZED (SELECT vec_id, label, part, x[part * (len(x) // {PARTS}) + 1:(part + 1) * (len(x) // {PARTS})] AS x "
         f"FROM v, range({PARTS}) t(part))",
         "s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT 16)",
         "b0 AS MATERIALIZED (SELECT part, entry, x AS e FROM p JOIN s USING (vec_id))"]
    for r in range(ROUNDS + 1):
        d.append(f"a{r} AS MATERIALIZED (SELECT vec_id, label, part, x, min(struct_pack(d := d, entry := entry)) AS best FROM ("
                 f"SELECT vec_id, label, part, x, entry, CAST(list_sum([(x[i] - e[i]) * (x[i] - e[i]) FOR i IN range(1, len(x) + 1)]) AS BIGINT) AS d "
                 f"FROM p JOIN b{r} USING (part)) GROUP BY ALL)")
        if r < ROUNDS:
            d.append(f"m{r} AS (SELECT part, entry, list(m ORDER BY i) AS e FROM (SELECT part, best.entry AS entry, i, "
                     f"CAST(sum(x[i]) AS BIGINT) AS t, count(*) AS n, CASE WHEN t >= 0 THEN t // n ELSE -((n - 1 - t) // n) END AS m "
                     f"FROM a{r}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY 1, 2, 3) GROUP BY 1, 2)")
            d.append(f"b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{r}.e, b{r}.e) AS e FROM b{r} LEFT JOIN m{r} USING (part, entry))")
    return "WITH " + ",\n".join(d) + f""",
h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS}),
c AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error
      FROM a{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c, h
"""


OP13_SQL = _op13_sql()
