"""Set-similarity self-join of documents on word n-grams (operator 7).

A document's set holds the 64-bit hashes of its distinct ``n``-word shingles
(with fewer words, the whole sequence). Two sets link when their Jaccard
similarity reaches ``percent``/100. Equal sets share one node, whose identity
is a hash of the set, so copies cost one row per task and never become pairs.

1. ``sets``: per document its node and set size.
2. ``frequencies``: document counts of all shingles. Each task packs its
   distinct shingles, ``PACKED`` at a time, as sorted, delta-coded and
   compressed numbers per hash range (their upper bits, 4 times as many values
   as there are shingles: 1 to 2 bytes each); one group per range adds up the
   counts. Only those above ``EQUAL`` are kept.
3. Rare first: shingles are ordered by count (those of at most ``tau`` count as
   equally rare), then by hash. ``tau`` is the least such power of two with which
   the table of frequent shingles stays within ``HEAVY_ROWS``. Any fixed order
   gives the same links; the order only decides how many candidates there are.
4. Prefix filter: similar sets share a shingle among their first
   size - ceil(t * size) + 1. ``shared_bits`` counts the prefixes' shingles in
   the same packed form (64 times as many values) and marks those that occur
   more than once in a bitmap of at most 2^``MAX_BITS`` bits, so that most
   prefix rows (shingle, node, size, position) that meet nothing are never
   written. A bit that several shingles have in common only lets a row through.
   ``met`` deals the rows by shingle once, drops repeated ones, and leaves those
   whose shingle several nodes have, each with the pair it makes with the least
   node of its shingle.
5. Candidates pass a length filter and a positional filter at the first shingle
   they share (those left after it bound the overlap), and, once per pair, a
   suffix filter: the Hamming distance of two parity signatures (2 bits or more
   for each shingle) never exceeds the sets' symmetric difference, so a larger
   one than t allows rules the pair out without its sets. Folding a signature
   keeps that bound, only less tight.
   First every node meets only the least node of each shingle; the links found
   make components, and pairs inside a component need no proof. Shingles that
   still hold several components stay open. While their pairs across components
   far outnumber their rows and many links are found, there are turns in which
   each row meets one other node of its shingle, chosen by hash; so a family of
   near copies becomes one component before its pairs are formed. At last all
   pairs across components are tried. From the second step on, the signatures,
   folded to 512 bits, are compared inside the join, so pairs that they rule out
   are never rows.
6. Each remaining pair is verified once on the whole sets.

Null and empty texts (and texts of white space) have an empty set, size 0, and
are their own component. Null doc_id rows take part; a component's id is its
smallest non-null doc_id. Repeated rows come back as often as they came. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import BROADCAST_BYTES, broadcast_if_small, documents, drop_table, settings, text_digest, without, write_table
from .components import components

N = 5
PERCENT = 75
RANGE_TOKENS = 2_000_000  # shingles that one range gathers, on average
PACKED = 1 << 21          # shingles that a task packs together
HEAVY_ROWS = 1_000_000
EQUAL = 16                # counts up to this one are equally rare
MAX_BITS = 29             # logarithm of the bits of the shared shingles (64 MB)
CROWDED = 4               # pairs a row from which further turns pay
FOLD = 8                  # 64-bit numbers of a folded signature


# ------------------------------------------------------------------ kernels
def doc_sets(batch, n: int = N):
    """(rows, shingles, first): the sorted distinct shingle hashes of each text
    of a chunk, one after the other; ``first`` has each text's first index."""
    for rows, data, off in tb.text_chunks(batch, "text"):
        low = tb.LOWER[data]
        starts, ends, first = tb.word_spans(low, off, tb.NON_SPACE)
        h = tb.span_hashes(low, starts, ends)
        words = np.diff(first)
        grams = tb.gram_hashes(h, n)
        doc = np.repeat(np.arange(len(rows)), words)[:len(grams)]
        at = np.arange(len(grams))
        inside = at + n <= first[doc + 1]
        val, own = grams[inside], doc[inside]
        few = np.flatnonzero((words > 0) & (words < n))
        if len(few):
            whole = np.array([tb.gram_hashes(h[first[d]:first[d + 1]], int(words[d]))[0] for d in few], np.uint64)
            # other lengths must not meet whole shingles of n words
            val = np.concatenate([val, tb.mix64(whole ^ words[few].astype(np.uint64))])
            own = np.concatenate([own, few])
        order = np.lexsort((val, own))
        val, own = val[order], own[order]
        if len(val):
            new = np.empty(len(val), bool)
            new[0] = True
            new[1:] = (val[1:] != val[:-1]) | (own[1:] != own[:-1])
            val, own = val[new], own[new]
        yield rows, val, np.searchsorted(own, np.arange(len(rows) + 1))


def node_ids(val: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of each set, as signed 64-bit; 0 for empty sets."""
    run = np.zeros(len(val) + 1, np.uint64)
    np.cumsum(tb.mix64(val * np.uint64(0x9E3779B97F4A7C15)), out=run[1:])
    size = np.diff(first).astype(np.uint64)
    h = tb.mix64((run[first[1:]] - run[first[:-1]]) ^ (size * np.uint64(0xD6E8FEB86659FD93)))
    h[size == 0] = 0
    return h.view(np.int64)


def signature(shingles: np.ndarray) -> bytes:
    """Parity of the shingles in each of 2^k classes, two for each shingle."""
    bits = 1 << max(9, int(2 * len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sign: bytes) -> np.ndarray:
    """A signature folded to ``FOLD`` 64-bit numbers."""
    return np.bitwise_xor.reduce(np.frombuffer(sign, np.int64).reshape(-1, FOLD), axis=0)


def hamming(x: np.ndarray, y: np.ndarray) -> int:
    """Distance of two signatures; the longer one is folded to the shorter."""
    if len(x) < len(y):
        x, y = y, x
    return int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0) ^ y).sum())


def prefix_len(size: np.ndarray, percent: int) -> np.ndarray:
    return np.where(size > 0, size + (-percent * size) // 100 + 1, 0)


# ------------------------------------------------------------------ steps
def sets(docs: DataFrame, n: int = N, digest: Column | None = None) -> DataFrame:
    """Per document: digest, node, set size, signature, and the signature folded."""
    def scan(batches):
        for b in batches:
            for rows, val, first in doc_sets(b, n):
                signs = [signature(val[x:y]) for x, y in zip(first[:-1], first[1:], strict=True)]
                fold = np.concatenate([folded(x) for x in signs])
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(node_ids(val, first)), pa.array(np.diff(first).astype(np.int32)), pa.array(signs, pa.binary()),
                     tb.list_array(pa.array(fold), np.arange(len(signs) + 1) * FOLD)],
                    names=["doc_id", "digest", "node", "size", "sign", "fold"])
    digest = F.lit(None).cast("binary") if digest is None else digest
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"), docs["text"]).mapInArrow(
        scan, "doc_id long, digest binary, node long, size int, sign binary, fold array<long>")


def token_bits(total: int) -> int:
    """Upper bits by which the prefixes of ``total`` shingles are counted; two share
    a number by chance with a probability of at most 1/64 (up to 2^40 shingles)."""
    return min(46, max(16, total.bit_length() + 6))


def count_bits(total: int) -> int:
    """Upper bits by which ``total`` shingles are counted for their order. A
    number that several share has their counts together, which may only change
    the order (of all their occurrences alike)."""
    return min(46, max(16, total.bit_length() + 2))


def pack(tokens: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted numbers as 32-bit differences (escapes as 64-bit), and counts,
    both byte by byte, compressed."""
    gap = np.diff(tokens, prepend=np.uint64(0))
    wide = gap >= np.uint64(0xFFFFFFFF)
    head = np.array([len(tokens), wide.sum()], np.int64)
    planes = lambda x: x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    body = b"".join((planes(np.where(wide, np.uint64(0xFFFFFFFF), gap).astype(np.uint32)), planes(counts.astype(np.uint16)), gap[wide].tobytes()))
    return head.tobytes() + pa.Codec("zstd", 1).compress(body, asbytes=True)


def unpack(blob: bytes):
    n, w = (int(v) for v in np.frombuffer(blob, np.int64, 2))
    body = pa.Codec("zstd", 1).decompress(blob[16:], 6 * n + 8 * w, asbytes=True)
    whole = lambda kind, at: np.frombuffer(body, np.uint8, n * kind().itemsize, at).reshape(kind().itemsize, n).T.copy().view(kind).ravel()
    gap = whole(np.uint32, 0).astype(np.uint64)
    gap[gap == np.uint64(0xFFFFFFFF)] = np.frombuffer(body, np.uint64, w, 6 * n)
    return np.cumsum(gap, dtype=np.uint64), whole(np.uint16, 4 * n)


def packed(val: np.ndarray, bits: int, ranges: int) -> pa.RecordBatch:
    """(part, blob): the numbers of the shingles and their counts, by range."""
    t, c = np.unique(val >> np.uint64(64 - bits), return_counts=True)
    cut = np.searchsorted((t * np.uint64(ranges)) >> np.uint64(bits), np.arange(ranges + 1, dtype=np.uint64))
    c = np.minimum(c, 0xFFFF)
    full = np.flatnonzero(np.diff(cut))
    return pa.RecordBatch.from_arrays(
        [pa.array(full.astype(np.int32)), pa.array([pack(t[cut[i]:cut[i + 1]], c[cut[i]:cut[i + 1]]) for i in full], pa.binary())], names=["part", "blob"])


def packs(vals, bits: int, ranges: int):
    """``packed`` batches of the shingles of many chunks, ``PACKED`` or more at
    a time: the more lie in one batch, the smaller their differences."""
    held, size = [], 0
    for val in vals:
        held.append(val)
        size += len(val)
        if size >= PACKED:
            yield packed(np.concatenate(held), bits, ranges)
            held, size = [], 0
    if size:
        yield packed(np.concatenate(held), bits, ranges)


def added(table: pa.Table):
    """The distinct numbers of a range and the sums of their counts."""
    parts = [unpack(x.as_py()) for x in table.column("blob")]
    t = np.concatenate([p[0] for p in parts])
    c = np.concatenate([p[1] for p in parts]).astype(np.int64)
    order = np.argsort(t, kind="stable")
    t, c = t[order], c[order]
    at = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    return t[at], np.add.reduceat(c, at)


def one_of_each(ids: np.ndarray) -> np.ndarray:
    """Marks the first of equal sets of a chunk."""
    one = np.zeros(len(ids), bool)
    one[np.unique(ids, return_index=True)[1]] = True
    return one


def frequencies(docs: DataFrame, total: int, n: int = N) -> DataFrame:
    """(token, count) of the shingles (their upper ``count_bits``) that occur
    more than ``EQUAL`` times; ``total``: how many there are in all sets."""
    bits, ranges = count_bits(total), total // RANGE_TOKENS + 1

    def scan(batches):
        chunks = (c for b in batches for c in doc_sets(b, n))
        yield from packs((val[np.repeat(one_of_each(node_ids(val, first)), np.diff(first))] for _, val, first in chunks), bits, ranges)

    def add(table: pa.Table) -> pa.Table:
        t, c = added(table)
        return pa.table({"token": pa.array(t[c > EQUAL].view(np.int64)), "count": pa.array(c[c > EQUAL])})

    return (docs.select(F.lit(0).alias("doc_id"), "text").mapInArrow(scan, "part int, blob binary")
            .groupBy("part").applyInArrow(add, "token long, count long"))


def heavy_table(freq: DataFrame, limit: int = HEAVY_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles and their counts: at most ``limit`` of them."""
    tau = EQUAL
    by = {int(r[0]): int(r[1]) for r in freq.where(f"count > {tau}").groupBy(F.floor(F.log2(F.col("count") - 1))).count().collect()}
    while sum(v for k, v in by.items() if 2 ** k >= tau) > limit:
        tau *= 2
    rows = freq.where(f"count > {tau}").toPandas().sort_values("token")
    return rows["token"].to_numpy(np.int64).astype(np.uint64), rows["count"].to_numpy(np.int64)


def doc_prefixes(batch, heavy, bits: int, percent: int, n: int):
    """(shingle, node, size, position) arrays of the first shingles, rare ones
    first, of each different set of a chunk."""
    keys, counts = heavy
    for _, val, first in doc_sets(batch, n):
        ids, size = node_ids(val, first), np.diff(first)
        one = one_of_each(ids) & (size > 0)
        doc = np.repeat(np.arange(len(ids)), size)
        rank = np.zeros(len(val), np.int64)
        if len(keys):
            short = val >> np.uint64(64 - bits)
            at = np.searchsorted(keys, short)
            at[at == len(keys)] = 0
            rank = np.where(keys[at] == short, counts[at], 0)
        order = np.lexsort((val, rank, doc))
        pos = np.arange(len(val)) - first[doc]
        keep = one[doc] & (pos < prefix_len(size, percent)[doc])
        d = doc[keep]
        yield val[order][keep], ids[d], size[d].astype(np.int32), pos[keep].astype(np.int32)


def slots(tokens: np.ndarray, own: int, bits: int) -> np.ndarray:
    """Places in the bitmap of numbers of ``own`` bits."""
    return (tokens >> np.uint64(own - bits)).astype(np.int64)


def shared_bits(docs: DataFrame, heavy, total: int, percent: int = PERCENT, n: int = N) -> tuple[np.ndarray, int]:
    """A bitmap of the prefixes' shingles that occur more than once, and the
    logarithm of its length. ``heavy``: broadcast frequent shingles."""
    own, order, ranges = token_bits(total), count_bits(total), total // RANGE_TOKENS + 1
    bits = min(MAX_BITS, max(10, total.bit_length()))

    def scan(batches):
        yield from packs((val for b in batches for val, *_ in doc_prefixes(b, heavy.value, order, percent, n)), own, ranges)

    def mark(table: pa.Table) -> pa.Table:
        t, c = added(table)
        at = slots(t[c > 1], own, bits)
        if not len(at):
            return pa.table({"start": pa.array([], pa.int64()), "marks": pa.array([], pa.binary())})
        start = int(at[0]) // 8
        on = np.zeros(int(at[-1]) + 1 - 8 * start, np.uint8)
        on[at - 8 * start] = 1
        return pa.table({"start": pa.array([start]), "marks": pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())})

    found = docs.select(F.lit(0).alias("doc_id"), "text").mapInArrow(scan, "part int, blob binary").groupBy("part").applyInArrow(mark, "start long, marks binary")
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in found.collect():
        out[r["start"]:r["start"] + len(r["marks"])] |= np.frombuffer(r["marks"], np.uint8)
    return out, bits


def prefixes(docs: DataFrame, heavy, shared, total: int, percent: int = PERCENT, n: int = N) -> DataFrame:
    """(token, node, size, pos) of each set's first shingles that may occur in
    another one's. ``heavy`` and ``shared``: broadcast results of the counts."""
    order = count_bits(total)

    def scan(batches):
        marks, bits = shared.value
        for b in batches:
            for v, node, size, pos in doc_prefixes(b, heavy.value, order, percent, n):
                at = slots(v, 64, bits)
                met = (marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v[met].view(np.int64)), pa.array(node[met]), pa.array(size[met]), pa.array(pos[met])], names=["token", "node", "size", "pos"])
    return docs.select(F.lit(0).alias("doc_id"), "text").mapInArrow(scan, "token long, node long, size int, pos int")


def _fits(percent: int):
    """Length and positional filter of two prefix rows a, b. It holds at the
    first shingle that two linked sets share."""
    both = F.col("a.size") + F.col("b.size")
    shared = F.least(F.col("a.size") - F.col("a.pos"), F.col("b.size") - F.col("b.pos"))
    # overlap >= percent * union / 100  <=>  overlap * (100 + percent) >= percent * both
    return ((100 * F.least("a.size", "b.size") >= percent * F.greatest("a.size", "b.size"))
            & ((100 + percent) * shared >= percent * both))


def _near(percent: int):
    """Suffix filter of two rows a, b on their folded signatures."""
    apart = sum((F.bit_count(F.col("a.fold")[i].bitwiseXOR(F.col("b.fold")[i])) for i in range(FOLD)), F.lit(0))
    return (100 + percent) * apart <= (100 - percent) * (F.col("a.size") + F.col("b.size"))


def _over(value: Column) -> Column:
    """``value`` over all rows of a shingle."""
    return value.over(Window.partitionBy("token"))


def met(rows: DataFrame, percent: int) -> DataFrame:
    """The different prefix rows whose shingle several nodes have, with the least
    node of the shingle (``least``) where the two may link and null elsewhere."""
    row = F.struct("node", "size", "pos")
    # dealt by shingle once, for the distinct rows, the least nodes and those they meet
    rows = rows.repartition("token").distinct().select(
        "token", row.alias("b"), _over(F.min(row)).alias("a"), _over(F.max("node")).alias("most")).where("a.node < most")
    return rows.select("token", "b.*", F.when((F.col("a.node") < F.col("b.node")) & _fits(percent), F.col("a.node")).alias("least"))


def if_few(nodes: DataFrame, some: DataFrame) -> DataFrame:
    """Only the nodes of ``some`` where these can be broadcast, else all."""
    return nodes.join(F.broadcast(some), "node", "left_semi") if some.count() * 16 <= BROADCAST_BYTES else nodes


def verify(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, percent: int, n: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets link."""
    def scan(batches):
        for b in batches:
            for _, val, first in doc_sets(b, n):
                each = [val[x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(node_ids(val, first)), pa.array(each, pa.binary())], names=["node", "shingles"])

    def suffix(batches):
        for b in batches:
            keep = []
            for m, k, x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), b.column(5), strict=True):
                apart = hamming(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8))
                keep.append((100 + percent) * apart <= (100 - percent) * (m + k))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def overlap(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * both >= percent * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda rows, end, *cols: rows.select(F.col("node").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in cols))
    both_ends = lambda rows: rows.select(F.col("a").alias("node")).unionByName(rows.select(F.col("b").alias("node"))).distinct()
    nodes = if_few(nodes, both_ends(pairs))
    near = (pairs.join(of(nodes, "b", "size", "sign"), "b").join(of(nodes, "a", "size", "sign"), "a")
            .select("a", "b", "a_size", "b_size", "a_sign", "b_sign").mapInArrow(suffix, "a long, b long"))
    near = write_table(near, "near-pairs")
    # one document of each node that is left supplies its text
    wanted = write_table(nodes.select("node", "doc_id").join(broadcast_if_small(both_ends(near), 16), "node", "left_semi"), "wanted")
    ids = broadcast_if_small(wanted.select(F.col("doc_id").alias("_id")).distinct(), 16)
    texts = docs.select("doc_id", "text")
    texts = texts.join(ids, texts["doc_id"].eqNullSafe(ids["_id"]), "left_semi")
    found = texts.mapInArrow(scan, "node long, shingles binary").join(broadcast_if_small(wanted.select("node"), 16), "node", "left_semi")
    found = write_table(found.dropDuplicates(["node"]), "shingles")
    both = near.join(of(found, "b", "shingles"), "b").join(of(found, "a", "shingles"), "a").select("a", "b", "a_shingles", "b_shingles")
    out = write_table(both.mapInArrow(overlap, "a long, b long"), "links")
    for table in (near, wanted, found):
        drop_table(table)
    return out


def links(docs: DataFrame, nodes: DataFrame, percent: int = PERCENT, n: int = N) -> DataFrame:
    """Verified links (a, b) between nodes; with those between equal sets they
    connect exactly the documents that all links connect."""
    total = int(nodes.agg(F.sum(F.col("size") * F.col("copies"))).first()[0] or 0)
    send = docs.sparkSession.sparkContext.broadcast
    freq = write_table(frequencies(docs, total, n), "frequencies")
    heavy = send(heavy_table(freq))
    drop_table(freq)
    shared = send(shared_bits(docs, heavy, total, percent, n))
    rows = write_table(met(prefixes(docs, heavy, shared, total, percent, n), percent), "prefixes")
    heavy.unpersist()
    shared.unpersist()

    pair = [F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")]
    first = write_table(rows.where("least IS NOT NULL").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct(), "first-pairs")
    linked = verify(docs, first, nodes, percent, n)

    found, tried, turn = linked, first, 0
    root = components(found)
    held = rows
    while True:
        rows = _open_rows(rows, root, nodes)
        drop_table(held)
        held = rows
        if not _crowded(rows, found):
            break
        # every node meets one node of each shingle, another one each turn
        turn += 1
        row = ["node", "root", "size", "pos", "fold"]
        lead = _over(F.min(F.struct(F.xxhash64("node", "token", F.lit(turn)).alias("order"), *row)))
        pairs = rows.select(lead.alias("a"), F.struct(*row).alias("b")).where((F.col("a.root") != F.col("b.root")) & _fits(percent) & _near(percent))
        pairs = write_table(pairs.select(*pair).distinct().join(tried, ["a", "b"], "left_anti"), "turn-pairs")
        found = verify(docs, pairs, nodes, percent, n)
        linked, tried = linked.unionByName(found), tried.unionByName(pairs)
        root = components(root.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found))
    cross = rows.alias("a").join(rows.alias("b"), (F.col("a.token") == F.col("b.token")) & (F.col("a.root") < F.col("b.root"))
                                 & _fits(percent) & _near(percent))
    cross = write_table(cross.select(*pair).distinct().join(tried, ["a", "b"], "left_anti"), "cross-pairs")
    out = linked.unionByName(verify(docs, cross, nodes, percent, n))
    for table in (cross, held):
        drop_table(table)
    return out


def _open_rows(rows: DataFrame, root: DataFrame, nodes: DataFrame) -> DataFrame:
    """Prefix rows, with their component and folded signature, of the shingles
    that hold several components."""
    root = broadcast_if_small(root, 16)
    rows = rows.select("token", "node", "size", "pos").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    many = rows.withColumn("lo", _over(F.min("root"))).withColumn("hi", _over(F.max("root"))).where("lo <> hi").drop("lo", "hi")
    return write_table(many.join(nodes.select("node", "fold"), "node"), "open")


def _crowded(rows: DataFrame, found: DataFrame) -> bool:
    """Whether another turn of one meeting a row pays: the pairs across
    components outnumber the rows by far, and the last step found links for
    more than a thousandth of the rows. It decides the cost, not the result."""
    per = rows.select("token", "root").repartition("token").groupBy("token", "root").count().groupBy("token").agg(F.sum("count").alias("n"), F.sum(F.expr("double(count) * count")).alias("same"))
    n, pairs = per.agg(F.sum("n"), F.sum(F.expr("(double(n) * n - same) / 2"))).first()
    return n is not None and pairs > CROWDED * n and 1000 * found.count() > n


def placed(docs: DataFrame, percent: int = PERCENT, n: int = N, digest: Column | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, digest, size, and of its component the
    smallest doc_id (component_id) and the row that comes first by doc_id
    (null last), then digest; both null for an empty set."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    # every step below is written once: its shuffle files go when it is done
    with settings(docs.sparkSession, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        index = write_table(sets(docs, n, digest), "sets")
        nodes = index.where("size > 0").groupBy("node").agg(
            F.min("doc_id").alias("doc_id"), F.min(place).alias("row"), F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in ("size", "sign", "fold")))
        nodes = write_table(nodes, "nodes")
        root = write_table(components(links(docs, nodes, percent, n)), "roots")
    nodes = nodes.select("node", "row").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = nodes.groupBy("root").agg(F.min("row").alias("row"))
    nodes = nodes.drop("row").join(firsts, "root").select("node", F.col("row.doc_id").alias("component_id"), F.col("row.digest").alias("first_digest"))
    return index.select("doc_id", "digest", "node", "size").join(nodes, "node", "left").drop("node")


def ngram_components(docs: DataFrame, percent: int = PERCENT, n: int = N) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id."""
    return placed(docs, percent, n).select(
        "doc_id", F.col("size").cast("long").alias("n_shingles"),
        F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its set's size and its component by links of 0.75."""
    return ngram_components(documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: the one with the smallest doc_id (a row
    without doc_id only if none has one), of several the one whose text has the
    smallest digest. Rows with an empty set stay."""
    first = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("digest") == F.col("first_digest"))
    found = write_table(placed(docs, digest=text_digest(docs)).where("size > 0").select("doc_id", "digest", first.alias("kept")), "near-verdict")
    left = without(docs, found.where("NOT kept"))
    # the row that stays may itself be repeated (same doc_id and text)
    twice = write_table(found.where("kept").groupBy("doc_id", "digest").count().where("count > 1"), "near-repeated")
    if twice.isEmpty():
        return left
    return without(left, twice).unionByName(without(left, twice, "left_semi").dropDuplicates(["doc_id", "text"]))


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
       'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[p:p + 4], ' ') FOR p IN range(1, len(w) - 3)]
       WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
r AS (SELECT doc_id AS a, doc_id AS c FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(c) AS c FROM r GROUP BY 1) c ON c.a = w.doc_id
"""
