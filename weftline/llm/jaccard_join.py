"""Near-duplicate documents: n-gram Jaccard similarity join with Bayesian candidate pruning.

1. Each text becomes its set of word n-grams (64-bit hashes) and 63 MinHash values. Texts with one
   set are one *node*; copies are counted, never compared.
2. Nodes that agree in one of 21 bands of three values meet. A pair's MinHash values are compared
   nine at a time; after each step the pair is dropped if, under a uniform prior, the posterior
   probability that its similarity reaches the threshold is below ``tolerance``.
3. What is left links nodes to candidate groups; inside a group every pair that survives the same
   test is verified exactly on the whole sets, as counts of shared n-grams.

Pairs are never written out, and no task gathers a whole hot group. To join the nodes of a bucket or
group of over ``BLOCK`` nodes (or ``BLOCK_BYTES`` of sets), each block meets itself and a few pivots of the
group; only nodes that the best pivot does not reach meet all others, as pairs of blocks. So a group of
copies of one text moves once, not once for each block. Numbers of links need all pairs of a group: only
where they are asked for do large groups go out as all pairs of blocks.

Defined cases: a text with 1 to n-1 words has one n-gram, all its words; a null text or one without
words is in no group (its class is its own id, without links); rows that repeat an id are counted
as documents of their own; null ids keep their rows. Extra columns are ignored or, in the filter,
carried.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import Spans, Utf8, Words, cut, mix, table_path, with_columns
from .components import connected_components

ROWS, BANDS = 3, 21
VALUES = ROWS * BANDS
STEP = 9
BLOCK = 1024
#: Bytes of n-gram sets that a block holds, about.
BLOCK_BYTES = 48 << 20
#: Pivots of a large group.
PIVOTS = 4
#: Nodes to verify that may be broadcast (about 60 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 300_000

_rng = np.random.default_rng(71)
_MUL = (_rng.integers(0, 1 << 32, VALUES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_XOR = _rng.integers(0, 1 << 32, VALUES, dtype=np.uint64).astype(np.uint32)


# ---------------------------------------------------------------- sets and signatures
def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of all texts, text by text, ascending, and offsets."""
    utf8 = Utf8(texts)
    words = Words(utf8)
    hashes = Spans(utf8.data).of(words.starts, words.ends) if len(words.starts) else np.zeros(0, np.uint64)
    grams, first = words.windows(hashes, size)
    doc = np.searchsorted(words.first, first, "right") - 1
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        whole = [int.from_bytes(hashlib.blake2b(hashes[words.first[i] : words.first[i + 1]].tobytes(), digest_size=8).digest(), "little") for i in short]
        grams, doc = np.concatenate([grams, np.array(whole, np.uint64)]), np.concatenate([doc, short])
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[new], doc[new]
    return grams, np.searchsorted(doc, np.arange(utf8.n + 1))


def node_key(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _signatures(grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash values of each non-empty set, one row each."""
    starts = offsets[:-1][np.diff(offsets) > 0]
    x = (grams >> np.uint64(32)).astype(np.uint32) ^ grams.astype(np.uint32)
    out = np.empty((len(starts), VALUES), np.uint32)
    if len(starts):
        for k in range(VALUES):
            out[:, k] = np.minimum.reduceat((x ^ _XOR[k]) * _MUL[k], starts)
    return out


def _bands(signatures: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        s = signatures.astype(np.uint64).reshape(len(signatures), BANDS, ROWS)
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), s.shape[:2]).copy()
        for r in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + s[:, :, r])
    return key.view(np.int64)


def sketch(df: DataFrame, text: str, keep: list[str], size: int, minhash: bool = True) -> DataFrame:
    """``keep`` columns, node (null without words) and, with ``minhash``, size (n-grams), sig (16-bit values) and bands."""
    schema = T.StructType([T.StructField("node", T.BinaryType())] + minhash * [T.StructField("size", T.LongType()), T.StructField("sig", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def make():
        def kernel(texts: pa.Array) -> list[pa.Array]:
            grams, offsets = shingle_sets(texts, size)
            full = np.diff(offsets) > 0
            nodes = [node_key(grams[a:b]) if b > a else None for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            if not minhash:
                return [pa.array(nodes, pa.binary())]
            made = _signatures(grams, offsets)
            row, short, bands = np.cumsum(full) - 1, made.astype(np.uint16), _bands(made)
            has = full.tolist()
            return [
                pa.array(nodes, pa.binary()),
                pa.array(np.diff(offsets), pa.int64()),
                pa.array([short[r].tobytes() if f else None for f, r in zip(has, row.tolist(), strict=True)], pa.binary()),
                pa.array([bands[r] if f else None for f, r in zip(has, row.tolist(), strict=True)], pa.list_(pa.int64())),
            ]

        return kernel

    return with_columns(df, text, schema, make, keep=keep)


# ---------------------------------------------------------------- Bayesian pruning
def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For each number n of compared values, the fewest matches with P(similarity >= threshold) >= tolerance.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail at t equals the
    probability of at most m successes in n + 1 trials of probability t.
    """
    out = [0]
    for n in range(1, VALUES + 1):
        tail, m = 0.0, -1
        while tail < tolerance and m < n:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def prune(sig: np.ndarray, a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Indices into the pairs (a, b) that survive the incremental comparison of their values."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int16)
    for k in range(0, VALUES, STEP):
        stop = min(k + STEP, VALUES)
        matches = matches + (sig[a[alive], k:stop] == sig[b[alive], k:stop]).sum(1, dtype=np.int16)
        good = matches >= least[stop]
        alive, matches = alive[good], matches[good]
        if not len(alive):
            break
    return alive


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index of each item's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _pairs(lo: int, hi: int, side: np.ndarray, at: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of one bucket (lo = hi) or between its two blocks, in bounded pieces; ``at`` is the bucket's first row."""
    n = len(side)
    if lo == hi:
        rows, columns = np.arange(n), np.arange(n)
    else:
        rows, columns = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
    step = max(1, most // max(1, len(columns)))
    for s in range(0, len(rows), step):
        a, b = np.repeat(rows[s : s + step], len(columns)), np.tile(columns, len(rows[s : s + step]))
        if lo == hi:
            keep = a < b
            a, b = a[keep], b[keep]
        yield a + at, b + at


def _part(salt: int, parts) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), "node"), parts).cast("int")


def _all_pairs(df: DataFrame) -> DataFrame:
    """Rows of groups of ``many`` blocks, once for each pair of blocks (lo, hi) that their own block (side) belongs to."""
    with_own = df.withColumn("side", _part(5, F.col("many"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    return with_own.withColumn("lo", F.least("side", "other")).withColumn("hi", F.greatest("side", "other")).withColumn("pivot", F.lit(-1)).drop("many", "other")


def _whole(df: DataFrame) -> DataFrame:
    """Rows of groups of one block."""
    return df.drop("many").withColumns({"side": F.lit(0), "lo": F.lit(0), "hi": F.lit(0), "pivot": F.lit(-1)})


def _spanning(hot: DataFrame, key: str, scan) -> DataFrame:
    """Star edges (u, v) that join what the links inside each group of (key, many, node, ...) join.

    ``scan`` gives (key, node, root, pivots): the least linked node inside what it was dealt, and a bit for each pivot of the same star.
    """
    hot = cut(hot)
    heads = hot.groupBy(key, _part(6, F.lit(PIVOTS)).alias("pivot")).agg(F.min("node").alias("node"))
    pivots = hot.join(heads, [key, "node"]).withColumn("side", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    members = hot.withColumn("side", _part(5, F.col("many"))).withColumn("pivot", F.lit(-1))
    blocks = members.unionByName(pivots).drop("many").withColumn("lo", F.col("side")).withColumn("hi", F.col("side"))
    first = cut(scan(blocks))
    bits = [F.sum(F.shiftright("pivots", k).bitwiseAND(1)) for k in range(PIVOTS)]
    best = first.groupBy(key).agg(F.array(*bits).alias("n"), F.count("*").alias("all")).select(key, F.expr("cast(array_position(n, array_max(n)) - 1 as int)").alias("best"))
    # the copies of a pivot in other blocks are the same node
    apart = first.join(best, key).groupBy(key, "node").agg(F.max(F.expr("shiftright(pivots, best) & 1")).alias("near"))
    rest = cut(apart.filter("near = 0").select(key, "node"))
    edges = first.select(F.col("node").alias("u"), F.col("root").alias("v"))
    if rest.isEmpty():
        return edges
    left = rest.groupBy(key).agg(F.count("*").alias("m"))
    rows = hot.join(left, key).join(rest.withColumn("far", F.lit(True)), [key, "node"], "left").withColumn("own", F.ceil(F.col("m") * F.col("many") / F.greatest("m", F.col("n"))).cast("int"))
    far = rows.filter("far").withColumn("side", _part(7, F.col("own")))
    among = far.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("own") + F.col("many") - 1)))
    main = rows.filter("far is null").withColumn("side", F.col("own") + _part(8, F.col("many"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("own") - 1)))
    met = among.unionByName(main).withColumn("lo", F.least("side", "other")).withColumn("hi", F.greatest("side", "other")).withColumn("pivot", F.lit(-1))
    second = cut(scan(met.drop("many", "m", "far", "own", "other")))
    return edges.unionByName(second.select(F.col("node").alias("u"), F.col("root").alias("v")))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Cut a stream that is sorted by its first ``keys`` columns after whole groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.num_rows - 1
        tail = [batch.column(k)[last] for k in range(keys)]
        cut = last
        columns = [batch.column(k).to_pylist() for k in range(keys)]
        tail = [c[last] for c in columns]
        while cut > 0 and all(c[cut - 1] == t for c, t in zip(columns, tail, strict=True)):
            cut -= 1
        if cut > 0 or (held and any(held[-1].column(k)[held[-1].num_rows - 1].as_py() != columns[k][0] for k in range(keys))):
            head = [*held, batch.slice(0, cut)] if cut else held
            if head:
                yield pa.Table.from_batches(head)
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _fixed(column: pa.ChunkedArray, width: int, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _starts(table: pa.Table, keys: int) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in range(keys):
        c = table.column(k).to_pylist()
        new[1:] |= np.fromiter((x != y for x, y in zip(c[1:], c[:-1], strict=True)), bool, len(c) - 1)
    return np.flatnonzero(new)


def _reached(pivot: np.ndarray, root: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each row of the groups that begin at ``starts`` the bits of the pivots in its star."""
    group = np.searchsorted(starts, np.arange(len(root)), "right") - 1
    out = np.zeros(len(root), np.int32)
    for at in np.flatnonzero(pivot >= 0).tolist():
        a = starts[group[at]]
        b = starts[group[at] + 1] if group[at] + 1 < len(starts) else len(root)
        out[a:b][root[a:b] == root[at]] |= 1 << int(pivot[at])
    return out


def _meetings(least: list[int], every: bool):
    """A scan of buckets: nodes whose pairs survive pruning; those without a link too, if ``every``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 3):
            sig, node = _fixed(table.column(6), VALUES, np.uint16), table.column(5).to_pylist()
            side, lo, hi, pivot = (table.column(k).to_numpy() for k in (3, 1, 2, 4))
            starts = _starts(table, 3)
            ends = np.append(starts[1:], table.num_rows)
            left, right = [], []

            def survive(a: np.ndarray, b: np.ndarray, sig=sig, left=left, right=right) -> None:
                kept = prune(sig, a, b, least)
                left.append(a[kept])
                right.append(b[kept])

            # small buckets together: the k-th next row, while it is of the same bucket
            own_end = np.repeat(ends, ends - starts)
            whole = np.repeat((ends - starts <= 32), ends - starts) & (lo == hi)
            index = np.arange(table.num_rows)
            for k in range(1, 32):
                a = index[whole & (index + k < own_end)]
                if not len(a):
                    break
                survive(a, a + k)
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                if e - s > 32 or lo[s] != hi[s]:
                    for a, b in _pairs(lo[s], hi[s], side[s:e], s):
                        survive(a, b)
            a, b = np.concatenate(left or [index[:0]]), np.concatenate(right or [index[:0]])
            root = local_roots(table.num_rows, a, b)
            given = index if every else np.flatnonzero(root != index)
            reached = _reached(pivot, root, starts)[given]
            yield pa.RecordBatch.from_arrays(
                [table.column(0).combine_chunks().take(pa.array(given)), pa.array([node[i] for i in given.tolist()], pa.binary()), pa.array([node[i] for i in root[given].tolist()], pa.binary()), pa.array(reached, pa.int32())], ["key", "node", "root", "pivots"]
            )

    return lambda met: met.select("key", "lo", "hi", "side", "pivot", "node", "sig").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node").mapInArrow(run, "key long, node binary, root binary, pivots int")


def candidate_edges(nodes: DataFrame, threshold: float, tolerance: float, block: int = BLOCK) -> DataFrame:
    """Star edges (u, v) between nodes whose pairs survive pruning in some band."""
    bands = nodes.select("node", F.explode("bands").alias("key"))
    counts = bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = bands.join(counts, "key").join(nodes.select("node", "sig"), "node").withColumn("many", F.ceil(F.col("n") / block).cast("int"))
    least = least_matches(threshold, tolerance)
    edges = _meetings(least, False)(_whole(met.filter(F.col("n") <= block))).select(F.col("node").alias("u"), F.col("root").alias("v"))
    if counts.filter(F.col("n") > block).isEmpty():
        return edges
    return edges.unionByName(_spanning(met.filter(F.col("n") > block), "key", _meetings(least, True)))


# ---------------------------------------------------------------- exact verification
def exact_links(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (a, b) of n-gram sets reach the threshold, by whole-set counts."""
    if not len(a):
        return np.zeros(0, bool)
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    used = np.unique(np.concatenate([a, b]))
    flat = np.concatenate([sets[i] for i in used])
    values, ids, df = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.cumsum(df > 1) - 1
    width = int((df > 1).sum())
    rows = np.unique(a)
    columns = np.unique(b)
    if len(rows) * len(columns) * width < 2e5 * len(a):
        owner = np.repeat(np.arange(len(used)), size[used])
        keep = df[ids] > 1
        owner, ids = owner[keep], shared[ids[keep]]
        local = np.full(len(sets), -1)
        local[used] = np.arange(len(used))
        common = np.zeros((len(rows), len(columns)), np.float32)
        order = np.argsort(ids, kind="stable")
        owner, ids = owner[order], ids[order]
        step = max(64, (1 << 22) // max(1, len(used)))
        for s in range(0, width, step):
            i, j = np.searchsorted(ids, [s, s + step])
            hit = np.zeros((len(used), min(step, width - s)), np.float32)
            hit[owner[i:j], ids[i:j] - s] = 1
            common += hit[local[rows]] @ hit[local[columns]].T
        both = common[np.searchsorted(rows, a), np.searchsorted(columns, b)].astype(np.int64)
    else:
        both = np.fromiter((len(np.intersect1d(sets[i], sets[j], True)) for i, j in zip(a.tolist(), b.tolist(), strict=True)), np.int64, len(a))
    return both + 1e-9 >= threshold * (size[a] + size[b] - both)


def verify(members: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(key, node, root, pivots, links): from rows (key, lo, hi, side, pivot, node, copies, sig, grams) a star edge and the links of each node."""
    least = least_matches(threshold, tolerance)
    dealt = members.select("key", "lo", "hi", "side", "pivot", "node", "copies", "sig", "grams").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 3):
            node = table.column(5).to_pylist()
            sig, copies = _fixed(table.column(7), VALUES, np.uint16), table.column(6).to_numpy()
            sets = [np.frombuffer(g, np.uint64) for g in table.column(8).to_pylist()]
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            side, lo, hi, pivot = (table.column(k).to_numpy() for k in (3, 1, 2, 4))
            starts = _starts(table, 3)
            links, root = np.zeros(len(node), np.int64), np.arange(len(node))
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(node)], strict=True):
                left, right = [], []
                for a, b in _pairs(lo[s], hi[s], side[s:e], s):
                    fits = np.minimum(size[a], size[b]) + 1e-9 >= threshold * np.maximum(size[a], size[b])
                    a, b = a[fits], b[fits]
                    kept = prune(sig, a, b, least)
                    a, b = a[kept] - s, b[kept] - s
                    good = exact_links(sets[s:e], a, b, threshold)
                    left.append(a[good])
                    right.append(b[good])
                a, b = np.concatenate(left or [root[:0]]), np.concatenate(right or [root[:0]])
                links[s:e] = np.bincount(a, copies[s + b], e - s) + np.bincount(b, copies[s + a], e - s)
                root[s:e] = local_roots(e - s, a, b) + s
            reached = _reached(pivot, root, starts)
            yield pa.RecordBatch.from_arrays([table.column(0).combine_chunks(), pa.array(node, pa.binary()), pa.array([node[r] for r in root.tolist()], pa.binary()), pa.array(reached, pa.int32()), pa.array(links, pa.int64())], ["key", "node", "root", "pivots", "links"])

    return dealt.mapInArrow(run, "key binary, node binary, root binary, pivots int, links long")


def _grams_of(df: DataFrame, text: str, size: int, keep: list[str]) -> DataFrame:
    """The n-gram sets of rows whose text has the key in ``node``."""
    schema = T.StructType([T.StructField("grams", T.BinaryType())])

    def make():
        def kernel(texts: pa.Array, nodes: pa.Array) -> list[pa.Array]:
            grams, offsets = shingle_sets(texts, size)
            sets = [grams[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            return [pa.array([g.tobytes() if len(g) and node_key(g) == n else None for g, n in zip(sets, nodes.to_pylist(), strict=True)], pa.binary())]

        return kernel

    return with_columns(df, text, schema, make, keep=keep, extra=["node"]).filter("grams is not null")


def _classes(df: DataFrame, text: str, doc_id: str, size: int, threshold: float, tolerance: float, block: int, links: bool) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of each row, and for each node its rep (least id), copies, root and, if asked for, links to other nodes' documents."""
    docs = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = cut(sketch(docs, "text", ["doc_id"], size))
    nodes = cut(rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("size", "sig", "bands")]))
    groups = cut(connected_components(candidate_edges(nodes, threshold, tolerance, block)).withColumnRenamed("root", "key").join(nodes.select("node", "rep", "copies", "size", "sig"), "node"))
    sizes = groups.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("grams"))
    blocks = sizes.select("key", "n", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("grams") * 8 / BLOCK_BYTES)).cast("int").alias("many"))
    members = cut(groups.join(blocks, "key").drop("size"))
    wanted = members.select("node", "rep")
    texts = docs.join(F.broadcast(wanted) if members.count() <= MOST_BROADCAST else wanted, docs["doc_id"].eqNullSafe(wanted["rep"])).select("node", "text")
    # a repeated row gives its set again: one of each node
    grams = _grams_of(texts, "text", size, ["node"]).groupBy("node").agg(F.first("grams").alias("grams"))
    dealt = members.drop("rep").join(grams, "node")
    scan = lambda part: verify(part, threshold, tolerance)
    large = members.filter("many > 1").select("node")
    if large.isEmpty():
        linked = cut(scan(_whole(dealt))).select("node", "root", "links")
    else:
        dealt = cut(dealt)
        # groups of one block are solved where they are verified; the larger ones by their star edges
        small, hot = cut(scan(_whole(dealt.filter("many = 1")))), dealt.filter("many > 1")
        if links:
            checked = cut(scan(_all_pairs(hot)))
            edges = checked.select(F.col("node").alias("u"), F.col("root").alias("v"))
            counted = checked.groupBy("node").agg(F.sum("links").alias("links"))
        else:
            edges, counted = _spanning(hot, "key", scan), large.withColumn("links", F.lit(0).cast("long"))
        joined = connected_components(edges)
        linked = small.select("node", "root", "links").unionByName(counted.join(joined, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "links"))
    known = nodes.select("node", "rep", "copies").join(linked, "node", "left").select("node", "rep", "copies", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    return rows.select("doc_id", "node"), known


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 5, threshold: float = 0.8, tolerance: float = 1e-6, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``df``: doc_id, node, root (of its class: unique, unlike ids), class_id (least id of its class), n_links (other documents at the threshold or above)."""
    rows, known = _classes(df, text, doc_id, size, threshold, tolerance, block, True)
    classes = known.groupBy("root").agg(F.min("rep").alias("class_id"))
    placed = known.join(classes, "root").select("node", "root", "class_id", (F.col("copies") - 1 + F.col("links")).alias("n_links"))
    return rows.join(placed, "node", "left").select(
        "doc_id", "node", "root", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def keep_one_of_each(df: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 5, threshold: float = 0.8, tolerance: float = 1e-6, block: int = BLOCK) -> DataFrame:
    """``df`` with the document of least id (then least node) of each class; rows without words all stay.

    A class is known by its root: classes without an id, or with the same least id, are classes of their own.
    Links are not counted, so that a large group is verified against pivots and no farther than its class is known.
    Of rows that repeat an id and a text the first by all columns stays.
    """
    _, known = _classes(df, text, doc_id, size, threshold, tolerance, block, False)
    # the least id is its node's rep; nulls come last
    chosen = known.groupBy("root").agg(F.min_by(F.struct("rep", "node"), F.struct(F.col("rep").isNull(), "rep", "node")).alias("k")).select(F.col("k.rep").alias("k"), F.col("k.node").alias("kn"))
    order, names = df.columns, {c: f"c{i}" for i, c in enumerate(df.columns)}
    inner = df.toDF(*names.values())
    own_id, own_text = names[doc_id], names[text]
    marked = sketch(inner, own_text, list(names.values()), size, minhash=False)
    none = marked.filter("node is null").drop("node")
    # repeated rows go before anything moves (a limit for each group in the window's own partitions), then the classes' others
    sortable = [F.xxhash64(f.name) for f in inner.schema.fields if "map<" not in f.dataType.simpleString()]
    first = marked.filter("node is not null").withColumn("r", F.row_number().over(Window.partitionBy(own_id, "node").orderBy(own_text, *sortable))).filter("r = 1")
    one = first.join(chosen, F.col(own_id).eqNullSafe(F.col("k")) & (F.col("node") == F.col("kn")), "left_semi")
    return one.select(*names.values()).unionByName(none.select(*names.values())).toDF(*order)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-word shingles at 0.8: every document with its class and its number of links."""
    return near_duplicates(table_path(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def brute_force(texts: dict[int, str | None], size: int = 5, threshold: float = 0.8) -> dict[int, tuple[int, int]]:
    """(class_id, n_links) of each id, by comparing all pairs."""
    import re

    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    ids, links, root = sorted(texts), dict.fromkeys(texts, 0), {i: i for i in texts}
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    return {i: (root[i], links[i]) for i in ids}


#: The same classes and numbers of links in DuckDB, from all pairs that share a shingle (ids are unique there).
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * k >= 4 * (x.n + y.n - k)),
reach AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT links.b AS doc_id, reach.root FROM reach JOIN links ON links.a = reach.doc_id AND reach.root < links.b),
cls AS (SELECT doc_id, min(root) AS class_id FROM reach GROUP BY doc_id),
deg AS (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links FROM cls LEFT JOIN deg USING (doc_id)
"""
