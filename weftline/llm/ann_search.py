"""Approximate nearest neighbours by low-dimensional stable projections and a kd-tree.

Vectors are scaled to length one (the largest cosine is then the least distance) and projected on
``DIMS`` Gaussian directions. A Gaussian projection is stable: the squared projected distance over
the squared distance follows a chi-square law with ``DIMS`` degrees of freedom. Each block of rows
builds a kd-tree on its projections. A query first goes down to its own leaf, then walks the branches
whose boxes its present k-th neighbour leaves open, and verifies their leaves exactly in the order of
projected distance. It stops when the next leaf lies so far that a row
nearer than the present k-th would have projected closer with probability ``CONFIDENCE``, rounding
allowed for (``SLACK``). Equal directions of a block are indexed once, with as many of their least ids as
any query can need, so that large groups of copies neither hide each other nor cost a visit each.

All rows are indexed. A task builds the index of one block after another and carries each query's k
best on, so that later blocks stop earlier and a task answers once. Queries are compared in sets of a
checked size: nothing that is broadcast grows beyond ``QUERY_BYTES``, and of several sets each ends in
a written table before the next is gathered.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite parts take no part,
nor do rows of another length than most (the least of the most frequent lengths); rows with a null
id are no queries and no answers; repeated ids are rows of their own, but a query never meets rows
with its own id; ties go to the smaller id (scores are rounded once from extended precision, so that
equal and parallel vectors tie; of more than 2k rows of one block with one direction those of least id
stand for all); ids that are no whole numbers are taken as strings, in the order of their code points;
fewer candidates than k give all of them; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import cut, table_path

DIMS = 8
LEAF = 64
#: Leaves that are verified together at most; the stop is tried between such steps.
MOST_LEAVES = 32
K = 5
CONFIDENCE = 0.9
#: Rows of an index block, and bytes of one broadcast set of queries, at most.
BLOCK_ROWS = 20_000
#: Queries in one batch of a task's answers.
ANSWER_QUERIES = 4_096
#: Blocks that one task works through, one at a time.
TASK_BLOCKS = 16
QUERY_BYTES = 32 << 20
#: Rounding of squared projected distances and of cosines that the stop and the filter allow for.
SLACK = 1e-9


def chi_square_below(x: float, dims: int) -> float:
    """P(chi-square with ``dims`` (even) degrees of freedom <= x)."""
    half, term, total = x / 2, 1.0, 1.0
    for k in range(1, dims // 2):
        term *= half / k
        total += term
    return 1 - math.exp(-half) * total


def stopping_ratio(confidence: float = CONFIDENCE, dims: int = DIMS) -> float:
    """The quantile q: projected distance² > q * distance² has probability 1 - confidence."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_below(mid, dims) < confidence else (low, mid)
    return high


def projections(width: int, dims: int = DIMS, seed: int = 5) -> np.ndarray:
    return np.random.default_rng([seed, width]).standard_normal((width, dims))


class KdTree:
    """Rows split at the median of their widest direction down to leaves of at most ``leaf`` rows; every node knows its box."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.leaves: list[np.ndarray] = []
        axis, cut, below, low, high, number = [], [], [], [], [], []  # by node; below: the left child, the right one follows it
        waiting = [np.arange(len(points))] if len(points) else []
        for own in waiting:  # grows as it goes: nodes come level by level
            box = points[own]
            low.append(box.min(0))
            high.append(box.max(0))
            if len(own) <= leaf:
                axis.append(0)
                cut.append(0.0)
                below.append(-1)
                number.append(len(self.leaves))
                self.leaves.append(own)
                continue
            widest = int((high[-1] - low[-1]).argmax())
            order = np.argpartition(box[:, widest], len(own) // 2)
            axis.append(widest)
            cut.append(float(box[order[len(own) // 2], widest]))
            below.append(len(waiting))
            number.append(-1)
            waiting += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
        self.axis, self.cut, self.below, self.number = axis, cut, np.array(below, np.int64), np.array(number, np.int64)
        self.low, self.high = (np.array(x).reshape(-1, points.shape[1]) for x in (low, high))

    def home(self, point: np.ndarray) -> int:
        """The leaf at the end of the point's own way down."""
        node = 0
        while self.below[node] >= 0:
            node = int(self.below[node]) + int(point[self.axis[node]] >= self.cut[node])
        return int(self.number[node])

    def within(self, point: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """Leaves whose boxes lie within the squared distance, nearest first, and their distances; branches farther off are left."""
        found, far, nodes = [], [], np.zeros(min(1, len(self.below)), np.int64)
        while len(nodes):
            gap = np.maximum(0, np.maximum(self.low[nodes] - point, point - self.high[nodes]))
            distance = np.einsum("ij,ij->i", gap, gap)
            near = distance <= limit
            nodes, distance = nodes[near], distance[near]
            end = self.below[nodes] < 0
            found.append(self.number[nodes[end]])
            far.append(distance[end])
            nodes = (self.below[nodes[~end], None] + np.arange(2)).ravel()
        found, far = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found, far))
        order = np.argsort(far, kind="stable")
        return found[order], far[order]


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """The cosine of each row with the query: each row by itself, in extended precision, rounded once.

    So equal and parallel vectors have equal scores, whatever rows stand beside them.
    """
    v, q = vectors.astype(np.longdouble), query.astype(np.longdouble)
    return (np.add.reduce(v * q, axis=1) / np.sqrt(np.add.reduce(v * v, axis=1) * np.add.reduce(q * q))).astype(float)


class Block:
    """The index of one block of rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int = K):
        norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        self.projection = projections(vectors.shape[1])
        unit = vectors / norms[:, None] + 0.0  # -0.0 becomes 0.0
        _, first, group = np.unique(unit.view(np.dtype((np.void, unit.itemsize * unit.shape[1]))).ravel(), return_index=True, return_inverse=True)
        # the members that a query can need: an id k times at most, and k besides those of the query's own id
        rows = np.lexsort((ids, group))
        own, of = ids[rows], group[rows]
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (of[1:] != of[:-1])
        repeat = np.arange(len(own)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        rows = rows[repeat < k]
        of = group[rows]
        starts = np.searchsorted(of, np.arange(len(first)))
        rows = rows[np.arange(len(rows)) - starts[of] < 2 * k]
        projected = unit[first] @ self.projection
        self.tree = KdTree(projected)
        # distinct directions in leaf order: a leaf is a slice; the members of direction i are first[i]:first[i + 1]
        at = np.concatenate(self.tree.leaves)
        self.unit = unit[first[at]]
        place = np.empty(len(at), np.int64)
        place[at] = np.arange(len(at))
        rows = rows[np.lexsort((ids[rows], place[group[rows]]))]
        self.ids, self.vectors = ids[rows], vectors[rows]
        self.first = np.searchsorted(place[group[rows]], np.arange(len(at) + 1))
        self.ends = np.cumsum([0, *map(len, self.tree.leaves)])
        self.ratio = stopping_ratio()

    def search(self, query_id, query: np.ndarray, k: int = K, ids: np.ndarray | None = None, best: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines) of the k best verified rows, nearest first; those found in other blocks may be given."""
        ids, best = (self.ids[:0], np.zeros(0)) if ids is None else (ids, best)
        # a power of two brings the largest part near 1: neither squares nor products leave the range of doubles
        query = np.ldexp(query, -int(np.frexp(np.abs(query).max())[1]))
        unit = query / math.sqrt(float(query @ query))
        point = unit @ self.projection
        limit = lambda: self.ratio * max(2 - 2 * best[-1], 0) + SLACK if len(best) == k else math.inf
        seen = -1
        if limit() == math.inf:  # the leaf around the query first: the way down the tree needs a limit
            seen = self.tree.home(point)
            ids, best = self._verify(np.array([seen]), query_id, query, unit, k, ids, best)
        leaves, far = self.tree.within(point, limit())
        leaves, far = leaves[leaves != seen], far[leaves != seen]
        s, step = 0, 4
        while s < len(leaves) and far[s] <= limit():
            ids, best = self._verify(leaves[s : s + step], query_id, query, unit, k, ids, best)
            s, step = s + step, min(2 * step, MOST_LEAVES)
        return ids, best

    def _verify(self, leaves: np.ndarray, query_id, query: np.ndarray, unit: np.ndarray, k: int, ids: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best of those given and the leaves' rows, by the exact measure on the original vectors."""
        at = np.concatenate([np.arange(self.ends[i], self.ends[i + 1]) for i in leaves])
        near = self.unit[at] @ unit
        if len(best) == k:
            at, near = at[near >= best[-1] - SLACK], near[near >= best[-1] - SLACK]
        many = self.first[at + 1] - self.first[at]
        rows = np.repeat(self.first[at] - np.cumsum(many) + many, many) + np.arange(many.sum())
        other = self.ids[rows] != query_id
        rows, near = rows[other], np.repeat(near, many)[other]
        if len(rows) > k:  # rows that k others surely beat need no exact score
            rows = rows[near >= np.partition(near, -k)[-k] - SLACK]
        if not len(rows):
            return ids, best
        best, ids = np.concatenate([best, cosines(self.vectors[rows], query)]), np.concatenate([ids, self.ids[rows]])
        first = np.lexsort((ids, -best))[:k]
        return ids[first], best[first]


def usable(df: DataFrame, vector: str, vec_id: str) -> DataFrame:
    """(id, v): rows that can take part, as double vectors of the table's length."""
    v = F.col(f"`{vector}`").cast("array<double>")
    good = F.col(f"`{vec_id}`").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    whole = isinstance(df.select(F.col(f"`{vec_id}`")).schema[0].dataType, T.IntegralType)
    rows = df.select(F.col(f"`{vec_id}`").cast("long" if whole else "string").alias("id"), v.alias("v")).filter(good)
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.filter(F.size("v") == (width[0]["n"] if width else 0))


def nearest(df: DataFrame, queries: DataFrame, k: int = K, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of ``df`` for each row of ``queries`` (the same columns)."""
    rows, asked = usable(df, vector, vec_id), usable(queries, vector, vec_id)
    n_rows = rows.count()
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w")).first()
    sets = max(1, -(-(size["n"] * 8 * (size["w"] or 0)) // QUERY_BYTES))
    tasks = max(1, -(-n_rows // (BLOCK_ROWS * TASK_BLOCKS)), min(rows.sparkSession.sparkContext.defaultParallelism, -(-n_rows // 2_000)))
    dealt = rows.repartition(int(tasks))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    if sets == 1:
        return ranked(_search_set(dealt, asked, k)[0])
    dealt, asked, every = cut(dealt), cut(asked), None
    for part in range(sets):
        found, shared = _search_set(dealt, asked.filter(F.pmod(F.xxhash64(F.lit("set"), "id"), F.lit(sets)) == part), k)
        one = cut(ranked(found))
        shared.unpersist()
        every = one if every is None else every.unionByName(one)
    return every


def _search_set(rows: DataFrame, asked: DataFrame, k: int) -> tuple[DataFrame, Broadcast]:
    """(query_id, vec_id, score): for each task of ``rows`` the k best of each query, and the broadcast queries."""
    own = asked.toPandas()
    ids, kind = _ids(own["id"]), rows.schema["id"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast((ids, np.array(own["v"].tolist(), float) if len(ids) else np.zeros((0, 1))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = shared.value
        best: list[tuple] = [(None, None)] * len(query_ids)

        def meet(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            ids = _ids(table.column(0).to_pandas())
            vectors = table.column(1).combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            block = Block(ids, vectors, k)
            for i, (own_id, query) in enumerate(zip(query_ids.tolist(), queries, strict=True)):
                best[i] = block.search(own_id, query, k, *best[i])

        held, n = [], 0
        for batch in batches if len(query_ids) else ():
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                piece = batch.slice(at, BLOCK_ROWS)
                if n and n + piece.num_rows > BLOCK_ROWS:
                    meet(held)
                    held, n = [], 0
                held.append(piece)
                n += piece.num_rows
        if n:
            meet(held)
            for s in range(0, len(best), ANSWER_QUERIES):
                some = best[s : s + ANSWER_QUERIES]
                q = np.repeat(query_ids[s : s + ANSWER_QUERIES], [len(v) for v, _ in some])
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.concatenate([v for v, _ in some])), pa.array(np.concatenate([c for _, c in some]))], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(search, f"query_id {kind}, vec_id {kind}, score double"), shared


def _ids(column) -> np.ndarray:
    """Whole numbers, or strings of one width."""
    return column.to_numpy(np.int64) if column.dtype.kind in "iu" else np.array(column.tolist(), str)


def op10_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table_path(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.filter(F.col("vec_id") % 50 == 0))


def brute_force(ids: np.ndarray, vectors: np.ndarray, every: int = 50, k: int = K) -> dict[int, list[tuple[int, float]]]:
    """The exact answers."""
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = cosines(vectors, vectors[i])
        at = np.flatnonzero(ids != ids[i])
        first = at[np.lexsort((ids[at], -score[at]))[:k]]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in first]
    return out
