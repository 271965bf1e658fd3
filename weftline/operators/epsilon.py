"""Range joins: weighted counts within a radius, the edges of a radius graph, its components."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import Metric, all_finite
from ..sources.points import matrix, written
from .assign import Windows
from .grid import MOST_CELLS, Grid
from .sums import ordered_sum

#: Candidates that one pass answers at most.
MOST_CANDIDATES = 100_000
#: Edges in one row of a task's answer.
EDGES_A_ROW = 1 << 16
#: Edges that are solved on the driver at most; larger graphs stay in tables.
DRIVER_EDGES = 1 << 20


class UnionFind:
    """Components whose root is the least member; numbers follow the order of least members."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def numbers(self) -> np.ndarray:
        roots = [self.find(i) for i in range(len(self.parent))]
        order = {r: k for k, r in enumerate(sorted(set(roots)))}
        return np.array([order[r] for r in roots], int)


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each component (``root``) after the pairs (a, b) are joined."""
    root = root.copy()
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, after := root[root]):
            root = after


def mass_within(points: DataFrame, candidates: np.ndarray, radius: float, metric: Metric, chunk: int = MOST_CANDIDATES) -> np.ndarray:
    """Weight of all points within the radius of each candidate (itself included), by chunks of candidates."""
    out = np.zeros(len(candidates))
    step = max(1, min(chunk, len(candidates), MOST_CANDIDATES))
    for s in range(0, len(candidates), step):
        own = Windows(candidates[s : s + step], radius, metric)
        shared = points.sparkSession.sparkContext.broadcast(own)

        def compute(x: np.ndarray, w: np.ndarray, shared=shared) -> np.ndarray:
            total = np.zeros(len(shared.value.points))
            for rows, window in shared.value.meet(x):
                total[window] += w[rows] @ metric.within_pairs(x[rows], shared.value.points[window], radius)
            return total

        out[s + own.order] = ordered_sum(points, compute, len(own.order))
        shared.unpersist()
    return out


def mass_within_table(points: DataFrame, candidates: DataFrame, radius: float, metric: Metric) -> DataFrame:
    """(cid, mass) as a join on the radius condition; candidates without a point in reach have mass 0.

    On cells where they fit; there points of one place are one row, and so are the candidates.
    """
    c = candidates.select(F.col("rid").alias("cid"), F.col("features").alias("c"))
    if cells := fitting(points.select("features").unionAll(candidates.select("features")), radius, metric):
        near = place_mass(cells, points, candidates)
        # a place that is not finite has no cell; equal arrays join whatever the sign of their zeros
        return c.join(near.hint("merge"), F.col("c") == F.col("features"), "left").select("cid", F.coalesce("mass", F.lit(0.0)).alias("mass"))
    near = points.join(c, metric.within(F.col("features"), F.col("c"), radius)).groupBy("cid").agg(F.sum("weight").alias("mass"))
    return c.select("cid").join(near, "cid", "left").select("cid", F.coalesce("mass", F.lit(0.0)).alias("mass"))


def fitting(points: DataFrame, radius: float, metric: Metric) -> Grid | None:
    """A grid for the radius: a norm, few dimensions, and finite coordinates that leave cells whole numbers."""
    first = points.select(F.size("features").alias("d")).first()
    if first is None or not radius > 0 or not Grid.fits(metric, first["d"]):
        return None
    cells = Grid(radius, metric, first["d"])
    largest = points.filter(all_finite(F.col("features"))).agg(F.max(F.array_max(F.transform("features", F.abs)))).first()[0]
    return cells if largest is None or largest / cells.side <= MOST_CELLS else None


def place_mass(cells: Grid, points: DataFrame, candidates: DataFrame) -> DataFrame:
    """(features, mass): the weight of ``points`` within the radius of each place of the candidates that has some."""
    held = written(cells.place(points.groupBy("features").agg(F.sum("weight").alias("weight"))).withColumnRenamed("features", "y"))
    asked = written(cells.place(candidates.select("features").distinct()))
    met = asked.select("features", cells.around("cell", cells.offsets()).alias("cell")).hint("merge").join(held, "cell")
    return met.filter(cells.within("features", "y")).groupBy("features").agg(F.sum("weight").alias("mass"))


def grid_pairs(points: DataFrame, radius: float, metric: Metric) -> DataFrame:
    """Pairs (a, b), a < b, within the radius, by an equi-join on grid cells of that side.

    For norms in up to three dimensions: a point's partners lie in its own cell or a neighbour of it. Each
    pair of neighbours meets once, in the cell that comes later; nothing is broadcast, however small its file.
    """
    first = points.select(F.size("features").alias("d")).first()
    d = first["d"] if first else 1
    if metric.name not in ("euclidean", "manhattan") or d > 3:
        raise ValueError("grid cells need a norm and at most three dimensions")
    points, test = points.filter(all_finite(F.col("features"))), Grid(radius, metric, d)
    cell = F.transform("features", lambda x: F.floor(x / radius))
    own = points.select(F.col("rid").alias("a"), F.col("features").alias("x"), cell.alias("cell"))
    shifts = [s for s in itertools.product((0, 1, -1), repeat=d) if s >= (0,) * d]
    steps = F.array(*[F.struct(F.lit(any(s)).alias("ahead"), F.array(*[F.lit(k).cast("long") for k in s]).alias("step")) for s in shifts])
    around = F.explode(F.transform(steps, lambda s: F.struct(s["ahead"].alias("ahead"), F.zip_with(cell, s["step"], lambda c, k: c + k).alias("cell"))))
    other = points.select(F.col("rid").alias("b"), F.col("features").alias("y"), around.alias("to")).select("b", "y", "to.ahead", "to.cell")
    met = own.hint("merge").join(other, "cell").filter((F.col("ahead") | (F.col("a") < F.col("b"))) & test.within("x", "y"))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def core_components(spark, cores: np.ndarray, radius: float, metric: Metric) -> np.ndarray:
    """Component of each core in the graph of pairs within the radius, numbered by their first cores.

    Tasks meet slices of the sorted cores with what lies within their reach ahead, and send the edges of
    a spanning forest of what they saw, so that the driver receives less than one edge a core and task.
    """
    n = len(cores)
    root = np.arange(n)
    own = Windows(cores, radius, metric)
    if n > 1:
        shared = spark.sparkContext.broadcast(own)
        tasks = max(1, min(n, spark.sparkContext.defaultParallelism * 2))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, local = shared.value, np.arange(n)
            for batch in batches:
                t = batch.column(0).to_numpy()
                # without windows a row meets all that follow it: far and near rows by turns
                rows = t if own.axis is not None else np.where(t % 2 == 0, t // 2, n - 1 - t // 2)
                for at, window in own.meet(own.points[rows]):
                    i, j = np.nonzero(metric.within_pairs(own.points[rows[at]], own.points[window], radius))
                    i, j = rows[at][i], j + window.start
                    local = joined(local, i[i < j], j[i < j])
            linked = np.flatnonzero(local != np.arange(n))
            for s in range(0, len(linked), EDGES_A_ROW):
                piece = linked[s : s + EDGES_A_ROW]
                yield pa.RecordBatch.from_arrays([pa.array([piece.tobytes()], pa.binary()), pa.array([local[piece].tobytes()], pa.binary())], ["a", "b"])

        for row in spark.range(0, n, 1, tasks).mapInArrow(scan, "a binary, b binary").toLocalIterator():
            root = joined(root, np.frombuffer(row["a"], np.int64), np.frombuffer(row["b"], np.int64))
        shared.unpersist()
    least = np.full(n, n)
    np.minimum.at(least, root, own.order)
    first = np.empty(n, np.int64)
    first[own.order] = least[root]
    return np.unique(first, return_inverse=True)[1]


def chunk_edges(cores: DataFrame, chunk: tuple[np.ndarray, np.ndarray], radius: float, metric: Metric) -> DataFrame:
    """(a, b): edges that join what the chunk's cores (ids, rows), a bounded number of them, join among all ``cores`` (rid, features)."""
    shared = cores.sparkSession.sparkContext.broadcast((chunk[0], Windows(chunk[1], radius, metric)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, own = shared.value
        ids, local = ids[own.order], np.arange(len(ids))
        for batch in batches:
            x, rid = matrix(batch.column(1)), batch.column(0).to_numpy()
            for rows, window in own.meet(x):
                i, j = np.nonzero(metric.within_pairs(x[rows], own.points[window], radius))
                first = np.searchsorted(i, np.arange(len(rows)))
                hit = np.flatnonzero(np.append(first[1:], len(i)) > first)
                j = j + window.start
                # a row's partners are joined with its first one, the row itself with that one
                local = joined(local, j, j[first[i]])
                yield pa.RecordBatch.from_arrays([pa.array(rid[rows[hit]]), pa.array(ids[j[first[hit]]])], ["a", "b"])
        linked = np.flatnonzero(local != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[local[linked]])], ["a", "b"])

    return cores.select("rid", "features").mapInArrow(scan, "a long, b long").filter("a <> b")


def components_table(nodes: DataFrame, edges: DataFrame, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(rid, component): the least id that each node reaches.

    Up to ``driver_edges`` edges are solved at once, and their nodes come back as a table to join; more
    of them go through rounds of grouped minima that end in written tables.
    """
    once = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    if once.count() <= driver_edges:
        held = once.toArrow()
        ids, at = np.unique(np.concatenate([held.column(k).to_numpy().astype(np.int64) for k in (0, 1)]), return_inverse=True)
        root = ids[joined(np.arange(len(ids)), *np.split(at, 2))]
        solved = nodes.sparkSession.createDataFrame(pa.table({"rid": ids, "least": root}))
        return nodes.select("rid").join(solved, "rid", "left").select("rid", F.coalesce("least", "rid").alias("component"))
    both = written(once.union(once.select("b", "a")))
    now = written(nodes.select("rid", F.col("rid").alias("component")))
    while True:
        near = both.join(now.withColumnRenamed("rid", "b"), "b").groupBy("a").agg(F.min("component").alias("low"))
        stepped = now.join(near, now["rid"] == near["a"], "left").select("rid", "component", F.least("component", F.coalesce("low", "component")).alias("new"))
        # follow the new component's own component: halves the way
        jump = stepped.select(F.col("rid").alias("new"), F.col("new").alias("far"))
        after = written(stepped.join(jump, "new").select("rid", F.col("component").alias("old"), F.least("new", "far").alias("component")))
        if after.filter("old <> component").isEmpty():
            return after.select("rid", "component")
        now = after.select("rid", "component")
