"""Bisecting k-means: the costliest (or heaviest) leaf is split in two until there are k leaves.

The tree lives on the driver; a leaf's rows are found by walking the tree inside the kernels, so
that the cached points are never rewritten.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.randomness import JavaRandom
from ..functions.vectors import PLANE, Geometry
from ..operators.assign import tree_label
from ..operators.sums import CellStats, cell_stats, ordered_sum
from ..sources.points import PointSet, matrix
from .kmeans import movement, too_small
from .models import TreeModel

SEED_ROWS = 256


@dataclass
class Node:
    centroid: np.ndarray
    count: float
    mass: float
    cost: float
    left: int = -1
    right: int = -1
    final: bool = False


class BisectingKMeans:
    def __init__(self, k: int, max_iter: int = 20, eps: float = 1e-4, seed: int = 42, geometry: Geometry = PLANE, trials: int = 1, select: str = "cost"):
        if k < 1 or trials < 1 or max_iter < 1:
            raise ValueError("k, trials and maxIter must be at least 1")
        if select not in ("cost", "size"):
            raise ValueError("select is 'cost' or 'size'")
        self.k, self.max_iter, self.eps, self.seed, self.geometry, self.trials, self.select = k, max_iter, eps, seed, geometry, trials, select

    def fit(self, points: PointSet) -> TreeModel:
        ready = points.with_features(self.geometry.prepare).df.select("rid", "features", "weight").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return self._grow(ready)
        finally:
            ready.unpersist()

    def _grow(self, df: DataFrame) -> TreeModel:
        d = df.select(F.size("features").alias("d")).first()
        if d is None:
            raise too_small(0, self.k)
        flat = ordered_sum(df, lambda x, w: np.concatenate([[len(x), w.sum()], w @ x]), d["d"] + 2)
        if flat[0] < self.k:
            raise too_small(int(flat[0]), self.k)
        centre = self.geometry.project(flat[2:] / flat[1]) if flat[1] > 0 else flat[2:] * 0
        nodes = [Node(centre, flat[0], flat[1], np.inf)]
        while sum(n.left < 0 for n in nodes) < self.k:
            open_ = [i for i, n in enumerate(nodes) if n.left < 0 and not n.final and n.count >= 2 and n.cost > 0]
            if not open_:
                break
            target = max(open_, key=lambda i: (nodes[i].cost if self.select == "cost" else nodes[i].mass, -i))
            split = self._split(df, nodes, target)
            if split is None:
                nodes[target].final = True
                continue
            centroids, stats = split
            nodes[target].left, nodes[target].right = len(nodes), len(nodes) + 1
            nodes += [Node(centroids[b], stats.count[b], stats.mass[b], stats.error[b]) for b in (0, 1)]
        return self._model(nodes)

    def _model(self, nodes: list[Node]) -> TreeModel:
        leaf, order, stack = [-1] * len(nodes), 0, [0]
        while stack:
            i = stack.pop()
            if nodes[i].left < 0:
                leaf[i], order = order, order + 1
            else:
                stack += [nodes[i].right, nodes[i].left]
        return TreeModel(np.array([n.centroid for n in nodes]), [n.left for n in nodes], [n.right for n in nodes], leaf, self.geometry.model)

    def _rows_of(self, df: DataFrame, nodes: list[Node], target: int) -> DataFrame:
        if len(nodes) == 1:
            return df
        own = [i if n.left < 0 else -1 for i, n in enumerate(nodes)]
        at = tree_label(F.col("features"), np.array([n.centroid for n in nodes]), [n.left for n in nodes], [n.right for n in nodes], own, self.geometry.fit)
        return df.filter(at == target)

    def _split(self, df: DataFrame, nodes: list[Node], target: int) -> tuple[np.ndarray, CellStats] | None:
        """The cheapest split of several trials into two non-empty branches; None if the rows are all alike."""
        rows, best = self._rows_of(df, nodes, target), None
        for trial in range(self.trials):
            table = rows.orderBy(F.xxhash64(F.lit(int(self.seed)), F.lit(target), F.lit(trial), "rid"), "rid").limit(SEED_ROWS).select("features").toArrow()
            sample = matrix(table.column(0))
            sample = sample[np.lexsort(sample.T[::-1])]
            if not len(sample):
                return best
            first = sample[0] if trial == 0 else sample[JavaRandom(self.seed + 31 * target + trial).next_int(len(sample))]
            apart = self.geometry.fit.pairwise(first[None, :], sample)[0]
            if not (apart > 0).any():
                return best
            centroids = np.array([first, sample[int(np.nanargmax(apart))]])
            for _ in range(self.max_iter):
                stats = cell_stats(rows, centroids, self.geometry.fit)
                new = stats.means(centroids, self.geometry.project)
                moved = movement(centroids, new, self.geometry.fit)
                centroids = new
                if moved < self.eps:
                    break
            stats = cell_stats(rows, centroids, self.geometry.fit)
            if (stats.count > 0).all() and (best is None or stats.error.sum() < best[1].error.sum()):
                best = centroids, stats
        return best
