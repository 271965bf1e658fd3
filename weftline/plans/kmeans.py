"""k-means: Lloyd, spherical, breathing."""

from __future__ import annotations

import math

import numpy as np

from ..functions.randomness import JavaRandom
from ..functions.vectors import PLANE, Geometry, Metric
from ..operators.sums import CellStats, cell_stats
from ..sources.points import PointSet
from .models import PrototypeModel
from .rounds import Decision, run_rounds


def too_small(n: int, k: int) -> ValueError:
    return ValueError(f"Dataset too small: n={n} k={k}")


def initial_centroids(points: PointSet, k: int, seed: int) -> np.ndarray:
    """k different rows among the first max(30 k, 1000), picked at random; rows that are equal may both be picked."""
    _, x, _ = points.take_first(max(30 * k, 1000))
    if len(x) < k:
        raise too_small(len(x), k)
    rng, chosen = JavaRandom(seed), []
    while len(chosen) < k:
        i = rng.next_int(len(x))
        if i not in chosen:
            chosen.append(i)
    return x[chosen]


def movement(old: np.ndarray, new: np.ndarray, metric: Metric) -> float:
    """The largest distance between matching prototypes."""
    return max((float(metric.pairwise(a[None, :], b[None, :])[0, 0]) for a, b in zip(old, new, strict=True)), default=0.0)


class KMeans:
    def __init__(self, k: int, max_iter: int = 100, eps: float = 1e-4, seed: int = 42, geometry: Geometry = PLANE, initial: np.ndarray | None = None):
        if k < 1:
            raise ValueError("k must be at least 1")
        self.k, self.max_iter, self.eps, self.seed, self.geometry, self.initial = k, max_iter, eps, seed, geometry, initial

    def prepared(self, points: PointSet) -> PointSet:
        return points.with_features(self.geometry.prepare)

    def start(self, points: PointSet) -> np.ndarray:
        return np.asarray(self.initial, float) if self.initial is not None else initial_centroids(points, self.k, self.seed)

    def fit(self, points: PointSet) -> PrototypeModel:
        ready, fit_metric = self.prepared(points), self.geometry.fit

        def decide(epoch: int, centroids: np.ndarray, stats: CellStats) -> Decision:
            new = stats.means(centroids, self.geometry.project)
            return Decision(new, movement(centroids, new, fit_metric) < self.eps or epoch >= self.max_iter - 1)

        found = run_rounds(ready, self.start(ready), lambda df, c: cell_stats(df, c, fit_metric), decide)
        return PrototypeModel(found, self.geometry.model)


def removal_order(utility: np.ndarray) -> list[int]:
    return sorted(range(len(utility)), key=lambda i: (utility[i], i))


def split_targets(error: np.ndarray, m: int) -> list[int]:
    """The m prototypes of largest error, ties to the lower number."""
    return sorted(range(len(error)), key=lambda i: (-error[i], i))[:m]


def choose_removals(centroids: np.ndarray, utility: np.ndarray, n_remove: int, metric: Metric) -> set[int]:
    """Least useful prototypes; each removal shields the nearest other one while enough would be left, then the gaps are filled."""
    order = removal_order(utility)
    apart = metric.pairwise(centroids, centroids)
    np.fill_diagonal(apart, np.inf)
    out: set[int] = set()
    shielded: set[int] = set()
    for i in order:
        if len(out) == n_remove:
            break
        if i in shielded:
            continue
        out.add(i)
        if len(shielded) + n_remove < len(centroids) and np.isfinite(apart[i]).any():
            shielded.add(int(apart[i].argmin()))
    out.update([i for i in order if i not in out][: n_remove - len(out)])
    return out


class BreathingKMeans(KMeans):
    """Lloyd, then cycles of inserting m prototypes where the error is largest and removing m that are least useful.

    m shrinks after each cycle that does not improve; the best set seen is the result.
    """

    JITTER = 0.01

    def __init__(self, k: int, max_iter: int = 100, eps: float = 1e-4, seed: int = 42, geometry: Geometry = PLANE, m0: int = 5, max_cycles: int = 100, initial: np.ndarray | None = None):
        super().__init__(k, max_iter, eps, seed, geometry, initial)
        if m0 < 1:
            raise ValueError("m0 must be at least 1")
        self.m0, self.max_cycles = m0, max_cycles

    def fit(self, points: PointSet) -> PrototypeModel:
        ready = self.prepared(points)
        plan = self._steps(self.start(ready))
        first = next(plan)

        def decide(epoch: int, centroids: np.ndarray, stats: CellStats) -> Decision:
            try:
                return Decision(plan.send(stats))
            except StopIteration as done:
                return Decision(done.value, True)

        found = run_rounds(ready, first, lambda df, c: cell_stats(df, c, self.geometry.fit), decide)
        return PrototypeModel(found, self.geometry.model)

    def _lloyd(self, centroids: np.ndarray):
        """Yields prototypes to measure and takes their sums; returns the settled prototypes."""
        for _ in range(self.max_iter):
            stats = yield centroids
            new = stats.means(centroids, self.geometry.project)
            moved = movement(centroids, new, self.geometry.fit)
            centroids = new
            if moved < self.eps:
                break
        return centroids

    def _steps(self, centroids: np.ndarray):
        """The whole search, as a generator of prototypes to measure."""
        rng, m = JavaRandom(self.seed), self.m0
        best = yield from self._lloyd(centroids)
        stats = yield best
        least = float(stats.error.sum())
        for _ in range(self.max_cycles):
            mass = float(stats.mass.sum())
            scale = self.JITTER * (math.sqrt(stats.error.sum() / mass) if mass > 0 else 0.0)
            clones = [self.geometry.project(np.array([x + scale * (rng.next_double() - 0.5) for x in best[i]])) for i in split_targets(stats.error, min(m, len(best)))]
            grown = yield from self._lloyd(np.vstack([best, *clones]))
            measured = yield grown
            gone = choose_removals(grown, measured.utility, len(grown) - self.k, self.geometry.fit)
            shrunk = yield from self._lloyd(np.array([c for i, c in enumerate(grown) if i not in gone]))
            again = yield shrunk
            error = float(again.error.sum())
            if error < least:
                best, least, stats = shrunk, error, again
                continue
            m -= 1
            if m <= 0:
                break
        return best
