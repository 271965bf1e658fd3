"""k-medoids: FastPAM and FasterPAM on a matrix or in ranges of candidates, FastPAM over the cluster, CLARA and PAMAE.

The objective is Σ w·d to the nearest medoid. Candidates are rows; ties go to the lower row, and a
swap must lower the objective.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..functions import randomness
from ..functions.vectors import EUCLIDEAN, Metric
from ..operators.assign import row_blocks
from ..operators.sampling import draw_samples
from ..operators.sums import ordered_sum
from ..sources.points import PointSet
from .kmeans import too_small
from .models import PrototypeModel

#: Bytes of candidates that are gathered and broadcast at most.
CANDIDATE_BYTES = 1 << 30
#: Points that a driver-side distance matrix holds at most (128 MB); beyond, tasks measure ranges of candidates.
LOCAL_POINTS = 4_000
#: Distances that the driver measures itself, where a job would cost more.
DRIVER_DISTANCES = 20_000_000
#: Points and candidates of one block in a task.
SPREAD_BLOCK = (4096, 64)


# ---------------------------------------------------------------- on one matrix
def build(d: np.ndarray, w: np.ndarray, k: int) -> list[int]:
    """Greedy start: the row of least total distance, then rows of the largest gain."""
    chosen: list[int] = []
    near = None
    for _ in range(k):
        gain = -(w @ d) if near is None else w @ np.maximum(near[:, None] - d, 0)
        gain[chosen] = -np.inf
        best = int(gain.argmax())
        chosen.append(best)
        near = d[:, best].copy() if near is None else np.minimum(near, d[:, best])
    return chosen


class Nearest:
    """Nearest and second nearest medoid slot of every row, with exact updates after a swap."""

    def __init__(self, d: np.ndarray, medoids: list[int]):
        self.d, self.medoids = d, list(medoids)
        self.slot = np.zeros(len(d), int)
        self.second_slot = np.zeros(len(d), int)
        self.first, self.second = np.zeros(len(d)), np.zeros(len(d))
        self.rescan(np.arange(len(d)))

    def rescan(self, rows: np.ndarray) -> None:
        own = self.d[np.ix_(rows, self.medoids)].copy()
        every = np.arange(len(rows))
        self.slot[rows] = own.argmin(1)
        self.first[rows] = own[every, self.slot[rows]]
        own[every, self.slot[rows]] = np.inf
        self.second_slot[rows] = own.argmin(1) if own.shape[1] > 1 else -1
        self.second[rows] = own.min(1) if own.shape[1] > 1 else np.finfo(float).max

    def swap(self, slot: int, candidate: int) -> None:
        self.medoids[slot] = candidate
        new = self.d[:, candidate]
        lost = (self.slot == slot) | (self.second_slot == slot)
        # rows that keep both: the new medoid may come before either; equal distances go to the lower slot
        first = ~lost & ((new < self.first) | ((new == self.first) & (slot < self.slot)))
        second = ~lost & ~first & ((new < self.second) | ((new == self.second) & (slot < self.second_slot)))
        self.second[first], self.second_slot[first] = self.first[first], self.slot[first]
        self.first[first], self.slot[first] = new[first], slot
        self.second[second], self.second_slot[second] = new[second], slot
        if lost.any():
            self.rescan(np.flatnonzero(lost))

    def cost(self, w: np.ndarray) -> float:
        return float(w @ self.first)


def swap_deltas(d: np.ndarray, w: np.ndarray, near: Nearest, candidates: np.ndarray) -> np.ndarray:
    """Change of the objective for each (slot, candidate), in one pass with the gain shared by all slots."""
    k = len(near.medoids)
    dc = d[:, candidates]
    shared = np.minimum(dc - near.first[:, None], 0) * w[:, None]
    own = w[:, None] * (np.minimum(near.second[:, None], dc) - near.first[:, None]) - shared
    out = np.zeros((k, len(candidates)))
    for s in range(k):
        out[s] = own[near.slot == s].sum(0)
    return out + shared.sum(0)[None, :]


def best_swap(deltas: np.ndarray) -> tuple[int, int, float]:
    """(slot, candidate position, change): least change, then slot, then candidate."""
    at = int(deltas.argmin())
    return at // deltas.shape[1], at % deltas.shape[1], float(deltas.ravel()[at])


def fastpam(d: np.ndarray, w: np.ndarray, k: int, max_iter: int = 100) -> Nearest:
    near = Nearest(d, build(d, w, k))
    for _ in range(max_iter):
        candidates = np.setdiff1d(np.arange(len(d)), near.medoids)
        if not len(candidates):
            break
        pieces = [swap_deltas(d, w, near, candidates[s]) for s in row_blocks(len(candidates), len(d))]
        slot, at, change = best_swap(np.hstack(pieces))
        if not change < 0:
            break
        near.swap(slot, int(candidates[at]))
    return near


def fasterpam(d: np.ndarray, w: np.ndarray, k: int, max_iter: int = 100, seed: int = 42) -> Nearest:
    """Every improving swap is made at once, candidates in one seeded order, until a whole pass improves nothing."""
    near, order = Nearest(d, build(d, w, k)), randomness.permutation(len(d), seed)
    for _ in range(max_iter):
        improved = False
        for c in order:
            if c in near.medoids:
                continue
            slot, _, change = best_swap(swap_deltas(d, w, near, np.array([c])))
            if change < 0:
                near.swap(slot, c)
                improved = True
        if not improved:
            break
    return near


INNER = {"fastpam": lambda d, w, k, max_iter, seed: fastpam(d, w, k, max_iter), "fasterpam": fasterpam}


# ---------------------------------------------------------------- without a matrix
class Spread:
    """The same searches on collected points without their matrix: tasks sum over all points for ranges of candidates.

    Rows of one place are one candidate, its least row, so that copies tie exactly. Each sum is made in
    one task in a fixed order: the same bits on every run.
    """

    def __init__(self, spark: SparkSession, x: np.ndarray, w: np.ndarray, metric: Metric):
        _, first, at = np.unique(x, axis=0, return_index=True, return_inverse=True)
        order = np.argsort(first)
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        #: place of each row, least row of each place
        self.place, self.row = number[at.ravel()], first[order]
        self.spark, self.n, self.metric = spark, len(x), metric
        self.x, self.w = x[self.row], np.bincount(self.place, w, len(order))
        self.shared = spark.sparkContext.broadcast((self.x, self.w))

    def sums(self, state: tuple[np.ndarray, ...], own: np.ndarray, width: int) -> np.ndarray:
        """(width, len(own)): ``_spread_sums`` of the places ``own``, by the driver or in tasks."""
        if len(own) * len(self.x) <= DRIVER_DISTANCES:
            return _spread_sums(self.x, self.w, state, own, self.metric)
        points, metric, told = self.shared, self.metric, self.spark.sparkContext.broadcast((state, own))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (x, w), (state, own) = points.value, told.value
            for batch in batches:
                made = _spread_sums(x, w, state, own[batch.column(0).to_numpy()], metric)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(made.T.ravel()), width).cast(pa.list_(pa.float64()))], ["i", "v"])

        tasks = max(1, min(len(own), self.spark.sparkContext.defaultParallelism * 4))
        table = self.spark.range(0, len(own), 1, tasks).mapInArrow(scan, "i long, v array<double>").toArrow().combine_chunks()
        out = np.empty((len(own), width))
        if table.num_rows:
            out[table.column("i").to_numpy()] = table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, width)
        told.destroy()
        return out.T

    def build(self, k: int) -> list[int]:
        """As ``build``: rows; without a gain, the least row that is left."""
        chosen: list[int] = []
        near = None
        for _ in range(k):
            gain = self.sums(() if near is None else (near,), np.arange(len(self.x)), 1)[0]
            taken = self.place[chosen]
            if near is not None:
                gain[taken] = 0.0
            best = int(gain.argmax())
            if near is not None and not gain[best] > 0:
                chosen.append(next(r for r in range(self.n) if r not in chosen))
            else:
                chosen.append(int(self.row[best]))
            d = self.metric.pairwise(self.x, self.x[self.place[chosen[-1:]]])[:, 0]
            near = d if near is None else np.minimum(near, d)
        return chosen

    def deltas(self, medoids: list[int], own: np.ndarray) -> np.ndarray:
        """Change of the objective for each (slot, place of ``own``)."""
        to = self.metric.pairwise(self.x, self.x[self.place[medoids]])
        every, slot = np.arange(len(to)), to.argmin(1)
        first = to[every, slot]
        to[every, slot] = np.inf
        second = to.min(1) if len(medoids) > 1 else np.full(len(to), np.finfo(float).max)
        return self.sums((first, second, slot, np.arange(len(medoids))), own, len(medoids))

    def fastpam(self, k: int, max_iter: int = 100, seed: int = 42) -> list[int]:
        medoids = self.build(k)
        for _ in range(max_iter):
            # a copy of a medoid lowers nothing
            own = np.setdiff1d(np.arange(len(self.x)), self.place[medoids])
            if not len(own):
                break
            slot, at, change = best_swap(self.deltas(medoids, own))
            if not change < 0:
                break
            medoids[slot] = int(self.row[own[at]])
        return medoids

    def fasterpam(self, k: int, max_iter: int = 100, seed: int = 42) -> list[int]:
        """Candidates are measured ahead in growing blocks; what follows a swap is measured anew."""
        medoids, order = self.build(k), np.array(randomness.permutation(self.n, seed))
        for _ in range(max_iter):
            improved, at, ahead = False, 0, 32
            while at < self.n:
                rows = order[at : at + ahead]
                own, back = np.unique(self.place[rows], return_inverse=True)
                deltas = self.deltas(medoids, own)
                deltas[:, np.isin(own, self.place[medoids])] = 0.0
                better = np.flatnonzero(deltas.min(0)[back] < 0)
                if len(better):
                    medoids[int(deltas[:, back[better[0]]].argmin())] = int(rows[better[0]])
                    improved, at, ahead = True, at + int(better[0]) + 1, 32
                else:
                    at, ahead = at + len(rows), ahead * 4
            if not improved:
                break
        return medoids

    def close(self) -> None:
        self.shared.destroy()


def _spread_sums(x: np.ndarray, w: np.ndarray, state: tuple[np.ndarray, ...], own: np.ndarray, metric: Metric) -> np.ndarray:
    """For each candidate of ``own``: minus its total distance (no state), its gain (near), or its change by slot."""
    out = np.zeros((max(1, len(state[3])) if len(state) > 1 else 1, len(own)))
    for c in range(0, len(own), SPREAD_BLOCK[1]):
        to = slice(c, c + SPREAD_BLOCK[1])
        for s in range(0, len(x), SPREAD_BLOCK[0]):
            at = slice(s, s + SPREAD_BLOCK[0])
            d = metric.pairwise(x[at], x[own[to]])
            if not state:
                out[0, to] -= w[at] @ d
            elif len(state) == 1:
                out[0, to] += w[at] @ np.maximum(state[0][at, None] - d, 0)
            else:
                first, second, slot, slots = state
                d -= first[at, None]
                gain = np.minimum(d, 0)
                np.minimum(d, (second[at] - first[at])[:, None], out=d)
                d -= gain
                out[:, to] += w[at] @ gain + (np.where(slot[at] == slots[:, None], w[at], 0.0) @ d)
    return out


def solve(spark: SparkSession, x: np.ndarray, w: np.ndarray, metric: Metric, k: int, max_iter: int, seed: int, solver: str) -> list[int]:
    """The medoids' rows, by a matrix where it is small enough."""
    if len(x) <= LOCAL_POINTS:
        return INNER[solver](metric.pairwise(x, x), w, k, max_iter, seed).medoids
    spread = Spread(spark, x, w, metric)
    try:
        return getattr(spread, solver)(k, max_iter, seed)
    finally:
        spread.close()


class LocalMedoids:
    """FastPAM or FasterPAM on all points, collected to the driver."""

    def __init__(self, k: int, metric: Metric = EUCLIDEAN, max_iter: int = 100, seed: int = 42, solver: str = "fastpam"):
        self.k, self.metric, self.max_iter, self.seed, self.solver = k, metric, max_iter, seed, solver

    def fit(self, points: PointSet) -> PrototypeModel:
        n = points.count()
        if n < self.k:
            raise too_small(n, self.k)
        if 8 * n * (points.dimension() or 0) > CANDIDATE_BYTES:
            raise ValueError(f"{self.solver} makes all {n} points candidates: more than {CANDIDATE_BYTES} bytes; use clara or pamae")
        _, x, w = points.collect()
        return PrototypeModel(x[solve(points.df.sparkSession, x, w, self.metric, self.k, self.max_iter, self.seed, self.solver)], self.metric)


# ---------------------------------------------------------------- over the cluster
def _objective_sums(df: DataFrame, candidates: np.ndarray, medoids: np.ndarray, metric: Metric, mode: str) -> np.ndarray:
    """build: gain of each candidate (first one: minus the total distance); swap: changes (slot x candidate)."""
    k, m = len(medoids), len(candidates)
    shared = df.sparkSession.sparkContext.broadcast((candidates, medoids))

    def compute(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        own, chosen = shared.value
        out = np.zeros((max(1, k) if mode == "swap" else 1, m))
        for s in row_blocks(len(x), m):
            d = metric.pairwise(x[s], own)
            if mode == "build":
                out[0] += -(w[s] @ d) if not k else w[s] @ np.maximum(metric.pairwise(x[s], chosen).min(1)[:, None] - d, 0)
                continue
            to = metric.pairwise(x[s], chosen)
            slot = to.argmin(1)
            first = to[np.arange(len(to)), slot]
            to[np.arange(len(to)), slot] = np.inf
            second = to.min(1) if k > 1 else np.full(len(to), np.finfo(float).max)
            gain = np.minimum(d - first[:, None], 0) * w[s][:, None]
            loss = w[s][:, None] * (np.minimum(second[:, None], d) - first[:, None]) - gain
            for j in range(k):
                out[j] += loss[slot == j].sum(0)
            out += gain.sum(0)[None, :]
        return out.ravel()

    flat = ordered_sum(df, compute, (k if mode == "swap" else 1) * m)
    shared.unpersist()
    return flat.reshape(-1, m)


class DistributedFastPAM:
    """FastPAM with every point a candidate: one job gathers candidates, then a job for each BUILD and SWAP round."""

    def __init__(self, k: int, metric: Metric = EUCLIDEAN, max_iter: int = 100):
        self.k, self.metric, self.max_iter = k, metric, max_iter

    def fit(self, points: PointSet) -> PrototypeModel:
        df = points.df.select("rid", "features", "weight").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            n, d = df.count(), PointSet(df).dimension() or 0
            if n < self.k:
                raise too_small(n, self.k)
            if 8 * n * d > CANDIDATE_BYTES:
                raise ValueError(f"distfastpam makes all {n} points candidates: more than {CANDIDATE_BYTES} bytes; use clara or pamae")
            _, x, _ = PointSet(df).collect()
            medoids: list[int] = []
            for _ in range(self.k):
                gain = _objective_sums(df, x, x[medoids], self.metric, "build")[0]
                gain[medoids] = -np.inf
                medoids.append(int(gain.argmax()))
            for _ in range(self.max_iter):
                deltas = _objective_sums(df, x, x[medoids], self.metric, "swap")
                deltas[:, medoids] = np.inf
                slot, c, change = best_swap(deltas)
                if not change < 0:
                    break
                medoids[slot] = c
            return PrototypeModel(x[medoids], self.metric)
        finally:
            df.unpersist()


def set_costs(df: DataFrame, sets: list[np.ndarray], metric: Metric) -> np.ndarray:
    """Σ w·min d of each set of prototypes over all points, in one pass; equal prototypes are measured once."""
    unique, inverse = np.unique(np.vstack(sets), axis=0, return_inverse=True)
    inverse = inverse.ravel()
    bounds = np.cumsum([0, *map(len, sets)])
    shared = df.sparkSession.sparkContext.broadcast(unique)

    def compute(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(sets))
        for s in row_blocks(len(x), len(unique)):
            d = metric.pairwise(x[s], shared.value)
            for j in range(len(sets)):
                out[j] += w[s] @ d[:, inverse[bounds[j] : bounds[j + 1]]].min(1)
        return out

    return ordered_sum(df, compute, len(sets))


@dataclass
class Seeded:
    medoids: np.ndarray
    cost: float
    pool: np.ndarray | None


class Clara:
    """PAM on several samples of one pass; the set of least cost over all points wins."""

    def __init__(self, k: int, metric: Metric = EUCLIDEAN, num_samples: int = 5, sample_size: int = 1000, max_iter: int = 100, inner: str = "fastpam", seed: int = 42):
        if inner not in INNER:
            raise ValueError(f"Unknown inner: '{inner}'. Known: {sorted(INNER)}")
        self.k, self.metric, self.num_samples, self.sample_size, self.max_iter, self.inner, self.seed = k, metric, num_samples, sample_size, max_iter, inner, seed

    def seeded(self, points: PointSet, df: DataFrame, pool_size: int = 0) -> Seeded:
        n = points.count()
        if n < self.k:
            raise too_small(n, self.k)
        cached = PointSet(df, n)
        if n <= self.sample_size:
            _, x, w = cached.collect()
            samples, pool = [(x, w)], x if pool_size else None
        else:
            drawn = draw_samples(cached, [self.sample_size] * self.num_samples + ([pool_size] if pool_size else []), n, self.seed)
            samples = [(x, w) for _, x, w in drawn[: self.num_samples]]
            pool = drawn[-1][1] if pool_size else None
        sets = []
        for s, (x, w) in enumerate(samples):
            if len(x) < self.k:
                raise ValueError(f"sample {s} has {len(x)} rows for k={self.k}")
            sets.append(x[solve(df.sparkSession, x, w, self.metric, self.k, self.max_iter, self.seed, self.inner)])
        costs = set_costs(df, sets, self.metric)
        best = int(costs.argmin())
        return Seeded(sets[best], float(costs[best]), pool)

    def fit(self, points: PointSet) -> PrototypeModel:
        df = points.df.select("rid", "features", "weight").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return PrototypeModel(self.seeded(points, df).medoids, self.metric)
        finally:
            df.unpersist()


def cell_candidate_costs(df: DataFrame, medoids: np.ndarray, candidates: np.ndarray, cell: np.ndarray, metric: Metric) -> np.ndarray:
    """Σ w·d of each candidate over the points of its own cell."""
    shared = df.sparkSession.sparkContext.broadcast((medoids, candidates, cell))

    def compute(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        m, c, own = shared.value
        out = np.zeros(len(c))
        for s in row_blocks(len(x), len(c)):
            label = metric.pairwise(x[s], m).argmin(1)
            for j in np.unique(label):
                rows, at = np.flatnonzero(label == j), np.flatnonzero(own == j)
                if len(at):
                    out[at] += w[s][rows] @ metric.pairwise(x[s][rows], c[at])
        return out

    return ordered_sum(df, compute, len(candidates))


def refine(df: DataFrame, medoids: np.ndarray, pool: np.ndarray, metric: Metric, rounds: int, cost: float | None = None) -> tuple[np.ndarray, float]:
    """Replace each medoid by a pool member of its cell that serves the cell strictly better; rounds must lower the total cost."""
    cost = float(set_costs(df, [medoids], metric)[0]) if cost is None else cost
    for _ in range(rounds):
        candidates = np.vstack([medoids, pool]) if len(pool) else medoids
        cell = metric.pairwise(candidates, medoids).argmin(1)
        cell[: len(medoids)] = np.arange(len(medoids))
        costs = cell_candidate_costs(df, medoids, candidates, cell, metric)
        new = medoids.copy()
        for j in range(len(medoids)):
            at = np.flatnonzero(cell == j)  # the incumbent is the first of its cell
            best = at[int(costs[at].argmin())]
            if costs[best] < costs[j]:
                new[j] = candidates[best]
        if np.array_equal(new, medoids):
            break
        total = float(set_costs(df, [new], metric)[0])
        if not total < cost:
            break
        medoids, cost = new, total
    return medoids, cost


class Pamae:
    """CLARA's winner, refined cell by cell over all points with candidates from a pool."""

    def __init__(self, k: int, metric: Metric = EUCLIDEAN, num_samples: int = 5, sample_size: int = 1000, max_iter: int = 100, inner: str = "fastpam", seed: int = 42, refine_iters: int = 1, pool_size: int = 2000):
        if refine_iters < 1:
            raise ValueError("refineIters must be at least 1")
        self.clara = Clara(k, metric, num_samples, sample_size, max_iter, inner, seed)
        self.metric, self.refine_iters, self.pool_size = metric, refine_iters, pool_size

    def fit(self, points: PointSet) -> PrototypeModel:
        df = points.df.select("rid", "features", "weight").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            start = self.clara.seeded(points, df, self.pool_size)
            medoids, _ = refine(df, start.medoids, start.pool, self.metric, self.refine_iters, start.cost)
            return PrototypeModel(medoids, self.metric)
        finally:
            df.unpersist()
