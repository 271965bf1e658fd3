"""Weighted sums: ordered partial sums of kernels, per-cell statistics, label counts, moments."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import Metric, literal, sanitize_weight
from ..sources.points import matrix
from .assign import nearest_rows, row_blocks, two_nearest

#: Doubles that partials may bring to the driver at once; beyond, groups of partials are merged, by as many levels as it takes.
DRIVER_VALUES = 1_000_000
FAN_IN = 8


def ordered_sum(df: DataFrame, compute: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sum of ``compute(features, weights)`` (``width`` doubles a batch) over all batches, in partition order.

    The order of additions depends on the partitioning alone, so repeated runs give the same bits.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += compute(matrix(batch.column(0)), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total], pa.list_(pa.float64()))], ["pid", "v"])

    parts = df.select("features", "weight").mapInArrow(partial, "pid int, v array<double>")

    def merge(table: pa.Table) -> pa.Table:
        at, total = table.column("pid").to_numpy(), np.zeros(width)
        for i in at.argsort():
            total += table.column("v")[int(i)].values.to_numpy()
        return pa.table({"pid": pa.array([at.min() // FAN_IN], pa.int32()), "v": pa.array([total], pa.list_(pa.float64()))})

    left = df.rdd.getNumPartitions()
    while left > 1 and left * width > DRIVER_VALUES:
        parts = parts.groupBy(F.floor(F.col("pid") / FAN_IN)).applyInArrow(merge, "pid int, v array<double>")
        left = -(-left // FAN_IN)
    table, total = parts.toArrow(), np.zeros(width)
    for i in table.column("pid").to_numpy().argsort():
        total += table.column("v")[int(i)].values.to_numpy()
    return total


@dataclass
class CellStats:
    """Per prototype: rows, mass, weighted coordinate sums, Σw·d² and Σw·(d2²-d1²)."""

    count: np.ndarray
    mass: np.ndarray
    sums: np.ndarray
    error: np.ndarray
    utility: np.ndarray

    @staticmethod
    def of(flat: np.ndarray, k: int, d: int) -> CellStats:
        t = flat.reshape(k, d + 4)
        return CellStats(t[:, 0], t[:, 1], t[:, 4:], t[:, 2], t[:, 3])

    def means(self, old: np.ndarray, project) -> np.ndarray:
        """Weighted means, projected; cells without rows or mass keep their prototype."""
        live = (self.count > 0) & (self.mass > 0)
        new = old.copy()
        new[live] = project(self.sums[live] / self.mass[live, None])
        return new


def cell_stats(df: DataFrame, prototypes: np.ndarray, metric: Metric) -> CellStats:
    """One pass of assignment and sums by an Arrow kernel."""
    k, d = prototypes.shape
    shared = df.sparkSession.sparkContext.broadcast(prototypes)

    def compute(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        out = np.zeros((k, d + 4))
        for s in row_blocks(len(x), k):
            label, d1, d2 = nearest_rows(x[s], shared.value, metric)
            own = w[s]
            out[:, 0] += np.bincount(label, minlength=k)
            out[:, 1] += np.bincount(label, own, k)
            out[:, 2] += np.bincount(label, own * d1 * d1, k)
            out[:, 3] += np.bincount(label, own * (d2 * d2 - d1 * d1), k)
            for c in range(d):
                out[:, 4 + c] += np.bincount(label, own * x[s, c], k)
        return out.ravel()

    flat = ordered_sum(df, compute, k * (d + 4))
    shared.unpersist()
    return CellStats.of(flat, k, d)


def cell_stats_table(df: DataFrame, prototypes: np.ndarray, metric: Metric) -> DataFrame:
    """The same sums as a DataFrame (label, rows, mass, error, utility), all in expressions."""
    two = df.withColumn("t", two_nearest(F.col("features"), prototypes, metric)).select("weight", "t.*")
    return two.groupBy("label").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("weight").alias("mass"), F.sum(F.col("weight") * F.col("d1") * F.col("d1")).alias("error"), F.sum(F.col("weight") * (F.col("d2") * F.col("d2") - F.col("d1") * F.col("d1"))).alias("utility")
    )


def coordinate_sums(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, mass, value): weighted coordinate sums by group and position, with map-side partial sums."""
    long = df.select(*keys, "weight", F.posexplode("features").alias("pos", "x"))
    return long.groupBy(*keys, "pos").agg(F.sum("weight").alias("mass"), F.sum(F.col("weight") * F.col("x")).alias("value"))


def label_stats(labelled: DataFrame) -> DataFrame:
    """(label, rows, mass): mass counts finite positive weights only."""
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.sum(sanitize_weight(F.col("weight"))).alias("mass"))


@dataclass
class Moments:
    """Per cluster, ascending by label: mass, centroid, Σw·d and Σw·d² to the centroid."""

    labels: np.ndarray
    mass: np.ndarray
    centroids: np.ndarray
    spread: np.ndarray
    squares: np.ndarray

    @property
    def total_mass(self) -> float:
        return float(self.mass.sum())

    @property
    def global_centroid(self) -> np.ndarray:
        total = self.total_mass
        return (self.centroids * self.mass[:, None]).sum(0) / total if total > 0 else np.zeros(self.centroids.shape[1])


def cluster_moments(labelled: DataFrame, metric: Metric) -> Moments:
    """Two passes over the labelled rows; noise (-1) is left out."""
    rows = labelled.filter("label <> -1").select("label", "features", sanitize_weight(F.col("weight")).alias("weight"))
    first = coordinate_sums(rows, ["label"]).orderBy("label", "pos").toArrow().to_pylist()
    labels = sorted({r["label"] for r in first})
    d = 1 + max((r["pos"] for r in first), default=-1)
    place = {label: i for i, label in enumerate(labels)}
    mass, centroids = np.zeros(len(labels)), np.zeros((len(labels), d))
    for r in first:
        i = place[r["label"]]
        mass[i] = r["mass"]
        centroids[i, r["pos"]] = r["value"]
    centroids = np.where(mass[:, None] > 0, centroids / np.where(mass > 0, mass, 1)[:, None], 0.0)
    if not labels:
        return Moments(np.zeros(0, int), mass, centroids, mass, mass)
    table = F.create_map(*[x for label, c in zip(labels, centroids, strict=True) for x in (F.lit(label), literal(c))])
    distance = metric.column(F.col("features"), F.col("c"))
    second = rows.withColumn("c", table[F.col("label")]).withColumn("d", distance).groupBy("label").agg(F.sum(F.col("weight") * F.col("d")).alias("s"), F.sum(F.col("weight") * F.col("d") * F.col("d")).alias("q")).collect()
    by = {r["label"]: r for r in second}
    return Moments(np.array(labels), mass, centroids, np.array([by[x]["s"] for x in labels]), np.array([by[x]["q"] for x in labels]))
