"""Fitted models: pure functions from coordinates to labels, applied as ``transform``."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import Metric
from ..operators import grid
from ..operators.assign import Windows, assign_cores, assign_nearest, nearest_rows, nearest_within, tree_label
from ..sources.points import matrix, written

#: Distances beyond which rows far from all cores look for them on wider grids.
FAR_DISTANCES = 20_000_000_000


class Model:
    """``transform`` adds ``label int``; ``predict_all`` labels driver rows alike."""

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def predict_all(self, rows: np.ndarray) -> np.ndarray:
        raise NotImplementedError


@dataclass
class PrototypeModel(Model):
    """Nearest prototype (centroid or medoid), ties to the lowest number."""

    prototypes: np.ndarray
    metric: Metric

    def transform(self, df: DataFrame) -> DataFrame:
        return assign_nearest(df, self.prototypes, self.metric)

    def predict_all(self, rows: np.ndarray) -> np.ndarray:
        return nearest_rows(np.asarray(rows, float), self.prototypes, self.metric)[0]


@dataclass
class TreeModel(Model):
    """Walk of a binary tree of centroids; leaves are numbered in depth-first order."""

    centroids: np.ndarray
    left: list[int]
    right: list[int]
    leaf: list[int]
    metric: Metric

    @property
    def num_clusters(self) -> int:
        return sum(x >= 0 for x in self.leaf)

    @property
    def cluster_centroids(self) -> np.ndarray:
        return self.centroids[[self.leaf.index(i) for i in range(self.num_clusters)]]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("label", tree_label(F.col("features"), self.centroids, self.left, self.right, self.leaf, self.metric))

    def predict_all(self, rows: np.ndarray) -> np.ndarray:
        rows = np.asarray(rows, float)
        node = np.zeros(len(rows), int)
        left, right = np.array(self.left), np.array(self.right)
        while True:
            inner = np.flatnonzero(left[node] >= 0)
            if not len(inner):
                return np.array(self.leaf)[node]
            for n in np.unique(node[inner]):
                own = inner[node[inner] == n]
                d = self.metric.pairwise(rows[own], self.centroids[[left[n], right[n]]])
                d[np.isnan(d)] = np.inf
                node[own] = np.where(d[:, 1] < d[:, 0], right[n], left[n])


@dataclass
class CoreModel(Model):
    """Label of the nearest core point; -1 beyond ``radius`` (None: always assigned), and without cores."""

    cores: np.ndarray
    core_labels: np.ndarray
    metric: Metric
    radius: float | None

    @property
    def num_clusters(self) -> int:
        return len(set(self.core_labels.tolist()))

    def transform(self, df: DataFrame) -> DataFrame:
        return assign_cores(df, self.cores, self.core_labels, self.metric, self.radius)

    def predict_all(self, rows: np.ndarray) -> np.ndarray:
        rows = np.asarray(rows, float)
        if not len(self.cores):
            return np.full(len(rows), -1)
        return np.append(self.core_labels, -1)[nearest_within(rows, Windows(self.cores, self.radius, self.metric), self.metric, self.radius)[0]]


def chunks_of(size: int, most: int) -> int:
    """How many chunks hold ``size`` bytes, and room for their unequal sizes."""
    return max(1, math.ceil(1.25 * size / max(most, 1)))


@dataclass
class CoreTableModel(Model):
    """As ``CoreModel``, for cores that stay in a table (rid, features, label): labels batches and streams.

    Chunks of the cores, ``chunk_bytes`` each, are broadcast one after the other, and every row carries its
    nearest core through them. With a ``grid`` batches take its cells instead.
    """

    cores: DataFrame
    metric: Metric
    radius: float | None
    chunk_bytes: int
    grid: grid.Grid | None = None

    @property
    def num_clusters(self) -> int:
        return self.cores.filter("label >= 0").select("label").distinct().count()

    def transform(self, df: DataFrame) -> DataFrame:
        if self.grid is not None and not df.isStreaming:
            cells = self.grid.place(self.cores)
            near = grid.assign(self.grid, df, cells.select("rid", "features", "cell"), cells.groupBy("cell").agg(F.first("label").alias("label")))
            return near if self.radius is not None else self.beyond(near)
        return self.through_chunks(df)

    def beyond(self, near: DataFrame) -> DataFrame:
        """Labels at any distance for the rows without a core within the grid's radius: by wider grids while they are many."""
        near, n, radius, told = written(near), self.cores.count(), self.grid.radius, []
        rest = written(self.grid.place(near.filter("label = -1")).select("features").distinct())
        while n and (left := rest.count()):
            if left * n <= FAR_DISTANCES:
                told.append(self.through_chunks(rest))
                break
            radius *= 2
            told.append(written(grid.nearest(grid.Grid(radius, self.metric, self.grid.d), rest, self.cores)))
            rest = written(rest.join(told[-1], "features", "left_anti"))
        if not told:
            return near
        names = reduce(DataFrame.unionByName, told).withColumnRenamed("label", "__far")
        return near.join(names, "features", "left").withColumn("label", F.coalesce("__far", "label")).select(*near.columns)

    def through_chunks(self, df: DataFrame) -> DataFrame:
        size = self.cores.agg(F.sum(F.size("features") * 8)).first()[0] or 0
        if not size:
            return df.withColumn("label", F.lit(-1))
        n, kept, metric, radius = chunks_of(size, self.chunk_bytes), df.drop("label"), self.metric, self.radius
        at, width = kept.columns.index("features"), len(kept.columns)
        schema = T.StructType([*kept.schema.fields, T.StructField("label", T.IntegerType()), T.StructField("__far", T.DoubleType()), T.StructField("__core", T.LongType())])
        out = kept.withColumns({"label": F.lit(-1), "__far": F.lit(float("inf")).cast("double"), "__core": F.lit(0).cast("long")})
        for c in range(n):
            part = self.cores.filter(F.pmod(F.xxhash64(F.lit("part"), "rid"), F.lit(n)) == c).orderBy("rid").toArrow()
            if not part.num_rows:
                continue
            rows = matrix(part.column("features").combine_chunks())
            shared = df.sparkSession.sparkContext.broadcast((part.column("rid").to_numpy(), part.column("label").to_numpy(), Windows(rows, self.radius, self.metric)))

            def nearer(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                ids, names, own = shared.value
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    label, far, core = (batch.column(width + k).to_numpy() for k in range(3))
                    index, d = nearest_within(matrix(batch.column(at)), own, metric, radius)
                    hit = (index >= 0) & ((d < far) | ((d == far) & (ids[index] < core)))
                    new = [np.where(hit, names[index], label).astype(np.int32), np.where(hit, d, far), np.where(hit, ids[index], core)]
                    yield pa.RecordBatch.from_arrays([*batch.columns[:width], *map(pa.array, new)], schema=batch.schema)

            out = out.mapInArrow(nearer, schema)
        return out.drop("__far", "__core")

    def predict_all(self, rows: np.ndarray) -> np.ndarray:
        rows = np.asarray(rows, float)
        df = self.cores.sparkSession.createDataFrame([(i, x) for i, x in enumerate(rows.tolist())], "i long, features array<double>")
        return np.array([r["label"] for r in self.transform(df).orderBy("i").collect()], int)
