"""DBSCAN++: density from a sample of candidates against all points; with every point a candidate, exact DBSCAN."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import EUCLIDEAN, Metric, all_finite
from ..operators import grid
from ..operators.epsilon import MOST_CANDIDATES, chunk_edges, components_table, core_components, mass_within
from ..operators.sampling import exact_sample
from ..sources.points import PointSet, written
from .models import CoreModel, CoreTableModel, Model, chunks_of

#: Bytes of candidates that are gathered and broadcast at once; more of them are worked on in chunks or on a grid.
CANDIDATE_BYTES = 256 << 20
#: Distances beyond which the grid is faster than comparing candidates with points, where it fits.
MOST_DISTANCES = 20_000_000_000


class DBSCANpp:
    """``min_pts`` is a mass and a point counts itself; clusters are numbered by their first core."""

    def __init__(self, eps: float, min_pts: float, core_fraction: float = 1.0, metric: Metric = EUCLIDEAN, assign: str = "eps", chunk_size: int = MOST_CANDIDATES, sampling: str = "uniform", seed: int = 42, candidate_bytes: int = CANDIDATE_BYTES):
        if not eps > 0:
            raise ValueError("eps must be positive")
        if min_pts < 1:
            raise ValueError("minPts must be at least 1")
        if not 0 < core_fraction <= 1:
            raise ValueError("coreSampleFraction must be in (0, 1]")
        if assign not in ("eps", "closest"):
            raise ValueError("assign is 'eps' or 'closest'")
        if sampling != "uniform":
            raise ValueError("sampling is 'uniform'")
        if chunk_size < 1:
            raise ValueError("chunkSize must be at least 1")
        self.eps, self.min_pts, self.core_fraction, self.metric, self.assign, self.chunk_size, self.seed, self.candidate_bytes = eps, min_pts, core_fraction, metric, assign, chunk_size, seed, candidate_bytes

    def fit(self, points: PointSet) -> Model:
        df = points.df.select("rid", "features", "weight").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            n = points.count()
            m = max(1, min(n, math.ceil(self.core_fraction * n)))
            d = PointSet(df).dimension() or 0
            # the grid tells the nearest core within the radius; what lies beyond costs distances in any way
            if (m * n > MOST_DISTANCES or self.assign == "eps" and 8 * m * d > self.candidate_bytes) and self.grid_fits(df, d):
                return self.fit_on_grid(df, m, n, d)
            chosen = df if m >= n else exact_sample(df, m, self.seed)
            if 8 * m * d > self.candidate_bytes:
                return self.fit_in_chunks(df, chosen, 8 * m * d)
            _, candidates, _ = PointSet(chosen).collect()
            density = mass_within(df, candidates, self.eps, self.metric, self.chunk_size) if len(candidates) else np.zeros(0)
            cores = candidates[density >= self.min_pts]
            labels = core_components(df.sparkSession, cores, self.eps, self.metric)
            return CoreModel(cores, labels, self.metric, self.radius)
        finally:
            df.unpersist()

    @property
    def radius(self) -> float | None:
        return self.eps if self.assign == "eps" else None

    def grid_fits(self, df: DataFrame, d: int) -> bool:
        """A norm, few dimensions, and coordinates that leave cells whole numbers."""
        if not grid.Grid.fits(self.metric, d):
            return False
        largest = df.filter(all_finite(F.col("features"))).agg(F.max(F.array_max(F.transform("features", F.abs)))).first()[0]
        return largest is None or largest / grid.Grid(self.eps, self.metric, d).side <= grid.MOST_CELLS

    def fit_on_grid(self, df: DataFrame, m: int, n: int, d: int) -> CoreTableModel:
        """The same cores and labels with nothing gathered: for norms in up to three dimensions."""
        cells = grid.Grid(self.eps, self.metric, d)
        placed = written(cells.place(df))
        chosen = placed if m >= n else cells.place(exact_sample(df, m, self.seed))
        found = grid.cores(cells, placed, chosen, self.min_pts)
        labels = grid.core_labels(cells, found, components_table)
        return CoreTableModel(written(found.join(labels, "cell").select("rid", "features", "label")), self.metric, self.radius, self.candidate_bytes, cells)

    def fit_in_chunks(self, df: DataFrame, chosen: DataFrame, size: int) -> CoreTableModel:
        """The same cores and labels in any dimension and metric: candidates stay in a table, chunks of them meet all points, then all cores."""
        n = chunks_of(size, self.candidate_bytes)
        candidates = written(chosen.select("rid", "features", "weight", F.pmod(F.xxhash64(F.lit("chunk"), "rid"), F.lit(n)).alias("chunk")))
        spark, found = df.sparkSession, []
        for c in range(n):
            own = candidates.filter(F.col("chunk") == c)
            ids, rows, _ = PointSet(own).collect()
            dense = ids[mass_within(df, rows, self.eps, self.metric, self.chunk_size) >= self.min_pts] if len(ids) else ids
            kept = spark.createDataFrame(pa.table({"rid": pa.array(dense, pa.int64())}))
            found.append(written(own.join(kept, "rid", "left_semi").select("rid", "features", "weight", "chunk")))
        cores = written(reduce(DataFrame.unionByName, found))
        edges = []
        for part in found:
            ids, rows, _ = PointSet(part).collect()
            if len(ids):
                edges.append(written(chunk_edges(cores, (ids, rows), self.eps, self.metric)))
        if not edges:
            return CoreTableModel(cores.select("rid", "features", F.lit(-1).alias("label")), self.metric, self.radius, self.candidate_bytes)
        reached = written(components_table(cores.select("rid"), reduce(DataFrame.unionByName, edges)))
        labels = grid.numbered(reached.select(F.col("component").alias("root")).distinct())
        named = reached.join(labels, F.col("component") == F.col("root")).select("rid", "label")
        return CoreTableModel(written(cores.join(named, "rid").select("rid", "features", "label")), self.metric, self.radius, self.candidate_bytes)
