"""Assignment of points to a small replicated side: nearest, two nearest, within a radius, tree walks.

Tiny prototype sets (``LITERAL_VALUES`` numbers or fewer) become literals of one expression, which
needs no Python worker; larger ones are a broadcast for an Arrow kernel, several times as fast. Both
give ties to the lowest index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import Metric, literal
from ..sources.points import matrix

LITERAL_VALUES = 8
#: Bytes of one block of distances in a kernel.
BLOCK_BYTES = 2 << 20


def ranked(features: Column, prototypes: np.ndarray, metric: Metric) -> Column:
    """array<struct<d, i>> of all prototypes; a NaN distance counts as infinite."""
    table = F.array(*[F.struct(literal(p).alias("p"), F.lit(i).alias("i")) for i, p in enumerate(prototypes)])
    clean = lambda d: F.when(F.isnan(d), F.lit(float("inf"))).otherwise(d)
    return F.transform(table, lambda t: F.struct(clean(metric.column(features, t["p"])).alias("d"), t["i"].alias("i")))


def nearest_index(features: Column, prototypes: np.ndarray, metric: Metric) -> Column:
    """Index of the nearest prototype, the lowest of equals; 0 if no distance is a number."""
    return F.array_min(ranked(features, prototypes, metric))["i"].cast("int")


def two_nearest(features: Column, prototypes: np.ndarray, metric: Metric) -> Column:
    """struct<label, d1, d2>; with one prototype d2 = d1."""
    two = F.slice(F.array_sort(ranked(features, prototypes, metric)), 1, 2)
    return F.struct(two[0]["i"].cast("int").alias("label"), two[0]["d"].alias("d1"), (two[1] if len(prototypes) > 1 else two[0])["d"].alias("d2"))


def row_blocks(n: int, width: int) -> Iterator[slice]:
    step = max(1, BLOCK_BYTES // (8 * max(1, width)))
    for s in range(0, n, step):
        yield slice(s, min(n, s + step))


def nearest_rows(x: np.ndarray, prototypes: np.ndarray, metric: Metric) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label, d1, d2) of each row, in bounded blocks."""
    label, d1, d2 = np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.full(len(x), np.inf)
    for s in row_blocks(len(x), len(prototypes)):
        d = metric.pairwise(x[s], prototypes)
        d[np.isnan(d)] = np.inf
        label[s] = d.argmin(1)
        own = np.arange(len(d)), label[s]
        d1[s] = d[own]
        if d.shape[1] > 1:
            d[own] = np.inf
            d2[s] = d.min(1)
        else:
            d2[s] = d1[s]
    return label, d1, d2


def with_labels(df: DataFrame, labels_of, features: str = "features", out: str = "label") -> DataFrame:
    """Append ``out`` computed by ``labels_of(matrix) -> int array`` in Arrow batches."""
    kept = df.drop(out)
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.IntegerType())])
    at = kept.columns.index(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = labels_of(matrix(batch.column(at))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(label.astype(np.int32))], [*batch.schema.names, out])

    return kept.mapInArrow(run, schema)


def assign_nearest(df: DataFrame, prototypes: np.ndarray, metric: Metric, features: str = "features", out: str = "label") -> DataFrame:
    if prototypes.size <= LITERAL_VALUES:
        return df.withColumn(out, nearest_index(F.col(features), prototypes, metric))
    shared = df.sparkSession.sparkContext.broadcast(prototypes)
    return with_labels(df, lambda x: nearest_rows(x, shared.value, metric)[0], features, out)


class Windows:
    """Points sorted along their widest axis: for norms, what lies within a radius of some rows lies in a slice of them."""

    def __init__(self, points: np.ndarray, radius: float | None, metric: Metric):
        self.axis, self.order = None, np.arange(len(points))
        if radius is not None and len(points) and metric.name in ("euclidean", "manhattan"):
            known = np.where(np.isfinite(points), points, np.nan)
            spread = np.zeros(points.shape[1])
            full = ~np.isnan(known).all(0)
            spread[full] = np.nanmax(known[:, full], 0) - np.nanmin(known[:, full], 0)
            self.axis, self.reach = int(spread.argmax()), radius * (1 + 1e-9)
            self.order = np.argsort(points[:, self.axis], kind="stable")
        self.points = points[self.order]

    def meet(self, x: np.ndarray, rows: int = 512) -> Iterator[tuple[np.ndarray, slice]]:
        """(rows of ``x``, slice of the points): all pairs within the radius are in some of them; blocks are bounded."""
        n = len(self.points)
        if self.axis is None:
            for s in row_blocks(len(x), n):
                yield np.arange(s.start, s.stop), slice(0, n)
            return
        at, key = np.flatnonzero(np.isfinite(x[:, self.axis])), self.points[:, self.axis]
        at = at[np.argsort(x[at, self.axis], kind="stable")]
        for s in range(0, len(at), rows):
            own = at[s : s + rows]
            room = 1e-12 * (abs(x[own[0], self.axis]) + abs(x[own[-1], self.axis]))
            window = slice(int(np.searchsorted(key, x[own[0], self.axis] - self.reach - room)), int(np.searchsorted(key, x[own[-1], self.axis] + self.reach + room, "right")))
            if window.stop > window.start:
                for b in row_blocks(len(own), window.stop - window.start):
                    yield own[b], window


def nearest_within(x: np.ndarray, cores: Windows, metric: Metric, radius: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(index, distance) of each row's nearest core by its place before sorting, the lowest of equals; -1 beyond the radius or without a distance."""
    found, best = np.full(len(x), -1), np.full(len(x), np.inf)
    for rows, window in cores.meet(x):
        index = np.sort(cores.order[window])
        own = cores.points[window][np.argsort(cores.order[window], kind="stable")]
        d = metric.pairwise(x[rows], own)
        d[np.isnan(d)] = np.inf
        at = d.argmin(1)
        near = d[np.arange(len(d)), at]
        hit = np.isfinite(near)
        if radius is not None:
            hit &= ((x[rows] - own[at]) ** 2).sum(1) <= radius * radius if metric.name == "euclidean" else near <= radius
        found[rows], best[rows] = np.where(hit, index[at], -1), np.where(hit, near, np.inf)
    return found, best


def assign_cores(df: DataFrame, cores: np.ndarray, labels: np.ndarray, metric: Metric, radius: float | None, features: str = "features", out: str = "label") -> DataFrame:
    """The label of the nearest core; -1 if there is none, beyond ``radius`` (if given), or without a distance."""
    if not len(cores):
        return df.withColumn(out, F.lit(-1))
    shared = df.sparkSession.sparkContext.broadcast((Windows(cores, radius, metric), np.append(labels, -1)))
    return with_labels(df, lambda x: shared.value[1][nearest_within(x, shared.value[0], metric, radius)[0]], features, out)


def tree_label(features: Column, centroids: np.ndarray, left: list[int], right: list[int], leaf: list[int], metric: Metric, node: int = 0) -> Column:
    """Walk from the root to the nearer child, left on ties; the leaf's number."""
    if left[node] < 0:
        return F.lit(int(leaf[node]))
    a, b = (metric.column(features, literal(centroids[c])) for c in (left[node], right[node]))
    go_right = ~F.isnan(b) & (F.isnan(a) | (b < a))
    deeper = lambda c: tree_label(features, centroids, left, right, leaf, metric, c)
    return F.when(go_right, deeper(right[node])).otherwise(deeper(left[node]))
