"""Distances and vector functions, each as a Column builder and as a numpy kernel.

The two forms of a metric agree row by row; tests hold them together. Vectors are
``array<double>`` columns or two-dimensional float64 arrays.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_euclidean(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine; 1 if either vector is zero."""
    aa, bb = dot(a, a), dot(b, b)
    return F.when((aa == 0) | (bb == 0), F.lit(1.0)).otherwise(1 - dot(a, b) / (F.sqrt(aa) * F.sqrt(bb)))


def unit_sphere(a: Column, b: Column) -> Column:
    """1 - a.b, for vectors of length one."""
    return 1 - dot(a, b)


def l2_normalize(v: Column) -> Column:
    """v scaled to length one; the zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm == 0, v).otherwise(F.transform(v, lambda x: x / norm))


def add_scaled(total_: Column, v: Column, weight: Column) -> Column:
    return F.zip_with(total_, v, lambda s, x: s + weight * x)


def mean_of(sums: Column, mass: Column) -> Column:
    return F.transform(sums, lambda s: s / mass)


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def all_finite(v: Column) -> Column:
    return F.forall(v, is_finite)


def sanitize_weight(w: Column) -> Column:
    """w where it is finite and positive, else 0."""
    return F.when(is_finite(w) & (w > 0), w).otherwise(F.lit(0.0))


def balanced_row(t: Column, m: Column | int) -> Column:
    """Pairs the long and the short rows of a triangle: t even -> t/2, odd -> m-1-t/2."""
    half = F.floor(t / 2)
    return F.when(t % 2 == 0, half).otherwise(F.lit(m) - 1 - half if isinstance(m, int) else m - 1 - half)


# ---------------------------------------------------------------- numpy kernels
def _np_squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    if a.shape[1] <= 32:  # differences keep all digits
        for k in range(a.shape[1]):
            out += (a[:, k, None] - b[None, :, k]) ** 2
        return out
    for s in range(0, len(a), 256):
        step = a[s : s + 256, None, :] - b[None, :, :] if len(b) * a.shape[1] <= 1 << 16 else None
        out[s : s + 256] = np.einsum("ijk,ijk->ij", step, step) if step is not None else np.stack([((a[i] - b) ** 2).sum(1) for i in range(s, min(s + 256, len(a)))])
    return out


def _np_euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(_np_squared(a, b))


def _np_manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out, columns = np.zeros((len(a), len(b))), np.ascontiguousarray(b.T)
    rows = max(1, (1 << 14) // max(1, len(b)))  # that stay in a processor's cache
    for s in range(0, len(a), rows):
        own = out[s : s + rows]
        step = np.empty_like(own)
        for k in range(a.shape[1]):
            np.abs(np.subtract(a[s : s + rows, k, None], columns[k], out=step), out=step)
            own += step
    return out


def _np_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    with np.errstate(divide="ignore", invalid="ignore"):
        out = 1 - (a @ b.T) / (na[:, None] * nb[None, :])
    out[(na == 0)[:, None] | (nb == 0)[None, :]] = 1.0
    return out


def _np_unit_sphere(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - a @ b.T


@dataclass(frozen=True)
class Metric:
    """A distance: ``column(a, b)`` and ``pairwise(A, B)``."""

    name: str
    column: Callable[[Column, Column], Column]
    pairwise: Callable[[np.ndarray, np.ndarray], np.ndarray]

    def within(self, a: Column, b: Column, radius: float | Column) -> Column:
        """distance <= radius; Euclidean compares squares. NaN is outside for the norms."""
        r = radius if isinstance(radius, Column) else F.lit(float(radius))
        d, bound = (squared_euclidean(a, b), r * r) if self.name == "euclidean" else (self.column(a, b), r)
        return ~F.isnan(d) & (d <= bound)

    def within_pairs(self, a: np.ndarray, b: np.ndarray, radius: float) -> np.ndarray:
        with np.errstate(invalid="ignore"):
            return _np_squared(a, b) <= radius * radius if self.name == "euclidean" else self.pairwise(a, b) <= radius

    def up_to(self, a: Column, b: Column, bound: float | Column) -> Column:
        """The distance if it is at most the bound, else infinity."""
        d = self.column(a, b)
        limit = bound if isinstance(bound, Column) else F.lit(float(bound))
        return F.when(~F.isnan(d) & (d <= limit), d).otherwise(F.lit(float("inf")))


EUCLIDEAN = Metric("euclidean", euclidean, _np_euclidean)
MANHATTAN = Metric("manhattan", manhattan, _np_manhattan)
COSINE = Metric("cosine", cosine, _np_cosine)
UNIT_SPHERE = Metric("unitsphere", unit_sphere, _np_unit_sphere)


@dataclass(frozen=True)
class Geometry:
    """How k-means prepares rows, measures while fitting and in the model, and projects means."""

    name: str
    fit: Metric
    model: Metric

    def prepare(self, v: Column) -> Column:
        return l2_normalize(v) if self.name == "spherical" else v

    def project(self, rows: np.ndarray) -> np.ndarray:
        if self.name != "spherical":
            return rows
        norm = np.sqrt((rows * rows).sum(-1, keepdims=True))
        return np.where(norm == 0, rows, rows / np.where(norm == 0, 1, norm))


PLANE = Geometry("euclidean", EUCLIDEAN, EUCLIDEAN)
SPHERE = Geometry("spherical", UNIT_SPHERE, COSINE)


def compare_by_coordinates(a, b) -> int:
    """Lexicographic order of two vectors; a prefix comes first."""
    for x, y in zip(a, b, strict=False):
        if x != y:
            return -1 if x < y else 1
    return (len(a) > len(b)) - (len(a) < len(b))
