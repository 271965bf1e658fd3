"""Names that configurations may use, and how each is built. New entries are one ``register`` call."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, Generic, TypeVar

from pyspark.sql import SparkSession

from ..functions.vectors import COSINE, EUCLIDEAN, MANHATTAN, PLANE, SPHERE, Geometry, Metric
from ..sources.points import PointSet, read_parquet, synthetic
from .bisecting import BisectingKMeans
from .dbscan import DBSCANpp
from .kmeans import BreathingKMeans, KMeans
from .medoids import Clara, DistributedFastPAM, LocalMedoids, Pamae

V = TypeVar("V")


class NamedRegistry(Generic[V]):
    """Case-insensitive names."""

    def __init__(self, kind: str, entries: dict[str, V]):
        self.kind, self.entries = kind, {k.lower(): v for k, v in entries.items()}

    def register(self, name: str, value: V) -> None:
        self.entries[name.lower()] = value

    def get(self, name: str) -> V:
        try:
            return self.entries[str(name).lower()]
        except KeyError:
            raise ValueError(f"Unknown {self.kind}: '{name}'. Known: [{', '.join(sorted(self.entries))}]") from None


class Params:
    """Typed access to a configuration's parameters."""

    def __init__(self, values: dict[str, Any] | None, owner: str):
        self.values, self.owner = dict(values or {}), owner

    def _read(self, name: str, default: Any, make: Callable) -> Any:
        if self.values.get(name) is None:
            if default is ...:
                raise ValueError(f"{self.owner} needs the parameter '{name}'")
            return default
        try:
            return make(self.values[name])
        except (TypeError, ValueError):
            raise ValueError(f"{self.owner}: parameter '{name}' is '{self.values[name]}'") from None

    def integer(self, name: str, default: Any = ...) -> int:
        return self._read(name, default, lambda v: int(float(v)) if not isinstance(v, int) else v)

    def number(self, name: str, default: Any = ...) -> float:
        return self._read(name, default, float)

    def text(self, name: str, default: Any = ...) -> str:
        return self._read(name, default, str)

    def as_strings(self) -> dict[str, str]:
        return {k: str(v) for k, v in self.values.items()}


@dataclass
class Built:
    clusterer: Any
    metric: Metric


DISTANCES: NamedRegistry[Metric] = NamedRegistry("distance", {"euclidean": EUCLIDEAN, "manhattan": MANHATTAN, "cosine": COSINE})
GEOMETRIES: NamedRegistry[Geometry] = NamedRegistry("geometry", {"euclidean": PLANE, "spherical": SPHERE})


def _kmeans(p: Params) -> Built:
    geometry = GEOMETRIES.get(p.text("geometry", "euclidean"))
    common = {"k": p.integer("k"), "max_iter": p.integer("maxIter", 100), "eps": p.number("eps", 1e-4), "seed": p.integer("seed", 42), "geometry": geometry}
    how = p.text("refine", "none").lower()
    if how == "breathing":
        return Built(BreathingKMeans(**common, m0=p.integer("m0", 5), max_cycles=p.integer("maxCycles", 100)), geometry.model)
    if how != "none":
        raise ValueError(f"Unknown refine: '{how}'. Known: [breathing, none]")
    return Built(KMeans(**common), geometry.model)


def _bisecting(p: Params) -> Built:
    geometry = GEOMETRIES.get(p.text("geometry", "euclidean"))
    return Built(BisectingKMeans(p.integer("k"), p.integer("maxIter", 20), p.number("eps", 1e-4), p.integer("seed", 42), geometry, p.integer("trials", 1), p.text("select", "cost")), geometry.model)


def _distance(p: Params) -> Metric:
    return DISTANCES.get(p.text("distance"))


def _local(solver: str) -> Callable[[Params], Built]:
    def make(p: Params) -> Built:
        metric = _distance(p)
        return Built(LocalMedoids(p.integer("k"), metric, p.integer("maxIter", 100), p.integer("seed", 42), solver), metric)

    return make


def _sampled(p: Params) -> dict:
    return {"num_samples": p.integer("numSamples", 5), "sample_size": p.integer("sampleSize", 1000), "max_iter": p.integer("maxIter", 100), "inner": p.text("inner", "fastpam").lower(), "seed": p.integer("seed", 42)}


def _clara(p: Params) -> Built:
    metric = _distance(p)
    return Built(Clara(p.integer("k"), metric, **_sampled(p)), metric)


def _pamae(p: Params) -> Built:
    metric = _distance(p)
    return Built(Pamae(p.integer("k"), metric, **_sampled(p), refine_iters=p.integer("refineIters", 1), pool_size=p.integer("poolSize", 2000)), metric)


def _distfastpam(p: Params) -> Built:
    metric = _distance(p)
    return Built(DistributedFastPAM(p.integer("k"), metric, p.integer("maxIter", 100)), metric)


def _dbscanpp(p: Params) -> Built:
    metric = _distance(p)
    return Built(DBSCANpp(p.number("eps"), p.number("minPts"), p.number("coreSampleFraction"), metric, p.text("assign", "eps").lower(), p.integer("chunkSize", 100_000), p.text("sampling", "uniform").lower(), p.integer("seed", 42)), metric)


ALGORITHMS: NamedRegistry[Callable[[Params], Built]] = NamedRegistry(
    "algorithm",
    {"kmeans": _kmeans, "bisectingkmeans": _bisecting, "fastpam": _local("fastpam"), "fasterpam": _local("fasterpam"), "distfastpam": _distfastpam, "clara": _clara, "pamae": _pamae, "dbscanpp": _dbscanpp},
)


def _synthetic(spark: SparkSession, p: Params) -> PointSet:
    return synthetic(spark, p.integer("numPoints"), p.integer("numPartitions", 8), p.integer("seed", 42))


def _parquet(spark: SparkSession, p: Params) -> PointSet:
    return read_parquet(spark, p.text("path"), p.text("featureColumnName"), p.text("weightColumn", None), p.text("idColumn", None), p.number("sampleFraction", 1.0), p.integer("seed", 42), p.integer("numPartitions", None))


SOURCES: NamedRegistry[Callable[[SparkSession, Params], PointSet]] = NamedRegistry("data source", {"synthetic": _synthetic, "parquet": _parquet})
