"""Weighted points: (rid bigint, features array<double>, weight double), lazily read.

``PointSet`` pairs such a DataFrame with its row count where that is known. Sources that are
derived from another one do not inherit its count.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import randomness

SCHEMA = T.StructType([T.StructField("rid", T.LongType(), False), T.StructField("features", T.ArrayType(T.DoubleType(), False), False), T.StructField("weight", T.DoubleType(), False)])


@dataclass
class PointSet:
    df: DataFrame
    known_count: int | None = None
    label: str = "points"

    def count(self) -> int:
        if self.known_count is None:
            self.known_count = self.df.count()
        return self.known_count

    def persist(self) -> PointSet:
        return PointSet(self.df.persist(StorageLevel.MEMORY_AND_DISK), self.known_count, self.label)

    def unpersist(self) -> None:
        self.df.unpersist()

    def with_features(self, make) -> PointSet:
        return PointSet(self.df.withColumn("features", make(F.col("features"))), None, self.label)

    def collect(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rid, features, weight) on the driver, by rid; for bounded inputs."""
        table = self.df.select("rid", "features", "weight").orderBy("rid").toArrow()
        return unpack(table.column(0), table.column(1), table.column(2))

    def take_first(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        table = self.df.select("rid", "features", "weight").orderBy("rid").limit(n).toArrow()
        return unpack(table.column(0), table.column(1), table.column(2))

    def rows(self) -> Iterator:
        """A stream of rows to the driver, one partition at a time."""
        return self.df.toLocalIterator(prefetchPartitions=True)

    def dimension(self) -> int | None:
        first = self.df.select(F.size("features").alias("d")).first()
        return None if first is None else first["d"]


def matrix(features) -> np.ndarray:
    """A list<double> array as a dense matrix."""
    if isinstance(features, pa.ChunkedArray):
        features = features.combine_chunks()
    n = len(features)
    return np.asarray(features.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def unpack(rid, features, weight) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.asarray(rid.to_numpy(zero_copy_only=False) if isinstance(rid, pa.Array) else rid.to_numpy()), matrix(features), np.asarray(weight.to_numpy(zero_copy_only=False) if isinstance(weight, pa.Array) else weight.to_numpy(), np.float64)


def from_rows(spark: SparkSession, features, weights=None, partitions: int | None = None) -> PointSet:
    """Points from driver rows, numbered in their order."""
    rows = [(i, [float(x) for x in f], 1.0 if weights is None else float(weights[i])) for i, f in enumerate(features)]
    df = spark.createDataFrame(rows, SCHEMA)
    return PointSet(df.repartition(partitions) if partitions else df, len(rows), "rows")


def from_dataframe(df: DataFrame, features: str, weight: str | None = None, rid: str | None = None, label: str = "dataframe") -> PointSet:
    """Points from any DataFrame, checked as :func:`read_parquet` checks; without ``rid`` rows are numbered by partition and place in it."""
    columns = {f.name: f.dataType for f in df.schema.fields}
    for role, name in (("feature", features), ("weight", weight)):
        if name is not None and name not in columns:
            raise ValueError(f"no {role} column '{name}'; columns: {', '.join(columns)}")
    number = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType)
    kind = columns[features]
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, number):
        raise ValueError(f"feature column '{features}' must be an array of numbers, not {kind.simpleString()}")
    if weight is not None and not isinstance(columns[weight], number):
        raise ValueError(f"weight column '{weight}' must be a number, not {columns[weight].simpleString()}")
    bad = F.col(features).isNull() | F.exists(F.col(features), lambda x: x.isNull())
    vector = F.when(bad, F.raise_error(F.lit(f"null in feature column '{features}'")).cast("array<double>")).otherwise(F.col(features).cast("array<double>"))
    mass: Column = F.lit(1.0)
    if weight is not None:
        mass = F.when(F.col(weight).isNull(), F.raise_error(F.lit(f"null in weight column '{weight}'")).cast("double")).otherwise(F.col(weight).cast("double"))
    key = F.col(rid).cast("long") if rid is not None else F.monotonically_increasing_id()
    return PointSet(df.select(key.alias("rid"), vector.alias("features"), mass.alias("weight")), None, label)


def read_parquet(spark: SparkSession, path: str, features: str, weight: str | None = None, rid: str | None = None, sample_fraction: float = 1.0, seed: int = 42, partitions: int | None = None) -> PointSet:
    """Points from a Parquet file or folder (hidden files are skipped); numbers are widened to double.

    A sample goes by the hash of seed, file and row's place in its file: the same rows however the files are split.
    """
    df = spark.read.parquet(path)
    if not 0 < sample_fraction <= 1:
        raise ValueError("sampleFraction must be in (0, 1]")
    if sample_fraction < 1:
        place = F.xxhash64(F.lit(int(seed)), F.col("_metadata.file_name"), F.col("_metadata.row_index"))
        df = df.filter(F.shiftrightunsigned(place, 11).cast("double") * 2.0**-53 < sample_fraction)
    points = from_dataframe(df, features, weight, rid, path)
    return PointSet(points.df.repartition(partitions), None, path) if partitions else points


def synthetic(spark: SparkSession, n: int, partitions: int = 8, seed: int = 42) -> PointSet:
    """The five-mode mixture; row i is the same on every partitioning."""

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = batch.column(0).to_numpy()
            made = randomness.mixture_points(index, seed)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, made.size + 1, 3), pa.int32()), pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors, pa.array(np.ones(len(index)))], ["rid", "features", "weight"])

    return PointSet(spark.range(0, n, 1, partitions).mapInArrow(generate, SCHEMA), n, "synthetic")


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir, which all executors share; Hadoop deletes it when the driver ends.

    In local mode a folder of this machine will do where the setting is missing; on a cluster that is an error.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/weftline-checkpoints"
    folder = f"{base.rstrip('/')}/points-{context.applicationId}"
    if folder not in _ends_with_driver:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(where)
        files.deleteOnExit(where)
        _ends_with_driver.add(folder)
    return folder


_ends_with_driver: set[str] = set()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: short lineage and true sizes for the planner."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class Materialized:
    """A written copy of a source, with the count taken while it was written."""

    points: PointSet
    path: str

    def delete(self) -> None:
        """Remove the copy; best effort."""
        spark = self.points.df.sparkSession
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(self.path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception as error:  # noqa: BLE001  a leftover copy harms nothing
            print(f"could not delete {self.path}: {error}")


def materialize(points: PointSet, folder: str) -> Materialized:
    """Write the points once as Parquet under ``folder`` and count them on the way."""
    from pyspark.sql import Observation

    path, seen = f"{folder.rstrip('/')}/points-{uuid.uuid4().hex}", Observation()
    points.df.select("rid", "features", "weight").observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    n = seen.get["n"]
    return Materialized(PointSet(points.df.sparkSession.read.parquet(path), n, points.label), path)
