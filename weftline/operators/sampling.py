"""Samples that depend on seed and content, not on partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import randomness
from ..functions.vectors import is_finite
from ..sources.points import PointSet, matrix, unpack

#: Samples up to this size are cut by one sort; larger ones by a histogram of 2^SLOT_BITS slices.
SORTED_ROWS = 100_000
SLOT_BITS = 16


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) from a seed and key columns."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(int(seed)), *keys), 11).cast("double") * F.lit(2.0**-53)).cast("double")


def bernoulli(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    return df if fraction >= 1 else df.filter(uniform(seed, "rid") < fraction)


def exact_sample(df: DataFrame, m: int, seed: int) -> DataFrame:
    """m rows uniformly at random, by the order of a hash of (seed, rid).

    Beyond ``SORTED_ROWS`` a histogram of the hash's range tells which slices are in as a whole; only the
    last one is sorted, so that no task holds the sample.
    """
    key = F.xxhash64(F.lit(int(seed)), "rid")
    if m <= SORTED_ROWS:
        return df.orderBy(key, "rid").limit(m)
    slot, left = F.shiftright(key, 64 - SLOT_BITS), m
    for row in df.groupBy(slot.alias("slot")).count().orderBy("slot").collect():
        if row["count"] >= left:
            break
        left -= row["count"]
    else:
        return df
    return df.filter(slot < row["slot"]).unionByName(df.filter(slot == row["slot"]).orderBy(key, "rid").limit(left))


def streams(df: DataFrame, probabilities: list[float], seed: int) -> DataFrame:
    """Several independent Bernoulli draws in one pass: each row once for every stream that takes it."""
    ps = F.array(*[F.lit(float(p)) for p in probabilities])
    taken = F.filter(F.sequence(F.lit(0), F.lit(len(probabilities) - 1)), lambda s: uniform(seed, s, "rid") < ps[s])
    return df.withColumn("stream", F.explode(taken))


def draw_samples(points: PointSet, targets: list[int], n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """One pass: for each target size a sample (rid, features, weight), shuffled by seed + its number, cut to size if larger.

    The driver receives about 1.3 times the sum of the targets.
    """
    ps = [randomness.inclusion_probability(t, n) for t in targets]
    table = streams(points.df.select("rid", "features", "weight"), ps, seed).orderBy("stream", "rid").select("rid", "features", "weight", "stream").toArrow()
    rid, x, w = unpack(table.column(0), table.column(1), table.column(2))
    stream = table.column(3).to_numpy()
    out = []
    for s, target in enumerate(targets):
        own = np.flatnonzero(stream == s)
        order = np.array(randomness.permutation(len(own), seed + s)[:target], int)
        own = own[order] if len(own) else own
        out.append((rid[own], x[own], w[own]))
    return out


def content_uniform(df: DataFrame, seed: int, out: str = "u") -> DataFrame:
    """Append a number in [0, 1) computed from the bits of each row's coordinates and weight."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])
    f, w = df.columns.index("features"), df.columns.index("weight")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = randomness.row_uniform(matrix(batch.column(f)), batch.column(w).to_numpy(), seed) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(u)], [*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def mass_proportional(labelled: DataFrame, sample_size: int, total_mass: float, seed: int) -> DataFrame:
    """Rows drawn in proportion to their weight, as copies of weight 1.

    floor(w·rate) copies and one more with the fractional probability, ``sample_size`` at most; a
    rate that is no number passes each row as it is. Noise and weights that are not positive are skipped.
    """
    rate = sample_size / total_mass if total_mass else float("nan")
    rows = labelled.filter((F.col("label") != -1) & is_finite(F.col("weight")) & (F.col("weight") > 0))
    if not np.isfinite(rate):
        return rows
    expected = F.col("weight") * F.lit(float(rate))
    copies = F.least(F.floor(expected) + F.when(F.col("u") < expected - F.floor(expected), 1).otherwise(0), F.lit(int(sample_size)))
    drawn = content_uniform(rows, seed).withColumn("copies", copies).filter("copies > 0")
    return drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).withColumn("weight", F.lit(1.0)).drop("u", "copies", "copy")
