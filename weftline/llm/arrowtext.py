"""Arrow helpers shared by the text operators: bounded chunks, byte views, hashed words.

Every operator works through :func:`with_columns`, which keeps all input columns and rows,
appends the operator's own columns and never needs more than a bounded chunk of text in memory
besides the batch that Spark hands over.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that one kernel call sees at most (a single longer text is one call).
CHUNK_BYTES = 2 << 20
#: [\x20\x09-\x0D]
SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


def drop_clashing(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without columns whose names equal one of ``names`` (case-insensitively)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start, n = 0, len(texts)
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield start, stop
        start = stop


def with_columns(df: DataFrame, text: str, schema: T.StructType, make_kernel: Callable[[], Callable], keep: list[str] | None = None, extra: list[str] = ()) -> DataFrame:
    """Append the columns of ``schema``, computed from the column ``text`` in Arrow batches.

    ``make_kernel()`` runs once in each task and returns ``kernel(texts, *extra) -> list of arrays``;
    ``texts`` is a string array (nulls stay nulls). ``keep`` names the columns to carry (default: all).
    Input columns with the names of new ones are replaced.
    """
    names = [f.name for f in schema.fields]
    carried = drop_clashing(df.select(*[F.col(f"`{c}`") for c in keep]) if keep is not None else df, names)
    fields = carried.schema.fields
    source = df.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(fields)], F.col(f"`{text}`").cast("string").alias("t"), *[F.col(f"`{x}`").alias(f"x{i}") for i, x in enumerate(extra)])
    out = T.StructType([T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate(fields)] + [T.StructField(f"n{i}", f.dataType, True) for i, f in enumerate(schema.fields)])
    n_carried, n_extra = len(fields), len(extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kernel, arrow = make_kernel(), to_arrow_schema(out)
        for batch in batches:
            texts = batch.column(n_carried)
            for start, stop in chunks(texts):
                part = batch.slice(start, stop - start)
                made = kernel(part.column(n_carried), *[part.column(n_carried + 1 + i) for i in range(n_extra)])
                columns = [part.column(i) for i in range(n_carried)] + list(made)
                yield pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(columns, arrow, strict=True)], schema=arrow)

    done = source.mapInArrow(run, out)
    return done.toDF(*[f.name for f in fields], *names)


def held_out(doc_id: Column | str) -> Column:
    """crc32 of the id as text, mod 4, is 2; false for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def hash_fraction(doc_id: Column | str) -> Column:
    """A reproducible number in [0, 1) of each id, the same on every partitioning."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.pmod(F.xxhash64(F.lit("sample"), c), F.lit(1 << 30)) / F.lit(float(1 << 30))).cast("double")


def bounded_sample(df: DataFrame, doc_id: str, bound: int) -> DataFrame:
    """About ``bound`` rows of ``df`` (all, if it has fewer), chosen by the hash of the id."""
    n = df.select(doc_id).count()
    return df if n <= bound else df.filter(hash_fraction(doc_id) < bound / n)


class Utf8:
    """The texts of an array as one byte array with offsets; null is empty."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        _, offsets, data = texts.buffers()
        n = len(texts)
        ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
        self.offsets = ends - ends[0]
        self.n = n

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, "right") - 1


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values[offsets[i]:offsets[i+1]]`` for each i; empty segments give 0."""
    n = len(offsets) - 1
    out = np.zeros((n, *values.shape[1:]), values.dtype if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full], axis=0, dtype=out.dtype)
    return out


_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("p", ())) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        with np.errstate(over="ignore"):
            for key, base in (("p", _BASE), ("q", pow(_BASE, -1, 1 << 64))):
                a = np.full(size, base, np.uint64)
                a[0] = 1
                _POWERS[key] = np.multiply.accumulate(a)
    return _POWERS["p"], _POWERS["q"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (in place where possible)."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(32))
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


class Spans:
    """64-bit hashes of byte spans of one array, from prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray):
        self.p, self.q = _powers(len(data))
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_CODES[data] * self.p[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[ends] - self.sums[starts]) * self.q[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of all texts of a chunk."""

    def __init__(self, texts: Utf8):
        d, n = texts.data, len(texts.data)
        word = ~_SPACE[d]
        edge = np.zeros(n + 1, bool)
        edge[texts.offsets] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = True, ~word[:-1]
            after[-1], after[:-1] = True, ~word[1:]
            before |= edge[:n]
            after |= edge[1:]
        self.starts = np.flatnonzero(word & before)
        self.ends = np.flatnonzero(word & after) + 1
        self.in_word = word
        #: words of text i are first[i]:first[i + 1]
        self.first = np.searchsorted(self.starts, texts.offsets)
        self.counts = np.diff(self.first)

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each window of ``size`` words inside one text, and the index of its first word."""
        n = len(hashes)
        if n < size:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            total = np.zeros(n - size + 1, np.uint64)
            for k in range(size):
                total = total * np.uint64(0xBF58476D1CE4E5B9) + hashes[k : n - size + 1 + k]
        last = np.repeat(self.first[1:], self.counts)[: n - size + 1]
        inside = np.arange(n - size + 1) + size <= last
        return mix(total[inside]), np.flatnonzero(inside)


def table_path(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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
    folder = f"{base.rstrip('/')}/llm-{context.applicationId}"
    if folder not in _ends_with_driver:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(where)
        files.deleteOnExit(where)
        _ends_with_driver.add(folder)
    return folder


_ends_with_driver: set[str] = set()


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder: short lineage, true sizes for the planner, and no loss with an executor."""
    return cut_at(df)[0]


def cut_at(df: DataFrame) -> tuple[DataFrame, str]:
    """The same with the table's path, for :func:`remove` once nothing reads it any more."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
