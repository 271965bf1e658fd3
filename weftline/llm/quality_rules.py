"""Quality rules: counted rules, and a calibrated logistic regression over hashed n-grams.

The counts (words, symbols, repeated lines and five-word windows) come from byte arrays of whole
chunks. The classifier's features are hashed words, word pairs and n-grams of three and five
characters, each as its share of the text's n-grams; it learns from a bounded sample of labelled
rows, its probabilities are calibrated on a fold of them that the weights have not seen, and a
document is kept at a fixed threshold.

Defined cases: a null text is an empty one: no words, so the base rules reject it; repeated rows
are judged alike; without any labelled row (or with one class alone) the classifier keeps all; ids
are of any type, labels that contradict each other on one id count as 1; other columns stay, those
named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import Spans, Utf8, Words, bounded_sample, chunks, cut, hash_fraction, held_out, segment_sums, table_path, with_columns

BINS = 1 << 15
#: Labelled rows that learning uses at most (about).
LEARN_ROWS = 4_000
#: A document is kept if its calibrated probability of good quality is this or more.
KEEP_AT = 0.3
_SYMBOL = np.zeros(256, np.int8)
_SYMBOL[list(b"#*$%&|<>")] = 1
LEAST_WORDS, MOST_REPEATED = 10, 20
WINDOW = 5
SIZES = (3, 5)  # characters
PARTS = 4  # word, word pair, 3 characters, 5 characters
SLICE = 1 << 20  # characters that features are made of at once
#: Shards of the learning rows, rounds of mixing their weights, and steps of each shard in a round.
SHARDS, MIXES, STEPS = 4, 6, 30


def _repeats(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is a later copy, has a copy) for each item, within its text. Items are in text order."""
    with np.errstate(over="ignore"):
        key = keys ^ (doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    later, copied = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:][same]] = True
    copied[order[1:][same]] = True
    copied[order[:-1][same]] = True
    return later, copied


class Measured:
    """The counts of one chunk of texts."""

    def __init__(self, texts: pa.Array):
        self.utf8 = u = Utf8(texts)
        self.words = w = Words(u)
        self.n_words = w.counts.astype(np.int64)
        heads = w.in_word & ((u.data & 0xC0) != 0x80)
        self.word_chars = segment_sums(heads.view(np.int8), u.offsets)
        self.n_symbols = segment_sums(_SYMBOL[u.data], u.offsets)
        self.spans = Spans(u.data)
        self.hashes = self.spans.of(w.starts, w.ends) if len(w.starts) else np.zeros(0, np.uint64)
        self.n_dup_lines = self._lines()
        grams, first = w.windows(self.hashes, WINDOW)
        doc = np.searchsorted(w.first, first, "right") - 1
        _, copied = _repeats(grams, doc)
        mark = np.zeros(len(self.hashes) + WINDOW + 1, np.int64)
        at = first[copied]
        mark[: len(self.hashes) + 1] += np.bincount(at, minlength=len(self.hashes) + 1)
        ends = np.bincount(at + WINDOW, minlength=len(mark))
        inside = np.cumsum(mark - ends[: len(mark)])[: len(self.hashes)] > 0
        self.n_repeat_words = segment_sums(inside.view(np.int8), w.first)

    def _lines(self) -> np.ndarray:
        u, w = self.utf8, self.words
        breaks = np.flatnonzero(u.data == 10)
        starts = np.concatenate([u.offsets[:-1], breaks + 1])
        ends = np.concatenate([breaks, u.offsets[1:]])
        starts.sort()
        ends.sort()
        # a line break that ends a text and the text's own end share a position: order keeps pairs right
        with_word = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
        starts, ends = starts[with_word], ends[with_word]
        doc = u.doc_of(starts)
        later, _ = _repeats(self.spans.of(starts, ends), doc) if len(starts) else (np.zeros(0, bool), None)
        return np.bincount(doc[later], minlength=u.n).astype(np.int64)

    def base_failed(self) -> np.ndarray:
        return (self.n_words < LEAST_WORDS) | (100 * self.n_repeat_words > MOST_REPEATED * self.n_words)

    def features(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(part, bins of its n-grams in text order, offsets of the texts), characters in slices of bounded length."""
        w, u, shift = self.words, self.utf8, np.uint64(64 - 15)
        pairs, first = w.windows(self.hashes, 2)
        yield 0, self.hashes >> shift, w.first
        yield 1, pairs >> shift, np.searchsorted(first, w.first)
        heads = np.flatnonzero((u.data & 0xC0) != 0x80)
        ends = np.searchsorted(heads, u.offsets)  # characters before each text
        padded = np.concatenate([u.data, np.zeros(3, np.uint8)])
        for s in range(0, len(heads), SLICE):
            at = heads[s : s + SLICE + max(SIZES) - 1]
            # a character as its UTF-8 bytes in one number
            code, more = padded[at].astype(np.uint64), np.ones(len(at), bool)
            for k in range(1, 4):
                more &= (padded[at + k] & 0xC0) == 0x80
                code |= np.where(more, padded[at + k], np.uint8(0)).astype(np.uint64) << np.uint64(8 * k)
            left = np.repeat(ends[1:], np.diff(ends))[s : s + SLICE] - np.arange(s, min(s + SLICE, len(heads)))  # characters to the end of the text
            h = np.zeros(len(at), np.uint64)
            for k in range(max(SIZES)):
                with np.errstate(over="ignore"):
                    h = h[: len(at) - k] * np.uint64(0x9E3779B97F4A7C15) + code[k:]
                    if k + 1 in SIZES:
                        inside = np.flatnonzero(left[: len(h)] > k)
                        mixed = h[inside] ^ (h[inside] >> np.uint64(29))
                        yield 2 + SIZES.index(k + 1), (mixed * np.uint64(0xBF58476D1CE4E5B9)) >> shift, np.searchsorted(inside, np.clip(ends - s, 0, len(left)))


@dataclass
class QualityModel:
    weights: np.ndarray | None  # PARTS x BINS
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, m: Measured) -> np.ndarray:
        sums, n = np.zeros((PARTS, m.utf8.n)), np.zeros((PARTS, m.utf8.n))
        for part, bins, offsets in m.features():
            sums[part] += segment_sums(self.weights[part][bins].astype(np.float64), offsets)
            n[part] += np.diff(offsets)
        return self.bias + (sums / np.maximum(n, 1)).sum(0)

    def probability(self, m: Measured) -> np.ndarray:
        """The calibrated probability of good quality."""
        if self.weights is None:
            return np.ones(m.utf8.n)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(m) + self.shift, -60, 60)))


def _sparse_rows(m: Measured) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct bins (of all parts) and their shares of the part's n-grams."""
    rows: list[list] = [[] for _ in range(m.utf8.n)]
    n = np.zeros((PARTS, m.utf8.n))
    for part, bins, offsets in m.features():
        n[part] += np.diff(offsets)
        for i in np.flatnonzero(np.diff(offsets)).tolist():
            at, many = np.unique(bins[offsets[i] : offsets[i + 1]], return_counts=True)
            rows[i].append((at.astype(np.int64) + part * BINS, many))
    out = []
    for i, r in enumerate(rows):
        at, many = (np.concatenate(x) for x in zip(*r, strict=True)) if r else (np.zeros(0, np.int64), np.zeros(0))
        at, where = np.unique(at, return_inverse=True)  # slices of one text share bins
        share = np.bincount(where, many, len(at)) / np.maximum(n[at // BINS, i], 1)
        out.append((at.astype(np.int32), share.astype(np.float32)))
    return out


def fit_logistic(index: np.ndarray, value: np.ndarray, offsets: np.ndarray, y: np.ndarray, size: int, scale: float = 30.0, rounds: int = 120, ridge: float = 1e-4, start: tuple[np.ndarray, float] | None = None, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression on sparse rows, by full-batch Adam; deterministic. ``start``: weights and bias to begin with."""
    w, b = (start[0] / scale, start[1]) if start else (np.zeros(size), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))
    # the entries row by row and column by column, in single precision: sums need no copies
    value = value.astype(np.float32) * np.float32(scale)
    full = np.flatnonzero(np.diff(offsets) > 0)
    order = np.argsort(index, kind="stable")
    columns, at = np.unique(index[order], return_index=True)
    by_column, row = value[order], np.repeat(np.arange(len(y), dtype=np.int32), np.diff(offsets))[order]
    del order
    first, second, fb, sb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.full(len(y), b)
        if len(full):
            z[full] += np.add.reduceat(value * w.astype(np.float32)[index], offsets[:-1][full])
        e = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / len(y)
        g = ridge * w
        if len(columns):
            g[columns] += np.add.reduceat(by_column * e.astype(np.float32)[row], at)
        gb = e.sum()
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        fb, sb = 0.9 * fb + 0.1 * gb, 0.999 * sb + 0.001 * gb * gb
        step = rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w = w - step * first / (np.sqrt(second) + 1e-10)
        b -= step * fb / (np.sqrt(sb) + 1e-10)
    return w * scale, b


def calibrate(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through unseen raw scores (Newton steps, smoothed targets)."""
    up, down = y.sum(), len(y) - y.sum()
    if not up or not down:
        return 1.0, 0.0
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * raw + c, -60, 60)))
        s = p * (1 - p) + 1e-9
        ga, gc = ((p - target) * raw).sum() + 1e-3 * (a - 1), (p - target).sum() + 1e-3 * c
        haa, hac, hcc = (s * raw * raw).sum() + 1e-3, (s * raw).sum(), s.sum() + 1e-3
        det = haa * hcc - hac * hac
        da, dc = (hcc * ga - hac * gc) / det, (haa * gc - hac * ga) / det
        step = min(1.0, 2.0 / max(abs(da), abs(dc), 1e-12))
        a, c = a - step * da, c - step * dc
        if abs(da) + abs(dc) < 1e-9:
            break
    return float(a), float(c)


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", rows: int = LEARN_ROWS) -> QualityModel:
    """Learn from at most about ``rows`` labelled documents, of both classes alike where there are enough; a fifth of them calibrates.

    The sample's features are a table in ``SHARDS`` shards. In each of ``MIXES`` rounds a task fits each shard
    from the common weights on, and the mean of what they find is the next common weights: the driver sees
    weights and scores, never features.
    """
    of = lambda df, *more: df.select(F.col(f"`{doc_id}`").alias("i"), *more)
    y = of(labels, F.col(f"`{label}`").alias("y")).filter("i is not null and y is not null").groupBy("i").agg(F.max("y").cast("int").alias("y"))
    halves = [bounded_sample(y.filter(F.col("y") == k), "i", rows // 2) for k in (0, 1)]
    chosen = halves[0].unionByName(halves[1])  # bounded by ``rows``: may be broadcast
    used = of(docs, F.col(f"`{text}`").alias("t")).join(F.broadcast(chosen), "i").select("i", "y", "t", F.xxhash64("i", "t").alias("h"))
    n = used.select("i").count()
    if n > 2 * rows:  # ids that repeat: their documents are thinned
        used = used.filter(hash_fraction("h") < 2 * rows / n)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column(2)):
                part = batch.slice(a, b - a)
                made = _sparse_rows(Measured(part.column(2)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x.tobytes() for x, _ in made], pa.binary()), pa.array([v.tobytes() for _, v in made], pa.binary())], ["h", "y", "x", "v"])

    cases = cut(used.select("h", "y", F.col("t").cast("string").alias("t")).mapInArrow(rows_of, "h long, y int, x binary, v binary").withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(SHARDS)).cast("int")).withColumn("unseen", F.pmod(F.xxhash64(F.lit("fold"), "h"), F.lit(5)) == 0))
    seen = {r["y"]: r["n"] for r in cases.filter("not unseen").groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(seen) < 2:
        return QualityModel(None)
    # as many shards as give each some rows of either class
    shards = max(1, min(SHARDS, min(seen.values()) // 50))
    dealt = cut(cases.filter("not unseen").withColumn("shard", F.pmod("shard", F.lit(shards))).repartition(shards, "shard").sortWithinPartitions("shard", "h", "x"))
    weights, bias = np.zeros(PARTS * BINS), float(np.log(seen[1] / seen[0]))
    spark = docs.sparkSession
    for t in range(MIXES):
        common = spark.sparkContext.broadcast((weights.astype(np.float32), bias))
        found = dealt.select("shard", "y", "x", "v", "h").groupBy("shard").applyInArrow(_shard_fit(common, 0.1 / (1 + t)), "shard int, n long, w binary, b double").toArrow().to_pylist()
        total = sum(r["n"] for r in found)
        parts = sorted(found, key=lambda r: r["shard"])
        weights = sum(r["n"] / total * np.frombuffer(r["w"], np.float32).astype(float) for r in parts)
        bias = sum(r["n"] / total * r["b"] for r in parts)
        common.unpersist()
    shared = spark.sparkContext.broadcast(weights)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [float(shared.value[np.frombuffer(x, np.int32)] @ np.frombuffer(v, np.float32)) for x, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.float64())], ["y", "raw"])

    kept_out = cases.filter("unseen").select("y", "x", "v").mapInArrow(scores, "y int, raw double").toArrow()
    good, raw = kept_out.column("y").to_numpy().astype(float), kept_out.column("raw").to_numpy()
    order = np.lexsort((raw, good))
    slope, shift = calibrate(bias + raw[order], good[order])
    return QualityModel(weights.reshape(PARTS, BINS).astype(np.float32), bias, slope, shift)


def _shard_fit(common, rate: float):
    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("x", "ascending")])
        index = [np.frombuffer(x, np.int32) for x in table.column("x").to_pylist()]
        value = np.concatenate([np.frombuffer(v, np.float32) for v in table.column("v").to_pylist()])
        offsets = np.cumsum([0, *map(len, index)])
        w, b = fit_logistic(np.concatenate(index), value, offsets, table.column("y").to_numpy().astype(float), PARTS * BINS, rounds=STEPS, start=(common.value[0].astype(float), common.value[1]), rate=rate)
        return pa.table({"shard": table.column("shard").slice(0, 1), "n": pa.array([table.num_rows], pa.int64()), "w": pa.array([w.astype(np.float32).tobytes()], pa.binary()), "b": pa.array([b])})

    return fit


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField("base_failed", T.BooleanType()), T.StructField("quality", T.DoubleType()), T.StructField("kept", T.BooleanType())])


def judge_quality(df: DataFrame, model: QualityModel, text: str = "text", keep_at: float = KEEP_AT, keep: list[str] | None = None) -> DataFrame:
    """``df`` with the counts, base_failed, quality (calibrated probability) and kept."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def kernel(texts: pa.Array) -> list[pa.Array]:
            m = Measured(texts)
            failed, p = m.base_failed(), model.probability(m)
            return [*[pa.array(getattr(m, c)) for c in COUNTS], pa.array(failed), pa.array(p), pa.array(~failed & (p >= keep_at))]

        return kernel

    return with_columns(df, text, SCHEMA, make, keep=keep)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table_path(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table_path(spark, sf_dir, "labels").filter(~held_out("doc_id"))
    model = learn(docs, labels)
    return judge_quality(docs, model, keep=["doc_id"]).select("doc_id", *COUNTS, "base_failed", "kept", F.col("quality").alias("p_quality"))


def brute_force(text: str | None) -> dict:
    """The counts of one text, straight from their definitions."""
    import re
    from collections import Counter

    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[i : i + WINDOW]) for i in range(len(words) - WINDOW + 1)]
    n = Counter(windows)
    inside = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(WINDOW)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": dup, "n_repeat_words": len(inside), "base_failed": len(words) < LEAST_WORDS or 100 * len(inside) > MOST_REPEATED * len(words)}
