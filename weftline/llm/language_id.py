"""Language identification: multinomial naive Bayes over hashed character n-grams.

Learning counts n-grams of one to four lower-case characters in ``BINS`` bins for each language, in
tasks, summed by a grouped aggregation (at most languages x BINS numbers reach the driver). The
matrix of log-probabilities is broadcast; texts are scored in Arrow batches by gathering the
matrix rows of their n-grams and summing them text by text in numpy.

Defined cases: ``und`` with score 0 if the text is null or holds no letter (Unicode category L), or
if nothing could be learned; ties go to the language that sorts first; repeated rows are scored
alike; rows with a null id are never learned from and count as not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import hash_fraction, held_out, table_path, with_columns

BINS = 1 << 16
SIZES = (1, 2, 3, 4)
#: Labelled rows of each language that learning uses at most (about; all, if there are fewer).
LEARN_ROWS = 8_000
#: Characters that are worked on at once.
PIECE = 256_000
_GAP = "\0" * (max(SIZES) - 1)
_LETTER = regex.compile(r"\p{L}")


def character_bins(texts: list[str], bins: int = BINS) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each n-gram size the bin at every character, and the texts' first and last positions."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer((_GAP.join(low) + _GAP).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, low), np.int64, len(low))
    starts = np.cumsum(lengths + len(_GAP)) - lengths - len(_GAP)
    shift = np.uint32(32 - (bins.bit_length() - 1))
    out, n = [], len(codes) - len(_GAP)
    h = np.zeros(max(n, 0), np.uint32)
    for k in range(max(SIZES)):
        h = (h + codes[k : k + len(h)] + np.uint32(k + 1)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if k + 1 in SIZES:
            out.append((h * np.uint32(0x85EBCA6B)) >> shift)
    return out, starts, lengths


def pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most PIECE characters together, one text at least."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > PIECE:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def _inside(starts: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """Interleaved (first, past last) positions of the n-grams that lie wholly inside each text."""
    edges = np.empty(2 * len(starts), np.int64)
    edges[0::2] = starts
    edges[1::2] = starts + np.maximum(lengths - size + 1, 0)
    return edges


@dataclass
class LanguageModel:
    languages: list[str]
    log_probs: np.ndarray  # BINS x languages, float32
    prior: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log-probability of each text under each language, up to a constant; in pieces of bounded length."""
        return np.concatenate([self._scores(texts[a:b]) for a, b in pieces(texts)])

    def _scores(self, texts: list[str]) -> np.ndarray:
        out = np.tile(self.prior, (len(texts), 1))
        bins, starts, lengths = character_bins(texts)
        for size, b in zip(SIZES, bins, strict=True):
            edges = _inside(starts, lengths, size)
            picked = self.log_probs[b]
            full = edges[1::2] > edges[0::2]
            if full.any():
                flat = np.empty(2 * int(full.sum()), np.int64)
                flat[0::2], flat[1::2] = edges[0::2][full], edges[1::2][full]
                last = flat[-1] == len(picked)
                sums = np.add.reduceat(picked, flat[:-1] if last else flat, axis=0, dtype=np.float64)[0::2]
                out[full] += sums
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        found = [t is not None and bool(_LETTER.search(t)) for t in texts]
        names, score = ["und"] * len(texts), np.zeros(len(texts))
        at = np.flatnonzero(found)
        if len(at) and self.languages:
            s = self.scores([texts[i] for i in at])
            best = s.argmax(1)
            score[at] = 1 / np.exp(s - s.max(1, keepdims=True)).sum(1)
            for i, b in zip(at.tolist(), best.tolist(), strict=True):
                names[i] = self.languages[b]
        return names, score


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", rows: int = LEARN_ROWS) -> LanguageModel:
    """Learn from rows with a text and a language; ``rows`` bounds how many of each language are used, chosen by the hash of the id."""
    known = labelled.select(F.col(doc_id).alias("i"), F.col(lang).alias("l"), F.col(text).alias("t")).filter("t is not null and l is not null")
    sizes = known.groupBy("l").agg(F.count("*").alias("n"))  # a row for each language, as the model's matrix has a column
    used = known.join(F.broadcast(sizes), "l").filter((F.col("n") <= rows) | (hash_fraction("i") * F.col("n") < rows)).select("l", "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            texts = batch.column(1).to_pylist()
            for name in dict.fromkeys(langs.tolist()):
                own = [texts[i] for i in np.flatnonzero(langs == name)]
                total = sums.setdefault(name, np.zeros(BINS, np.int64))
                for first, last in pieces(own):
                    bins, starts, lengths = character_bins(own[first:last])
                    for size, b in zip(SIZES, bins, strict=True):
                        mark = np.zeros(len(b) + 1, np.int8)
                        edges = _inside(starts, lengths, size)
                        np.add.at(mark, edges[0::2], 1)
                        np.subtract.at(mark, edges[1::2], 1)
                        total += np.bincount(b[np.cumsum(mark[:-1]) > 0], minlength=BINS)
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at, pa.int32()), pa.array(total[at])], ["l", "b", "n"])

    found = used.mapInArrow(count, "l string, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["l"].unique().tolist())
    counts = np.zeros((BINS, len(languages)))
    for k, name in enumerate(languages):
        own = found[found["l"] == name]
        counts[own["b"].to_numpy(), k] = own["n"].to_numpy()
    smooth = counts + 0.05
    return LanguageModel(languages, np.log(smooth / smooth.sum(0)).astype(np.float32), np.zeros(len(languages)))


def identify_languages(df: DataFrame, model: LanguageModel, text: str = "text", names: tuple[str, str] = ("lang_pred", "score"), keep: list[str] | None = None) -> DataFrame:
    """``df`` with the predicted language and its posterior probability (uniform prior)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def make():
        m = shared.value

        def kernel(texts: pa.Array) -> list[pa.Array]:
            lang, score = m.predict(texts.to_pylist())
            return [pa.array(lang, pa.string()), pa.array(score)]

        return kernel

    return with_columns(df, text, schema, make, keep=keep)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table_path(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.filter(F.col("doc_id").isNotNull() & ~held_out("doc_id")))
    return identify_languages(docs.drop("lang"), model, keep=["doc_id"]).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
