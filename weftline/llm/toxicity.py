"""Toxicity: a learned lexicon, misspellings by Levenshtein automata, and context windows.

The lexicon (whole terms and word stems) is learned from labelled rows by document counts. The
Levenshtein automata of all terms are intersected with the lexicon's trie once, by subset
construction, into one deterministic table (terms and stems of ``NEAR_FROM`` letters or more whose
neighbourhood clean documents leave free); all words of a chunk then walk that table together in
numpy. A word next to the lexicon that clean documents use is put into the trie as clean. Each hit
is weighed by its context window: quotation marks around it or words of report speak for quotation,
the second person, exclamation marks and further hits for abuse. A small logistic model on rows
that the lexicon has not seen turns the sums into a probability.

Defined cases: a null text is an empty one and gets the score of a text without hits; without
labelled rows of both classes the score is 0 everywhere; labels that contradict each other on one
id count as 1; ids are of any type; repeated rows are scored alike; other columns stay, those named
like an output column are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import bounded_sample, chunks, hash_fraction, held_out, table_path, with_columns
from .quality_rules import calibrate, fit_logistic

#: Labelled rows of each class that learning uses at most (about).
LEARN_ROWS = 6_000
#: Terms, and stems, that the lexicon holds at most; letters of a learned word at most (no misspelling automaton is longer).
MOST_TERMS, LONGEST_TERM = 600, 40
#: Words and stems that a task counts before it hands on.
MOST_HELD = 1_000_000
TOXIC_AT = 0.3
FUZZY_FROM = 5  # letters that a term needs before misspellings of it count, where no labels tell more
NEAR_FROM = 4  # the same for learned terms and stems, whose clean neighbours are known
#: Different clean words one edit away beyond which a term or stem is matched to the letter.
CROWDED = 25
STEMS = (4, 5, 6, 7, 8)
WINDOW_WORDS, WINDOW_CHARS = 6, 60
QUOTES = frozenset("\"“”„«»‹›‘’")
#: Words of report and of the second person (fixed word lists).
REPORT = frozenset("said says say quoted quote quotes called calls term word words wrote dit disait mot cité sagte sagt wort zitat nannte dijo dice palabra llamó cita".split())
PERSON = frozenset("you your yours u tu te toi vous votre du dich dir dein ihr euch usted tú vosotros".split())
_WORD = re.compile(r"[^\W_]+")


# ---------------------------------------------------------------- automaton
@dataclass
class Automaton:
    """Deterministic intersection of the lexicon's trie with Levenshtein automata of distance 1."""

    classes: np.ndarray  # code point -> class; 0: no word character, 1: any other one
    step: np.ndarray  # state x class -> state; state 0 is dead, 1 the start
    term: np.ndarray  # state -> term accepted at the end of a word, or -1
    distance: np.ndarray

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first, past last, term, distance) of every accepted word, and the first positions of all words."""
        c = self.classes[codes]
        word = np.zeros(len(c) + 2, np.int8)
        word[1:-1] = c > 0
        change = np.diff(word)
        starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        at, state, k = np.arange(len(starts)), np.ones(len(starts), np.int32), 0
        done_at, done_state = [], []
        while len(at):
            pos = starts[at] + k
            over = pos >= ends[at]
            if over.any():
                done_at.append(at[over])
                done_state.append(state[over])
                at, state, pos = at[~over], state[~over], pos[~over]
            state = self.step[state, c[pos]]
            alive = state > 0
            at, state, k = at[alive], state[alive], k + 1
        at = np.concatenate(done_at) if done_at else np.zeros(0, np.int64)
        state = np.concatenate(done_state) if done_state else np.zeros(0, np.int32)
        good = self.term[state] >= 0
        at, state = at[good], state[good]
        order = np.argsort(at)
        at, state = at[order], state[order]
        return starts[at], ends[at], self.term[state], self.distance[state], starts


def _character_classes(alphabet: dict[str, int]) -> np.ndarray:
    out = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000).astype(np.uint8)
    for ch, k in alphabet.items():
        out[ord(ch)] = k
        if len(ch.upper()) == 1:
            out[ord(ch.upper())] = k
    return out


def build_automaton(terms: list[str], stems: list[str], clean: list[str] = (), firm: set[str] | None = None) -> Automaton:
    """Term numbers: ``terms`` first, then ``stems``. ``clean`` words are never hits.

    Misspellings (one letter put in, left out or changed, or two neighbours swapped) count for terms
    in ``firm`` (default: those of FUZZY_FROM letters or more) and at the head of words for stems in it (default: none).
    """
    fuzzy_terms = {t for t in terms if len(t) >= FUZZY_FROM} if firm is None else firm
    fuzzy_stems = firm or set()
    alphabet = {ch: k + 2 for k, ch in enumerate(sorted(set("".join([*terms, *stems, *clean]))))}
    children: list[dict[int, int]] = [{}]
    ends: list[dict[str, int]] = [{}]  # node -> kind -> term
    longest: list[bool] = [False]  # does a term that allows misspellings lie below?

    def add(word: str, kind: str, number: int, fuzzy: bool) -> None:
        node = 0
        for ch in word:
            longest[node] = longest[node] or fuzzy
            nxt = children[node].get(alphabet[ch])
            if nxt is None:
                nxt = children[node][alphabet[ch]] = len(children)
                children.append({})
                ends.append({})
                longest.append(False)
            node = nxt
        longest[node] = longest[node] or fuzzy
        ends[node].setdefault(kind, number)

    for i, t in enumerate(terms):
        add(t, "term", i, t in fuzzy_terms)
        if t in fuzzy_terms:
            add(t, "fuzzy", i, True)
    for i, t in enumerate(stems):
        add(t, "stem", len(terms) + i, t in fuzzy_stems)
        if t in fuzzy_stems:
            add(t, "near", len(terms) + i, True)
    for t in clean:
        add(t, "clean", -1, False)

    def closed(states: set) -> frozenset:
        out = set(states)
        for node, errors in states:
            if errors == 0:  # a letter left out
                out |= {(child, 1) for child in children[node].values() if longest[child]}
            if errors == 0 and "stem" in ends[node]:
                out.add((ends[node]["stem"], "stem"))
        out |= {(ends[node]["near"], "near") for node, errors in out if errors == 1 and "near" in ends[node]}
        return frozenset(out)

    def accepted(states: frozenset) -> tuple[int, int]:
        exact = [ends[n] for n, e in states if e == 0]
        if any("clean" in x for x in exact):
            return -1, 0
        for x in exact:
            if "term" in x:
                return x["term"], 0
        stem = [n for n, e in states if e == "stem"]
        if stem:
            return min(stem), 0
        near = [ends[n]["fuzzy"] for n, e in states if e == 1 and "fuzzy" in ends[n]] + [n for n, e in states if e == "near"]
        return (min(near), 1) if near else (-1, 0)

    start = closed({(0, 0)})
    number, queue, rows, accepts = {frozenset(): 0, start: 1}, [start], [{}], [(-1, 0)]
    size = len(alphabet) + 2
    for states in queue:
        accepts.append(accepted(states))
        base: set = set()
        by_class: dict[int, set] = {}
        for node, errors in states:
            if errors in ("stem", "near"):
                base.add((node, errors))
                continue
            if isinstance(errors, tuple):  # the second letter of two that are swapped
                by_class.setdefault(errors[1], set()).add((node, 1))
                continue
            if errors == 0:
                base |= {(child, 1) for child in children[node].values() if longest[child]}
                if longest[node]:
                    base.add((node, 1))
            for k, child in children[node].items():
                if errors == 0 or longest[child]:
                    by_class.setdefault(k, set()).add((child, errors))
                if errors == 0:
                    for k2, below in children[child].items():
                        if longest[below] and k2 != k:
                            by_class.setdefault(k2, set()).add((below, ("swap", k)))
        row = {}
        for k in (None, *by_class):
            new = closed(base | by_class.get(k, set()))
            if new not in number:
                number[new] = len(number)
                queue.append(new)
            row[k] = number[new]
        rows.append(row)
    step = np.zeros((len(rows), size), np.int32)
    for i, row in enumerate(rows):
        if row:
            step[i, 1:] = row[None]
            for k, to in row.items():
                if k is not None:
                    step[i, k] = to
    step[:, 0] = 0
    return Automaton(_character_classes(alphabet), step, np.array([t for t, _ in accepts], np.int32), np.array([d for _, d in accepts], np.int8))


# ---------------------------------------------------------------- scoring
@dataclass
class ToxicModel:
    terms: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    clean: list[str] = field(default_factory=list)
    firm: list[str] = field(default_factory=list)  # the terms and stems whose misspellings count
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of each term, then each stem
    weights: np.ndarray | None = None
    bias: float = 0.0
    _automaton: Automaton | None = None

    def automaton(self) -> Automaton:
        if self._automaton is None:
            self._automaton = build_automaton(self.terms, self.stems, self.clean, set(self.firm))
        return self._automaton

    def find(self, texts: list[str]) -> list[list[tuple[int, int, int, int, float]]]:
        """For each text (first, past last, term, distance, how much of the hit is abuse)."""
        codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        first, last, term, distance, words = self.automaton().hits(codes)
        out: list[list[tuple[int, int, int, int, float]]] = [[] for _ in texts]
        doc = np.searchsorted(offsets, first, "right") - 1
        rank = np.searchsorted(words, first)
        for i in range(len(first)):
            d = int(doc[i])
            near = sum(1 for j in (i - 1, i + 1) if 0 <= j < len(first) and doc[j] == d and abs(int(rank[j]) - int(rank[i])) <= WINDOW_WORDS)
            a, b = int(first[i] - offsets[d]), int(last[i] - offsets[d])
            out[d].append((a, b, int(term[i]), int(distance[i]), context(texts[d], a, b, near)))
        return out

    def features(self, texts: list[str]) -> np.ndarray:
        """Sums of exact and of misspelled hits as abuse, and of all hits as quotation, on a log scale."""
        x = np.zeros((len(texts), 3))
        if self.terms or self.stems:
            for i, hits in enumerate(self.find(texts)):
                for _, _, term, distance, abuse in hits:
                    x[i, int(distance > 0)] += self.value[term] * abuse
                    x[i, 2] += self.value[term] * (1 - abuse)
        return np.log1p(x)

    def score(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.weights + self.bias, -60, 60)))


def context(text: str, a: int, b: int, near: int) -> float:
    """Share of abuse (against quotation) of the hit text[a:b], from 0.1 to 1."""
    before, after = text[max(0, a - WINDOW_CHARS) : a], text[b : b + WINDOW_CHARS]
    left, right = _WORD.findall(before.lower())[-WINDOW_WORDS:], _WORD.findall(after.lower())[:WINDOW_WORDS]
    around = (*left, *right)
    quoted = any(c in QUOTES for c in before) and any(c in QUOTES for c in after)
    quote = 2.0 * quoted + 1.0 * any(w in REPORT for w in around)
    abuse = 1.5 + 1.0 * any(w in PERSON for w in around) + 0.5 * ("!" in after) + 0.5 * near
    return max(0.1, abuse / (abuse + quote))


# ---------------------------------------------------------------- learning
def _document_counts(used: DataFrame) -> DataFrame:
    """(kind, word, toxic, clean): in how many documents of each class a word ("w") or stem ("s") occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> Iterator[pa.RecordBatch]:
            keys = list(dict.fromkeys([*seen[1], *seen[0]]))
            for i in range(0, len(keys), 50_000):
                own = keys[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in own]), pa.array([w for _, w in own]), pa.array([seen[1][k] for k in own], pa.int64()), pa.array([seen[0][k] for k in own], pa.int64())], ["kind", "word", "toxic", "clean"])
            for c in seen:
                c.clear()

        for batch in batches:
            for s, e in chunks(batch.column(1)):
                part = batch.slice(s, e - s)
                for y, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = {w for w in _WORD.findall(t.lower()) if len(w) <= LONGEST_TERM}
                    seen[y].update(("w", w) for w in words)
                    seen[y].update({("s", w[:k]) for w in words for k in STEMS if len(w) > k})
            if len(seen[0]) + len(seen[1]) > MOST_HELD:
                yield from out()
        yield from out()

    return used.mapInArrow(count, "kind string, word string, toxic long, clean long").groupBy("kind", "word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _misspelled(words: DataFrame, model: ToxicModel) -> DataFrame:
    """(word, toxic, clean, term): rows of ``words`` that the model's automaton takes for misspellings, and of which term."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            codes = np.frombuffer(("\n".join(own) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
            first, _, term, distance, _ = shared.value.automaton().hits(codes)
            at = np.searchsorted(np.cumsum([0, *(len(w) + 1 for w in own)]), first, "right") - 1
            found = pa.array(at[distance == 1])
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(found) for k in range(3)), pa.array(term[distance == 1], pa.int32())], ["word", "toxic", "clean", "term"])

    return words.select("word", "toxic", "clean").mapInArrow(search, "word string, toxic long, clean long, term int")


def _needed(toxic: DataFrame, words: list, stems: list, least: int, least_sure: int = 2) -> tuple[list, list]:
    """The words and stems that explain toxic documents which better ones don't (greedy, each document up to three times).

    Words that merely share documents with real terms (long documents, copies) drop out here. A word must
    explain ``least`` more documents, ``least_sure`` if its counts are significant.
    """
    number = {r["word"]: k for k, r in enumerate(words)}
    prefix = {r["word"]: len(words) + k for k, r in enumerate(stems)}

    def incidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t in batch.column(0).to_pylist():
                own = set(_WORD.findall(t.lower()))
                found.append(sorted({number[w] for w in own if w in number} | {prefix[w[:k]] for w in own for k in STEMS if len(w) > k and w[:k] in prefix}))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], ["terms"])

    docs = toxic.select("t").mapInArrow(incidence, "terms array<int>").toPandas()["terms"].tolist()  # the sample's rows at most
    has = np.zeros((len(docs), len(words) + len(stems)), bool)
    for i, own in enumerate(docs):
        has[i, list(own)] = True
    worth = np.array([np.log(r["rate"]) for r in [*words, *stems]])
    common = max(8, len(docs) // 10)  # no chance word is in a tenth of all toxic documents
    chosen = [k for k, r in enumerate([*words, *stems]) if r["toxic"] >= common]
    need = 3 - has[:, chosen].sum(1)
    wanted = np.array([least_sure if r["sure"] else least for r in [*words, *stems]])
    while has.shape[1]:
        gain = (has & (need > 0)[:, None]).sum(0)
        gain[chosen] = 0
        gain[gain < wanted] = 0
        best = int((gain * worth).argmax())
        if not gain[best]:
            break
        chosen.append(best)
        need -= has[:, best]
    return [words[k] for k in sorted(chosen) if k < len(words)], [stems[k - len(words)] for k in sorted(chosen) if k >= len(words)]


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", rows: int = LEARN_ROWS) -> ToxicModel:
    """Learn from at most about ``rows`` documents of each class; a third of them fits the final model."""
    y = labels.select(F.col(f"`{doc_id}`").alias("i"), F.col(f"`{label}`").alias("y")).filter("i is not null and y is not null").groupBy("i").agg(F.max("y").cast("int").alias("y"))
    parts = [bounded_sample(y.filter(F.col("y") == k), "i", rows) for k in (0, 1)]
    chosen = parts[0].unionByName(parts[1])  # bounded by 2 x rows: may be broadcast
    used = docs.select(F.col(f"`{doc_id}`").alias("i"), F.col(f"`{text}`").cast("string").alias("t")).filter("t is not null").join(F.broadcast(chosen), "i")
    n_used = used.select("i").count()
    if n_used > 4 * rows:  # ids that repeat: their documents are thinned
        used = used.filter(hash_fraction(F.xxhash64("i", "t")) < 4 * rows / n_used)
    used = used.persist()
    try:
        fold: Column = F.pmod(F.xxhash64(F.lit("fold"), "i"), F.lit(3))
        first, second = used.filter(fold > 0), used.filter(fold == 0)
        n = {r["y"]: r["n"] for r in first.groupBy("y").agg(F.count("*").alias("n")).collect()}
        if not n.get(0) or not n.get(1):
            return ToxicModel()
        counts = _document_counts(first.select("y", "t")).persist()
        rate = F.col("toxic") / n[1] / ((F.col("clean") + 0.5) / (n[0] + 1))
        support, firm = max(3, n[1] // 80), max(4, n[1] // 33)
        # significant: of all words and stems less than one is expected to lean so far to toxic documents by chance
        share, both = n[1] / (n[0] + n[1]), F.col("toxic") + F.col("clean")
        lean = F.col("toxic") * F.log(F.col("toxic") / (both * share)) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (both * (1 - share)))).otherwise(0.0)
        good = counts.filter((F.col("toxic") >= 3) & (rate >= 20)).withColumn("rate", rate).withColumn("sure", lean >= float(np.log(max(2, counts.count()))))
        words = good.filter((F.col("kind") == "w") & (F.col("sure") | (F.col("toxic") >= support))).orderBy(F.desc("toxic"), "word").limit(MOST_TERMS).collect()
        heads = good.filter((F.col("kind") == "s") & (F.col("sure") | (F.col("toxic") >= firm)) & (F.col("clean") * 100 <= F.col("toxic"))).collect()  # words of the sample at most
        known, stems = {r["word"] for r in heads}, []
        for r in sorted(heads, key=lambda r: (-r["toxic"], r["word"])):
            if not any(r["word"][:k] in known for k in STEMS if k < len(r["word"])):
                stems.append(r)
        words, stems = _needed(first.filter("y = 1"), words, stems[:MOST_TERMS], max(2, n[1] // 300))
        # terms that too few documents show are matched to the letter
        near = [r["word"] for r in words if (r["sure"] or r["toxic"] >= max(8, n[1] // 50)) and len(r["word"]) >= NEAR_FROM]
        model = ToxicModel([r["word"] for r in words], [r["word"] for r in stems], firm=[*near, *(r["word"] for r in stems if r["sure"])])
        model.value = np.array([np.log(r["rate"]) for r in [*words, *stems]])
        # words that clean documents use within one edit of a term are no misspellings of it
        if model.firm:
            own = set(model.terms)
            used_words = counts.filter((F.col("kind") == "w") & (F.col("clean") > 0) & (F.col("toxic") / n[1] < 5 * F.col("clean") / n[0]))
            names = [*model.terms, *model.stems]
            crowded = {names[r["term"]] for r in _misspelled(used_words, model).groupBy("term").count().filter(F.col("count") > CROWDED).collect()}
            model.firm, model._automaton = [t for t in model.firm if t not in crowded], None
            model.clean = sorted({r["word"] for r in _misspelled(used_words, model).select("word").collect()} - own)  # CROWDED of each term at most
            model._automaton = None
        counts.unpersist()
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for s, e in chunks(batch.column(1)):
                    part = batch.slice(s, e - s)
                    x = shared.value.features(part.column(1).to_pylist())
                    yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x[:, k].copy()) for k in range(3)]], ["y", "a", "b", "c"])

        rows_ = second.select("y", "t").mapInArrow(features, "y int, a double, b double, c double").toPandas().sort_values(["y", "a", "b", "c"])
    finally:
        used.unpersist()
    truth = rows_["y"].to_numpy().astype(float)
    if len(truth) and truth.min() < truth.max():
        x = rows_[["a", "b", "c"]].to_numpy()
        index, offsets = np.tile(np.arange(3), len(x)), np.arange(len(x) + 1) * 3
        model.weights, model.bias = fit_logistic(index, x.ravel(), offsets, truth, 3, scale=1.0, rounds=400, ridge=1e-3)
        # learning rows show few misspellings: they count for half at least, and no hit speaks for a clean text
        model.weights[1] = max(model.weights[1], 0.5 * model.weights[0])
        model.weights[2] = max(model.weights[2], 0.0)
        slope, shift = calibrate(x @ model.weights + model.bias, truth)
        model.weights, model.bias = slope * model.weights, slope * model.bias + shift
    else:
        model.weights, model.bias = np.array([2.0, 1.0, 0.2]), -2.0
    return model


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("term", T.StringType()), T.StructField("distance", T.IntegerType()), T.StructField("abuse", T.DoubleType())]))


def score_toxicity(df: DataFrame, model: ToxicModel, text: str = "text", out: str = "score", spans: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``df`` with the probability of toxicity, and with the hits (code points, ends exclusive) if ``spans`` names a column."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(out, T.DoubleType())] + ([T.StructField(spans, SPANS)] if spans else []))

    def make():
        m = shared.value
        names = [*m.terms, *m.stems]

        def kernel(texts: pa.Array) -> list[pa.Array]:
            own = [t or "" for t in texts.to_pylist()]
            made = [pa.array(m.score(own))]
            if spans:
                found = m.find(own) if names else [[] for _ in own]
                made.append(pa.array([[{"start": a, "end": b, "term": names[t], "distance": d, "abuse": x} for a, b, t, d, x in hits] for hits in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("term", pa.string()), ("distance", pa.int32()), ("abuse", pa.float64())]))))
            return made

        return kernel

    return with_columns(df, text, schema, make, keep=keep)


def learn_from_tables(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> ToxicModel:
    """Learn from the labels of rows that are not held out."""
    docs = table_path(spark, sf_dir, "documents") if docs is None else docs
    return learn(docs.select("doc_id", "text"), table_path(spark, sf_dir, "labels").filter(~held_out("doc_id")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table_path(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, learn_from_tables(spark, sf_dir), keep=["doc_id"])
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))
