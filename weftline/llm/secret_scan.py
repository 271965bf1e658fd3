"""Secret scans over a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over lower-case trigrams that every
match must contain. A chunk of documents is indexed once (trigram -> sorted document numbers, for
the trigrams that the rules ask for), postings are intersected and united as the queries say, and
the regular expression runs on the candidates alone. A rule whose query is "anything" has no
mandatory trigram and scans every document.

Defined cases: a null or empty text has no span; offsets are code points, ends exclusive; repeated
rows are scanned each for itself; columns named like an output column are replaced; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as sre  # the parse tree of the standard library's own regular expressions
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import Utf8, table_path, with_columns

#: A rule: matches of ``pattern``; one counts if ``group`` has ``least`` characters or more.
@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 1
    group: int = 0


#: The contract's kinds, in their order. These strings are fixed values.
BASE_RULES = (
    Rule("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
#: Further kinds, by the published forms of these credentials.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", r"AIza[0-9A-Za-z_-]+", 39),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]+", 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES

# ---------------------------------------------------------------- regular expression -> query
#: A query is True (anything), ("tri", t), ("and", parts) or ("or", parts).
Query = object
MOST_STRINGS = 64


def _both(a: Query, b: Query) -> Query:
    if a is True or a == b:
        return b
    return a if b is True else ("and", (a, b))


def _either(parts: list[Query]) -> Query:
    if any(p is True for p in parts):
        return True
    distinct = list(dict.fromkeys(parts))
    return distinct[0] if len(distinct) == 1 else ("or", tuple(distinct))


def _of_strings(strings: set[str]) -> Query:
    parts = []
    for s in sorted(strings):
        q: Query = True
        for t in dict.fromkeys(s[i : i + 3] for i in range(len(s) - 2)):
            q = _both(q, ("tri", t))
        parts.append(q)
    return _either(parts)


def _class(items: list) -> set[str] | None:
    """The lower-case characters of a small class, else None."""
    chars: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            chars.add(chr(arg).lower())
        elif op is sre.RANGE and arg[1] - arg[0] < 8:
            chars |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return chars if len(chars) <= 8 else None


def _walk(items) -> tuple[set[str] | None, Query]:
    """(the finite set of lower-case strings it matches, True), or (None, what every match contains)."""
    exact: set[str] | None = {""}
    seen: Query = True
    whole = True
    for op, arg in items:
        one, query = _node(op, arg)
        if one is not None and exact is not None and len(one) * len(exact) <= MOST_STRINGS:
            exact = {a + b for a in exact for b in one}
            continue
        seen = _both(seen, _of_strings(exact))
        whole = False
        if one is not None:
            exact = one
        else:
            seen, exact = _both(seen, query), {""}
    return (exact, True) if whole else (None, _both(seen, _of_strings(exact)))


def _node(op, arg) -> tuple[set[str] | None, Query]:
    if op is sre.LITERAL:
        return {chr(arg).lower()}, True
    if op is sre.IN:
        return _class(arg), True
    if op is sre.SUBPATTERN:
        return _walk(arg[3])
    if op is sre.BRANCH:
        found = [_walk(x) for x in arg[1]]
        if all(e is not None for e, _ in found) and sum(len(e) for e, _ in found) <= MOST_STRINGS:
            return set().union(*(e for e, _ in found)), True
        return None, _either([_of_strings(e) if e is not None else q for e, q in found])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, inner = arg
        exact, query = _walk(inner)
        if exact is not None and most <= 3 and most != sre.MAXREPEAT and sum(len(exact) ** k for k in range(least, most + 1)) <= MOST_STRINGS:
            strings, now = set(), {""}
            for k in range(most + 1):
                strings |= now if k >= least else set()
                now = {a + b for a in now for b in exact}
            return strings, True
        return None, True if least == 0 else (_of_strings(exact) if exact is not None else query)
    if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return {""}, True
    return None, True  # any character, categories, back references


def trigram_query(pattern: str) -> Query:
    """What trigrams (in lower case) each match of the pattern must contain; True: any text may match."""
    exact, query = _walk(parser.parse(pattern))
    return _of_strings(exact) if exact is not None else query


def trigrams_of(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*map(trigrams_of, query[1]))


# ---------------------------------------------------------------- index
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[ord("A") : ord("Z") + 1] += 32


class TrigramIndex:
    """Postings of the wanted trigrams over one chunk of texts."""

    def __init__(self, texts: Utf8, table: np.ndarray, n_wanted: int):
        d = _LOWER[texts.data]
        at = np.flatnonzero(table[(d[:-2] << np.uint32(16)) | (d[1:-1] << np.uint32(8)) | d[2:]]) if len(d) > 2 else np.zeros(0, np.int64)
        doc = texts.doc_of(at)
        inside = at + 3 <= texts.offsets[doc + 1]
        at, doc = at[inside], doc[inside]
        term = table[(d[at] << np.uint32(16)) | (d[at + 1] << np.uint32(8)) | d[at + 2]].astype(np.int64) if len(at) else np.zeros(0, np.int64)
        pairs = np.unique(term * texts.n + doc)
        ends = np.searchsorted(pairs, np.arange(1, n_wanted + 2) * texts.n) if texts.n else np.zeros(n_wanted + 1, np.int64)
        self.postings = [pairs[ends[k - 1] : ends[k]] - k * texts.n for k in range(1, n_wanted + 1)]
        self.all = np.arange(texts.n)

    def find(self, query: Query, number: dict[str, int]) -> np.ndarray:
        """Documents that may match, ascending."""
        if query is True:
            return self.all
        if query[0] == "tri":
            return self.postings[number[query[1]]]
        parts = sorted((self.find(q, number) for q in query[1]), key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, True) if query[0] == "and" else np.union1d(out, p)
        return out


class Scanner:
    """Compiled rules; ``scan`` gives each text's spans."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.queries = [trigram_query(r.pattern) for r in rules]
        # the index holds bytes: a query is used with its ASCII trigrams alone (fewer demands keep every match)
        wanted = sorted(t for q in self.queries for t in trigrams_of(q))
        if not all(t.isascii() for t in wanted):
            raise ValueError("rules need ASCII literals")
        self.number = {t: k for k, t in enumerate(dict.fromkeys(wanted))}
        self.table = np.zeros(1 << 24, np.uint16)
        for t, k in self.number.items():
            self.table[(ord(t[0]) << 16) | (ord(t[1]) << 8) | ord(t[2])] = k + 1
        self.compiled = [re.compile(r.pattern) for r in rules]

    def scan(self, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        """For each text its (start, rule number, end), ascending."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
        index = TrigramIndex(Utf8(texts), self.table, len(self.number))
        strings: list[str | None] = texts.to_pylist()
        for k, (rule, query, compiled) in enumerate(zip(self.rules, self.queries, self.compiled, strict=True)):
            for i in index.find(query, self.number).tolist():
                if strings[i]:
                    for m in compiled.finditer(strings[i]):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            found[i].append((m.start(), k, m.end()))
        for spans in found:
            spans.sort()
        return found


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def scan_secrets(df: DataFrame, text: str = "text", out: str = "secret_spans", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns of ``df`` and ``out``: the spans of all rules, by start, then in the rules' order."""

    def make() -> Callable:
        scanner = Scanner(rules)

        def kernel(texts: pa.Array) -> list[pa.Array]:
            return [pa.array([[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in spans] for spans in scanner.scan(texts)], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))]

        return kernel

    return with_columns(df, text, T.StructType([T.StructField(out, SPANS)]), make)


def redact_secrets(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """``df`` with every secret span in ``text`` replaced by ``mark`` (overlapping spans: once); other columns and all rows stay."""

    def make() -> Callable:
        scanner = Scanner(rules)

        def clean(s: str | None, spans: list[tuple[int, int, int]]) -> str | None:
            if not spans:
                return s
            parts, at = [], 0
            for start, _, end in spans:
                if start >= at:
                    parts += [s[at:start], mark]
                at = max(at, end)
            return "".join([*parts, s[at:]])

        def kernel(texts: pa.Array) -> list[pa.Array]:
            return [pa.array([clean(s, spans) for s, spans in zip(texts.to_pylist(), scanner.scan(texts), strict=True)], pa.string())]

        return kernel

    order = df.columns
    name = next(c for c in order if c.lower() == text.lower())
    return with_columns(df, text, T.StructType([T.StructField(name, T.StringType())]), make).select(*[F.col(f"`{c}`") for c in order])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of :func:`scan_secrets` over all documents."""
    s, base = F.col("secret_spans"), [r.kind for r in BASE_RULES]
    of = lambda *kinds: F.filter(s, lambda x: x["kind"].isin(*kinds))
    found = scan_secrets(table_path(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(_joined(of(*base)), 256).alias("base_sha256"),
        _joined(s).alias("spans"),
    )


def _sql_pattern(rule: Rule) -> str:
    """The rule for RE2: letters of either case spelled out, since RE2 would fold letters beyond ASCII too."""
    either = lambda m: re.sub("[a-z]", lambda c: f"[{c[0].upper()}{c[0]}]", m[1])
    return re.sub(r"\(\?ai:([^)]*)\)", lambda m: f"(?:{either(m)})", rule.pattern)


def oracle(rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES) -> str:
    """The query's rows in DuckDB, every rule on every text: starts are sums of what lies between the matches and the matches before."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    every = []
    for k, r in enumerate(rules):
        # runs of one class: those long enough are the same with the length in the pattern, and there are fewer of them
        p = q(f"{r.pattern[:-1]}{{{r.least},}}" if re.fullmatch(r"\[[^\]]+\]\+", r.pattern) else _sql_pattern(r))
        every.append(f"SELECT r, {k} AS k, {q(r.kind)} AS kind, {r.least} AS least, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {r.group}) AS g, regexp_split_to_array(t, {p}) AS p FROM d")
    kinds = ", ".join(q(r.kind) for r in base)
    joined = lambda cond: f"coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER ({cond}), '')"
    counts = ", ".join(f"count(*) FILTER (kind = {q(r.kind)}) AS n_{r.kind}" for r in base)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(every)}),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m),
s AS (SELECT r, k, kind, least, length(g[i]) AS n, length(m[i]) AS w,
  list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a FROM i),
f AS (SELECT r, k, kind, CAST(a AS BIGINT) AS a, CAST(a + w AS BIGINT) AS b FROM s WHERE n >= least)
SELECT doc_id, {counts}, sha256({joined(f"kind IN ({kinds})")}) AS base_sha256, {joined("kind IS NOT NULL")} AS spans
FROM d LEFT JOIN f USING (r) GROUP BY r, doc_id"""


def brute_force(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int]]:
    """What the scan must give for one text, by running every rule on it."""
    found = []
    for k, r in enumerate(rules):
        found += [(m.start(), k, r.kind, m.end()) for m in re.finditer(r.pattern, text or "") if len(m[r.group]) >= r.least]
    return [(kind, s, e) for s, _, kind, e in sorted(found)]


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
