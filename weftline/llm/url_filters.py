"""URL filters: pattern rules indexed by their rarest literal token.

Every pattern rule is a regular expression with literal tokens (runs of letters and digits) that
each matching URL must contain whole. A rule is filed under the one of its tokens that the URLs at
hand use least. A URL's tokens fetch the rules filed under them; only those run their expression.
Everything is DataFrame functions: the index is a literal map, so no row moves for the lookups.

Host rules (host, path prefix, verdict) fit a host and its subdomains; the longest wins.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no host rule and
is allowed unless a pattern rule blocks it (a null one is always allowed); repeated rows are judged
each for itself; an empty table gives an empty one; other columns stay whatever their names are, those
named like an output column are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowtext import table_path


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """``pattern``: a regular expression on the lower-case URL that Java and RE2 read alike (``\\z`` for the end: ``$`` also stands before a last line break in Java); ``tokens``: runs of [a-z0-9] that every match contains, not touched by other such characters."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]


#: The contract's rules (fixed values).
HOST_RULES = (
    HostRule("allow", "com", "/"),
    HostRule("block", "example.com", "/en/"),
    HostRule("allow", "www.example.com", "/en/"),
    HostRule("block", "net", "/es/"),
    HostRule("block", "net", "/fr/"),
)
#: The usual forms of advertising, tracking and unwanted paths; allow rules win over block rules.
PATTERN_RULES = (
    PatternRule("ads-path", "block", r"/ads/(banner|frame|img)(/|\z)", ("ads",)),
    PatternRule("ad-host", "block", r"://([a-z0-9-]+\.)*adserver\.", ("adserver",)),
    PatternRule("click-track", "block", r"/click/track([/?#]|\z)", ("click", "track")),
    PatternRule("pixel", "block", r"/pixel\.gif([?#]|\z)", ("pixel", "gif")),
    PatternRule("utm-spam", "block", r"[?&]utm_campaign=spam(&|#|\z)", ("utm", "campaign", "spam")),
    PatternRule("casino", "block", r"[./-]casino[./-]", ("casino",)),
    PatternRule("session-id", "block", r"[?&;]phpsessid=[a-z0-9]+", ("phpsessid",)),
    PatternRule("tracker-ref", "block", r"[?&]page=[0-9]+&ref=x(&|#|\z)", ("page", "ref", "x")),
    PatternRule("print-view", "block", r"[?&]print=(1|true)(&|#|\z)", ("print",)),
    PatternRule("login", "block", r"/login([/?#]|\z)", ("login",)),
    PatternRule("org-docs", "allow", r"://([a-z0-9-]+\.)*example\.org/(en|de|fr|es)/", ("example", "org")),
    PatternRule("robots", "allow", r"/robots\.txt\z", ("robots", "txt")),
)


def _lower(c: Column) -> Column:
    """A-Z alone."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(_rest(url), r"(?s)^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_rule(host: Column, path: Column, rules: tuple[HostRule, ...] = HOST_RULES) -> Column:
    """The struct (name, verdict) of the longest rule that fits, or null; of equal ones the first."""
    found = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.name)):  # later ones stand above
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.filter(F.split(_lower(url), "[^a-z0-9]+"), lambda t: t != ""))


def rarest_tokens(urls: DataFrame, url: str, rules: tuple[PatternRule, ...]) -> dict[str, str]:
    """For each rule's name the one of its tokens that the fewest URLs hold (ties: the one that sorts first).

    One pass of counting conditional sums; one number for each token of the rules comes back.
    """
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    tokens = urls.select(F.array_intersect(url_tokens(F.col(url)), F.array(*map(F.lit, wanted))).alias("t"))
    counts = tokens.agg(*[F.count(F.when(F.array_contains("t", t), 1)).alias(t) for t in wanted]).first()
    return {r.name: min(r.tokens, key=lambda t: (counts[t], t)) for r in rules}


def pattern_verdict(url: Column, rules: tuple[PatternRule, ...], filed: dict[str, str]) -> Column:
    """allow or block: a candidate allow rule that matches, else a block rule that does, else allow."""
    index: dict[str, list[PatternRule]] = {}
    for r in rules:
        index.setdefault(filed[r.name], []).append(r)
    if not index:
        return F.lit("allow")
    low = _lower(url)
    entry = lambda r: F.struct(F.lit(r.pattern).alias("pattern"), F.lit(r.verdict).alias("verdict"))
    table = F.create_map(*[x for t, own in sorted(index.items()) for x in (F.lit(t), F.array(*map(entry, own)))])
    candidates = F.flatten(F.transform(F.array_intersect(url_tokens(url), F.array(*map(F.lit, sorted(index)))), lambda t: table[t]))
    hits = F.transform(F.filter(candidates, lambda r: F.regexp_like(low, r["pattern"])), lambda r: r["verdict"])
    return F.when(F.array_contains(hits, "allow"), "allow").when(F.array_contains(hits, "block"), "block").otherwise("allow")


def filter_urls(df: DataFrame, url: str = "url", host_rules: tuple[HostRule, ...] = HOST_RULES, pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES) -> DataFrame:
    """``df`` with host, path, rule (name of the host rule, else null) and verdict (its verdict, else the patterns')."""
    # positional names inside: no column of the input can clash with one in the making
    names = [f"c{i}" for i in range(len(df.columns))]
    inner, u = df.toDF(*names), F.col(names[_place(df, url)])
    filed = rarest_tokens(inner.select(u.alias("u")), "u", pattern_rules)
    taken = ("host", "path", "rule", "verdict")
    kept = [(n, c) for n, c in zip(names, df.columns, strict=True) if c.lower() not in taken]
    parts = inner.select(*names, host_of(u).alias("host"), path_of(u).alias("path"))
    found = parts.withColumn("fit", host_rule(F.col("host"), F.col("path"), host_rules))
    verdict = F.when(F.col("fit").isNotNull(), F.col("fit.verdict")).otherwise(F.coalesce(pattern_verdict(u, pattern_rules, filed), F.lit("allow")))
    out = found.select(*[n for n, _ in kept], "host", "path", F.col("fit.name").alias("rule"), verdict.alias("verdict"))
    return out.toDF(*[c for _, c in kept], *taken)


def _place(df: DataFrame, name: str) -> int:
    """The number of the column, by its exact name or else as Spark finds it."""
    same = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    return same[0]


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table_path(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def oracle(host_rules: tuple[HostRule, ...] = HOST_RULES, pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES) -> str:
    """The same in DuckDB, where every pattern runs on every URL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    low = "translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    order = sorted(host_rules, key=lambda r: -len(r.name))
    fits = [f"((host = {q(r.host)} OR ends_with(host, {q('.' + r.host)})) AND starts_with(path, {q(r.path)}))" for r in order]
    case = lambda value: "CASE " + " ".join(f"WHEN {f} THEN {q(value(r))}" for f, r in zip(fits, order, strict=True)) + " END"
    match = lambda v: " OR ".join(f"regexp_matches({low}, {q(r.pattern)})" for r in pattern_rules if r.verdict == v)
    return rf"""
WITH cut AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, url,
  coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut)
SELECT page_id, host, path, {case(lambda r: r.name)} AS rule,
  coalesce({case(lambda r: r.verdict)}, CASE WHEN {match('allow')} THEN 'allow' WHEN {match('block')} THEN 'block' ELSE 'allow' END) AS verdict
FROM parts"""


def brute_force(url: str | None) -> tuple[str, str, str | None, str]:
    """(host, path, rule, verdict) of one URL, with every rule tried."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    head = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(head) :])[0]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    host = head.translate(lower)
    fit = [r for r in HOST_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fit:
        best = max(fit, key=lambda r: len(r.name))
        return host, path, best.name, best.verdict
    hits = [r.verdict for r in PATTERN_RULES if re.search(r.pattern.replace(r"\z", r"\Z"), (url or "").translate(lower))]
    return host, path, None, "allow" if "allow" in hits or "block" not in hits else "block"
