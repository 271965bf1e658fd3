"""Mixing sources to target weights by Pfair scheduling.

A source with w of D shares owns w slots in every period of D. Its k-th block is released at slot
floor(k * D / w) and due by slot ceil((k + 1) * D / w); the slots are given to the released block
with the earliest deadline (ties: the source that sorts first). So after any number of slots every
source has had its share, less or more by under one block. The slots of one period depend on the
weights alone, which are reduced by their common divisor: they are planned once on the driver (one
number a slot, ``MOST_SLOTS`` at most), and the plan repeats.

Blocks are filled inside each source in the order of a hash of the id. Positions inside a source
come from counts of hash ranges and ranks inside them, so that no task sees a whole source. A
source that has run out leaves its slots empty; the others keep their order. All of it is DataFrame
functions.

Defined cases: a null source is a source of its own; a source without a weight gets
``default_share``; rows that repeat an id are documents of their own, in the order of their other
columns (equal rows are interchangeable), and null ids come as one hash; an empty table gives an empty one; columns named slot, block or
place are replaced, all others stay whatever their names are. No row is dropped or repeated. Shares
that leave more than ``MOST_SLOTS`` slots in a period are an error.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrowtext import table_path

#: Documents in a block.
BLOCK_ROWS = 8
#: Sources (with their shares) that the plan is made for at most; it is a literal of this size.
MOST_SOURCES = 10_000
#: Slots in one period at most, after division by the shares' common divisor.
MOST_SLOTS = 1 << 20


def pfair_slots(shares: dict[str, int]) -> list[tuple[str, int]]:
    """For each slot of one period (source, number of its block in the period)."""
    total = sum(shares.values())
    blocks = {s: 0 for s in shares}
    waiting: list[tuple[int, str]] = []  # by release
    ready: list[tuple[int, str]] = []  # by deadline
    for s in sorted(shares):
        heapq.heappush(waiting, (0, s))
    slots = []
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(blocks[s] + 1) * total // shares[s]), s))
        _, s = heapq.heappop(ready)
        slots.append((s, blocks[s]))
        blocks[s] += 1
        if blocks[s] < shares[s]:
            heapq.heappush(waiting, (blocks[s] * total // shares[s], s))
    return slots


def _name(source: Column) -> Column:
    """A source's key: its name after a mark, or the mark of null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def mix_sources(df: DataFrame, shares: dict[str, int] | None = None, default_share: int = 1, source: str = "source", doc_id: str = "doc_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with slot (in which its block stands), block (its number in the source) and place (rank inside the block).

    Ordering by slot and place gives the mixture.
    """
    # positional names inside: no column of the input can clash with one in the making
    columns = [f"c{i}" for i in range(len(df.columns))]
    inner, place_of = df.toDF(*columns), {c: n for c, n in zip(reversed(df.columns), reversed(columns), strict=True)}
    key, own_id = _name(F.col(place_of[source])), F.col(place_of[doc_id])
    names = sorted(r["k"] for r in inner.select(key.alias("k")).groupBy("k").count().limit(MOST_SOURCES + 1).collect())
    if len(names) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    plan, period = planned({n: int((shares or {}).get(n[1:], default_share)) for n in names})
    ranges = math.isqrt(inner.select(own_id).count()) + 1  # as many ranges as rows in each: neither the ranks nor the sums over ranges gather much
    keyed = inner.withColumns({"key": key, "hash": mix_hash(own_id)})
    keyed = keyed.withColumn("range", F.floor(F.conv(F.substring("hash", 1, 8), 16, 10).cast("long") * ranges / 2.0**32).cast("int"))
    # ranks inside (source, hash range), then the ranges before it
    before = keyed.groupBy("key", "range").count().select("key", "range", (F.sum("count").over(Window.partitionBy("key").orderBy("range")) - F.col("count")).alias("before"))
    others = [F.xxhash64(f.name) for f in inner.schema.fields if "map<" not in f.dataType.simpleString()]
    ranked = keyed.withColumn("rank", F.row_number().over(Window.partitionBy("key", "range").orderBy("hash", own_id, *others)))
    placed = ranked.join(before, ["key", "range"]).withColumn("at", F.col("before") + F.col("rank") - 1).withColumn("block", F.floor(F.col("at") / block_rows).cast("long"))
    # a source's slots are one literal of text: a plan of many slots would be as many literals
    slots = F.create_map(*[x for n in names for x in (F.lit(n), F.split(F.lit(",".join(map(str, plan[n]))), ",").cast("array<int>"))]) if names else F.create_map(F.lit(""), F.array(F.lit(0)))
    own = slots[F.col("key")]
    slot = F.floor(F.col("block") / F.size(own)).cast("long") * period + F.element_at(own, (F.col("block") % F.size(own) + 1).cast("int"))
    kept = [(n, c) for n, c in zip(columns, df.columns, strict=True) if c.lower() not in ("slot", "block", "place")]
    out = placed.select(*[n for n, _ in kept], slot.cast("long").alias("slot"), "block", (F.col("at") % block_rows).cast("int").alias("place"))
    return out.toDF(*[c for _, c in kept], "slot", "block", "place")


def mix_hash(doc_id: Column) -> Column:
    """32 hexadecimal digits that order a source's documents, the same in every SQL engine."""
    return F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def planned(shares: dict[str, int]) -> tuple[dict[str, list[int]], int]:
    """Each source's slots in one period, and the period."""
    if any(w < 1 for w in shares.values()):
        raise ValueError("shares are positive whole numbers")
    divisor = math.gcd(*shares.values()) or 1
    reduced = {n: w // divisor for n, w in shares.items()}
    period = sum(reduced.values())
    if period > MOST_SLOTS:
        raise ValueError(f"a period of {period} slots: give shares whose sum, divided by their common divisor, is at most {MOST_SLOTS}")
    plan: dict[str, list[int]] = {n: [] for n in reduced}
    for t, (n, _) in enumerate(pfair_slots(reduced)):
        plan[n].append(t)
    return plan, period


def mixed_order(df: DataFrame, places: bool = False, **options) -> DataFrame:
    """The rows and columns of ``df``, in files that follow each other in the mixture's order; with ``places`` also slot and place."""
    inner = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    mixed = mix_sources(inner, source=names[options.pop("source", "source")], doc_id=names[options.pop("doc_id", "doc_id")], **options)
    carried = ["slot", "place"] if places else []  # readers need not keep the order of files
    kept = {c: n for c, n in names.items() if not places or c.lower() not in carried}
    return mixed.orderBy("slot", "place").select(*kept.values(), *carried).toDF(*kept, *carried)


#: Shares of the production mixture; other sources have one share.
SHARES = {"src0": 4, "src1": 3, "src2": 2}


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table_path(spark, sf_dir, "documents").select("doc_id", "source"), SHARES)


def oracle(names: list[str], shares: dict[str, int] = SHARES, block_rows: int = BLOCK_ROWS) -> str:
    """The same rows in DuckDB, for tables of exactly these sources (and no null one), from one window over each whole source."""
    plan, period = planned({"=" + n: shares.get(n, 1) for n in names})
    lists = ", ".join(f"('{n[1:]}', {slots})" for n, slots in sorted(plan.items()))
    return f"""
WITH plan(source, slots) AS (VALUES {lists}),
ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('mix:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS n FROM documents)
SELECT doc_id, source, (n // {block_rows} // len(slots)) * {period} + slots[CAST(n // {block_rows} % len(slots) AS BIGINT) + 1] AS slot,
  n // {block_rows} AS block, CAST(n % {block_rows} AS INTEGER) AS place
FROM ranked JOIN plan USING (source)"""


def brute_force(rows: list[tuple[object, str | None]], shares: dict[str, int], default_share: int = 1, block_rows: int = BLOCK_ROWS) -> list[tuple[int, int, int]]:
    """(slot, block, place) of each row (doc_id, source): every block in turn takes the free slots, one after the other."""
    import hashlib

    key = lambda s: "" if s is None else "=" + s
    digest = lambda i: hashlib.md5(b"mix:" + ("" if i is None else str(i)).encode()).hexdigest()
    wanted = {key(s): shares.get(s, default_share) for _, s in rows}
    order = {k: sorted((n for n, r in enumerate(rows) if key(r[1]) == k), key=lambda n: (digest(rows[n][0]), str(rows[n][0]))) for k in wanted}
    total, done, out, left, t = sum(wanted.values()), dict.fromkeys(wanted, 0), {}, len(rows), 0
    while left:
        # released blocks, also of sources that have run out: theirs are the empty slots
        ready = [(-(-(done[k] + 1) * total // w), k) for k, w in wanted.items() if done[k] * total // w <= t]
        _, k = min(ready)
        for p, n in enumerate(order[k][done[k] * block_rows : (done[k] + 1) * block_rows]):
            out[n] = (t, done[k], p)
            left -= 1
        done[k], t = done[k] + 1, t + 1
    return [out[n] for n in range(len(rows))]
