"""Registered queries over the driver's tables, one or more for every operator, and their SQL.

Every query reads its whole table. Vectors come out as (id, pos, val) or as rounded scalars, so that
results can be hashed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import randomness
from .functions import vectors as V
from .operators import assign, epsilon, evaluate, grid, pairs, sampling, sums
from .plans import bisecting, config, dbscan, kmeans, medoids, models, run
from .sources import points as P
from .streaming import scoring

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


# ---------------------------------------------------------------- inputs
def embeddings(spark: SparkSession, d: str) -> DataFrame:
    """(rid, features, weight = label + 1, label): 64 dimensions."""
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("rid"), F.col("embedding").cast("array<double>").alias("features"), (F.col("label") + 1).cast("double").alias("weight"), "label")


def parts(spark: SparkSession, d: str) -> DataFrame:
    """Two dimensions: size and price above 900; weight 1."""
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("long").alias("rid"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice").cast("double") - 900).alias("features"), F.lit(1.0).alias("weight"), F.col("p_size").cast("double").alias("size"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Four dimensions of order lines; weight 1."""
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    return t.select((F.col("l_orderkey").cast("long") * 10 + F.col("l_linenumber")).alias("rid"), F.array(*[F.col(c).cast("double") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]).alias("features"), F.lit(1.0).alias("weight"))


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/supplier.parquet")
    return t.select(F.col("s_suppkey").cast("long").alias("rid"), F.array(F.col("s_nationkey").cast("double") * 100, F.col("s_acctbal").cast("double")).alias("features"), (F.col("s_nationkey") + 1).cast("double").alias("weight"))


E_SQL = "e AS (SELECT vec_id AS rid, CAST(embedding AS DOUBLE[]) AS v, CAST(label + 1 AS DOUBLE) AS w, label FROM embeddings)"
P_SQL = "p AS (SELECT CAST(p_partkey AS BIGINT) AS rid, [CAST(p_size AS DOUBLE), CAST(p_retailprice AS DOUBLE) - 900] AS v, CAST(p_size AS DOUBLE) AS size FROM part)"
S_SQL = "s AS (SELECT CAST(s_suppkey AS BIGINT) AS rid, [CAST(s_nationkey AS DOUBLE) * 100, CAST(s_acctbal AS DOUBLE)] AS v, CAST(s_nationkey + 1 AS DOUBLE) AS w FROM supplier)"


def first_rows(df: DataFrame, k: int) -> np.ndarray:
    return P.PointSet(df).take_first(k)[1]


# ---------------------------------------------------------------- vector functions
def _pairs(df: DataFrame) -> DataFrame:
    a = df.select(F.col("rid").alias("a"), F.col("features").alias("x"))
    b = df.select(F.col("rid").alias("b"), F.col("features").alias("y"))
    return a.join(b, F.col("a") < F.col("b"))


def _distance_query(name: str, metric: V.Metric, sql: str) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        rows = pairs.distance_rows(embeddings(spark, d), metric)
        # vectors that are null or of several lengths
        return rows if rows is not None else _pairs(embeddings(spark, d)).select("a", "b", r6(metric.column(F.col("x"), F.col("y"))).alias("d"))

    f.__name__ = name
    query(f"WITH {E_SQL} SELECT a.rid AS a, b.rid AS b, round({sql}, 6) AS d FROM e a JOIN e b ON a.rid < b.rid")(f)


_distance_query("dist_euclidean", V.EUCLIDEAN, "list_distance(a.v, b.v)")
_distance_query("dist_manhattan", V.MANHATTAN, "list_sum(list_transform(list_zip(a.v, b.v), lambda t: abs(t[1] - t[2])))")
_distance_query("dist_cosine", V.COSINE, "1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))")
_distance_query("dist_unit_sphere", V.UNIT_SPHERE, "1 - list_dot_product(a.v, b.v)")


@query(f"WITH {E_SQL} SELECT a.rid AS a, count(*) FILTER (WHERE list_distance(a.v, b.v) <= 1.3) AS n FROM e a JOIN e b ON a.rid < b.rid GROUP BY a.rid")
def within_radius(spark: SparkSession, d: str) -> DataFrame:
    if (t := pairs.bounded_sums(embeddings(spark, d), V.EUCLIDEAN, 1.3)) is not None:
        return t.select("a", "n")
    return _pairs(embeddings(spark, d)).groupBy("a").agg(F.count(F.when(V.EUCLIDEAN.within(F.col("x"), F.col("y"), 1.3), 1)).alias("n"))


@query(f"WITH {E_SQL}, q AS (SELECT a.rid AS a, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.rid < b.rid) SELECT a, count(*) FILTER (WHERE d > 1.3) AS beyond, round(coalesce(sum(d) FILTER (WHERE d <= 1.3), 0), 6) AS total FROM q GROUP BY a")
def distance_up_to(spark: SparkSession, d: str) -> DataFrame:
    if (t := pairs.bounded_sums(embeddings(spark, d), V.EUCLIDEAN, 1.3)) is not None:
        return t.select("a", "beyond", r6("total").alias("total"))
    v = V.EUCLIDEAN.up_to(F.col("x"), F.col("y"), 1.3)
    q = _pairs(embeddings(spark, d)).select("a", v.alias("d"))
    return q.groupBy("a").agg(F.count(F.when(F.col("d") == float("inf"), 1)).alias("beyond"), r6(F.coalesce(F.sum(F.when(F.col("d") < float("inf"), F.col("d"))), F.lit(0.0))).alias("total"))


@query(f"WITH {P_SQL} SELECT rid, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS pos, round(unnest(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))), 6) AS val FROM p")
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    return parts(spark, d).select("rid", F.posexplode(V.l2_normalize(F.col("features"))).alias("pos", "val")).select("rid", "pos", r6("val").alias("val"))


@query("SELECT c_nationkey, round(sum(CASE WHEN c_acctbal > 0 THEN CAST(c_acctbal AS DOUBLE) ELSE 0 END), 4) AS mass FROM customer GROUP BY c_nationkey")
def sanitize_weights(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/customer.parquet")
    return t.groupBy("c_nationkey").agg(F.round(F.sum(V.sanitize_weight(F.col("c_acctbal").cast("double"))), 4).alias("mass"))


@query("SELECT c_nationkey, count(*) AS n FROM customer WHERE c_nationkey <> 0 AND c_acctbal >= 0 GROUP BY c_nationkey")
def finite_filter(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/customer.parquet")
    odd = F.array(F.when(F.col("c_nationkey") == 0, float("inf")).otherwise(1.0), F.when(F.col("c_acctbal") < 0, float("nan")).otherwise(1.0))
    return t.filter(V.all_finite(odd)).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT row AS row, count(*) AS n FROM (SELECT CASE WHEN t % 2 = 0 THEN t // 2 ELSE m - 1 - t // 2 END AS row FROM (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS t, count(*) OVER () AS m FROM supplier)) GROUP BY row")
def balanced_rows(spark: SparkSession, d: str) -> DataFrame:
    m = spark.read.parquet(f"{d}/supplier.parquet").count()
    return spark.range(m).select(V.balanced_row(F.col("id"), m).cast("long").alias("row")).groupBy("row").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {P_SQL}, t AS (SELECT size, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS pos, unnest(v) AS x FROM p) SELECT pos, round(sum(size * x) / 1e6, 6) AS total, round(sum(size * x) / sum(size), 6) AS mean FROM t GROUP BY pos")
def weighted_sums(spark: SparkSession, d: str) -> DataFrame:
    t = parts(spark, d).select(F.col("size").alias("weight"), "features")
    return sums.coordinate_sums(t, []).select("pos", r6(F.col("value") / 1e6).alias("total"), r6(F.col("value") / F.col("mass")).alias("mean"))


# ---------------------------------------------------------------- sources
@query("SELECT count(*) AS n FROM lineitem")
def row_count(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {E_SQL} SELECT rid, label, round(list_sum(v), 6) AS total FROM e ORDER BY rid LIMIT 10")
def take_first(spark: SparkSession, d: str) -> DataFrame:
    return embeddings(spark, d).orderBy("rid").limit(10).select("rid", "label", r6(V.total(F.col("features"))).alias("total"))


@query(f"WITH {E_SQL}, t AS (SELECT rid, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS pos, unnest(v) AS x FROM e) SELECT pos, count(*) AS n, round(sum(x), 6) AS total FROM t GROUP BY pos")
def parquet_scan(spark: SparkSession, d: str) -> DataFrame:
    t = P.read_parquet(spark, f"{d}/embeddings.parquet", "embedding", rid="vec_id").df
    return t.select("rid", F.posexplode("features").alias("pos", "x")).groupBy("pos").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("x")).alias("total"))


@query(f"WITH {E_SQL} SELECT count(*) AS n, round(sum(w), 6) AS mass FROM e")
def materialized_scan(spark: SparkSession, d: str) -> DataFrame:
    copy = P.materialize(P.PointSet(embeddings(spark, d).select("rid", "features", "weight")), P.shared_folder(spark))
    out = copy.points.df.agg(F.count(F.lit(1)).alias("n"), r6(F.sum("weight")).alias("mass")).first()
    copy.delete()
    return spark.createDataFrame([(out["n"], out["mass"])], "n long, mass double")


@query()
def synthetic_scan(spark: SparkSession, d: str) -> DataFrame:
    return P.synthetic(spark, 10_000, 8, 42).df.select("rid", F.posexplode("features").alias("pos", "val"))


# ---------------------------------------------------------------- assignment
K = 5
PROTO_SQL = f"c0 AS (SELECT row_number() OVER (ORDER BY rid) - 1 AS i, v AS c FROM e ORDER BY rid LIMIT {K})"


def _lloyd_sql(rounds: int, source: str = "e", weight: str = "w", dist: str = "list_distance({v}, {c})", project: str = "{c}", tag: str = "") -> str:
    """CTEs a0, c1, a1 .. c{rounds}: assignments with both distances, and means; ``tag`` follows each letter."""
    out = []
    for r in range(rounds):
        d = dist.format(v="x.v", c="y.c")
        out.append(f"n{tag}{r} AS (SELECT x.rid, x.v, {weight} AS w, y.i, {d} AS d, row_number() OVER (PARTITION BY x.rid ORDER BY {d}, y.i) AS k FROM {source} x, c{tag}{r} y)")
        out.append(f"a{tag}{r} AS (SELECT rid, any_value(v) FILTER (WHERE k = 1) AS v, any_value(w) AS w, any_value(i) FILTER (WHERE k = 1) AS i, min(d) FILTER (WHERE k = 1) AS d1, min(d) FILTER (WHERE k = 2) AS d2 FROM n{tag}{r} WHERE k <= 2 GROUP BY rid)")
        out.append(f"m{tag}{r} AS (SELECT i, pos, sum(w * x) / sum(w) AS m FROM (SELECT i, w, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM a{tag}{r}) GROUP BY i, pos)")
        out.append(f"u{tag}{r} AS (SELECT i, list(m ORDER BY pos) AS c FROM m{tag}{r} GROUP BY i)")
        out.append(f"c{tag}{r + 1} AS (SELECT i, {project.format(c='c')} AS c FROM u{tag}{r})")
    return ", ".join(out)


LLOYD1 = f"WITH {E_SQL}, {PROTO_SQL}, {_lloyd_sql(1)}"


@query(f"{LLOYD1} SELECT rid, CAST(i AS INTEGER) AS label FROM a0")
def nearest_prototype(spark: SparkSession, d: str) -> DataFrame:
    e = embeddings(spark, d).select("rid", "features")
    return assign.assign_nearest(e, first_rows(embeddings(spark, d), K), V.EUCLIDEAN).select("rid", "label")


@query(f"{LLOYD1} SELECT rid, CAST(i AS INTEGER) AS label, round(d1, 6) AS d1, round(d2, 6) AS d2 FROM a0")
def two_nearest(spark: SparkSession, d: str) -> DataFrame:
    e = embeddings(spark, d)
    return e.select("rid", assign.two_nearest(F.col("features"), first_rows(e, K), V.EUCLIDEAN).alias("t")).select("rid", "t.label", r6("t.d1").alias("d1"), r6("t.d2").alias("d2"))


STATS_SQL = "SELECT CAST(i AS INTEGER) AS label, count(*) AS rows, round(sum(w), 6) AS mass, round(sum(w * d1 * d1), 6) AS error, round(sum(w * (d2 * d2 - d1 * d1)), 6) AS utility FROM a0 GROUP BY i"


@query(f"{LLOYD1} {STATS_SQL}")
def assign_cell_stats(spark: SparkSession, d: str) -> DataFrame:
    e = embeddings(spark, d)
    t = sums.cell_stats_table(e, first_rows(e, K), V.EUCLIDEAN)
    return t.select("label", "rows", *[r6(c).alias(c) for c in ("mass", "error", "utility")])


@query(f"{LLOYD1} {STATS_SQL}")
def assign_cell_stats_kernel(spark: SparkSession, d: str) -> DataFrame:
    e = embeddings(spark, d)
    s = sums.cell_stats(e, first_rows(e, K), V.EUCLIDEAN)
    rows = [(i, int(s.count[i]), float(s.mass[i]), float(s.error[i]), float(s.utility[i])) for i in range(K) if s.count[i]]
    return spark.createDataFrame(rows, "label int, rows long, mass double, error double, utility double").select("label", "rows", *[r6(c).alias(c) for c in ("mass", "error", "utility")])


def _vectors(spark: SparkSession, rows: np.ndarray) -> DataFrame:
    flat = [(i, c, float(x)) for i, row in enumerate(rows) for c, x in enumerate(row)]
    return spark.createDataFrame(flat, "label int, pos int, val double").select("label", "pos", r6("val").alias("val"))


def _rows_sql(cte: str) -> str:
    return f"SELECT CAST(i AS INTEGER) AS label, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS pos, round(unnest(c), 6) AS val FROM {cte}"


@query(f"{LLOYD1} {_rows_sql('c1')}")
def lloyd_step(spark: SparkSession, d: str) -> DataFrame:
    e = embeddings(spark, d)
    start = first_rows(e, K)
    return _vectors(spark, sums.cell_stats(e, start, V.EUCLIDEAN).means(start, V.PLANE.project))


def _fitted(spark: SparkSession, d: str, rounds: int = 3, weighted: bool = True, geometry: V.Geometry = V.PLANE) -> models.PrototypeModel:
    e = embeddings(spark, d)
    e = e if weighted else e.withColumn("weight", F.lit(1.0))
    return kmeans.KMeans(K, rounds, 0.0, geometry=geometry, initial=first_rows(e, K)).fit(P.PointSet(e.select("rid", "features", "weight")))


def _sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))


@query(f"WITH {E_SQL}, {PROTO_SQL}, {_lloyd_sql(4, weight='1.0')} SELECT CAST(i AS INTEGER) AS label, count(*) AS rows FROM a3 GROUP BY i")
def kmeans_lloyd_sizes(spark: SparkSession, d: str) -> DataFrame:
    return _sizes(_fitted(spark, d, weighted=False).transform(embeddings(spark, d).drop("label")))


@query(f"WITH {E_SQL}, {PROTO_SQL}, {_lloyd_sql(3)} {_rows_sql('c3')}")
def kmeans_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, _fitted(spark, d).prototypes)


NORMAL = "list_transform({c}, lambda q: q / sqrt(list_dot_product({c}, {c})))"
SPHERE_SQL = f"WITH e AS (SELECT vec_id AS rid, {NORMAL.format(c='CAST(embedding AS DOUBLE[])')} AS v, CAST(label + 1 AS DOUBLE) AS w FROM embeddings), {PROTO_SQL}, {_lloyd_sql(2, dist='1 - list_dot_product({v}, {c})', project=NORMAL)}"


@query(f"{SPHERE_SQL} {_rows_sql('c2')}")
def kmeans_spherical(spark: SparkSession, d: str) -> DataFrame:
    e = embeddings(spark, d).withColumn("features", V.l2_normalize(F.col("features")))
    fitted = kmeans.KMeans(K, 2, 0.0, geometry=V.SPHERE, initial=first_rows(e, K)).fit(P.PointSet(e.select("rid", "features", "weight")))
    return _vectors(spark, fitted.prototypes)


@query(f"WITH {E_SQL}, {PROTO_SQL}, {_lloyd_sql(2)} SELECT round(max(list_distance(c1.c, c2.c)), 6) AS moved FROM c1 JOIN c2 USING (i)")
def max_movement(spark: SparkSession, d: str) -> DataFrame:
    e = embeddings(spark, d)
    one = sums.cell_stats(e, start := first_rows(e, K), V.EUCLIDEAN).means(start, V.PLANE.project)
    two = sums.cell_stats(e, one, V.EUCLIDEAN).means(one, V.PLANE.project)
    return spark.createDataFrame([(round(kmeans.movement(one, two, V.EUCLIDEAN), 6),)], "moved double")


@query(f"{LLOYD1}, q AS (SELECT i, sum(w * d1 * d1) AS e FROM a0 GROUP BY i) SELECT CAST(row_number() OVER (ORDER BY e DESC, i) - 1 AS INTEGER) AS place, CAST(i AS INTEGER) AS label FROM q")
def breathing_expand_targets(spark: SparkSession, d: str) -> DataFrame:
    e = embeddings(spark, d)
    s = sums.cell_stats(e, first_rows(e, K), V.EUCLIDEAN)
    return spark.createDataFrame(list(enumerate(kmeans.split_targets(s.error, K))), "place int, label int")


@query(f"{LLOYD1}, q AS (SELECT i, sum(w * (d2 * d2 - d1 * d1)) AS u FROM a0 GROUP BY i) SELECT CAST(row_number() OVER (ORDER BY u, i) - 1 AS INTEGER) AS place, CAST(i AS INTEGER) AS label FROM q")
def breathing_removal_order(spark: SparkSession, d: str) -> DataFrame:
    e = embeddings(spark, d)
    s = sums.cell_stats(e, first_rows(e, K), V.EUCLIDEAN)
    return spark.createDataFrame(list(enumerate(kmeans.removal_order(s.utility))), "place int, label int")


#: The clone's two offsets are the first draws of the seeded generator.
OFFSETS = (lambda rng: [rng.next_double() - 0.5, rng.next_double() - 0.5])(randomness.JavaRandom(42))
BREATH_SQL = f"""WITH {S_SQL}, c0 AS (SELECT row_number() OVER (ORDER BY rid) - 1 AS i, v AS c FROM s ORDER BY rid LIMIT {K}), {_lloyd_sql(2, source='s')},
hurt AS (SELECT i, sum(w * d1 * d1) AS e FROM a1 GROUP BY i), old AS (SELECT sum(w * d1 * d1) AS e, 0.01 * sqrt(sum(w * d1 * d1) / sum(w)) AS scale FROM a1),
clone AS (SELECT {K} AS i, [c[1] + scale * ({OFFSETS[0]!r}), c[2] + scale * ({OFFSETS[1]!r})] AS c FROM c1 JOIN hurt USING (i), old ORDER BY hurt.e DESC, i LIMIT 1),
cg0 AS (SELECT i, c FROM c1 UNION ALL SELECT i, c FROM clone), {_lloyd_sql(2, source='s', tag='g')},
useful AS (SELECT i, sum(w * (d2 * d2 - d1 * d1)) AS u FROM ag1 GROUP BY i), gone AS (SELECT i FROM useful ORDER BY u, i LIMIT 1),
cs0 AS (SELECT row_number() OVER (ORDER BY i) - 1 AS i, c FROM cg1 WHERE i NOT IN (SELECT i FROM gone)), {_lloyd_sql(2, source='s', tag='s')},
new AS (SELECT sum(w * d1 * d1) AS e FROM as1), best AS (SELECT i, c FROM cs1, new, old WHERE new.e < old.e UNION ALL SELECT i, c FROM c1, new, old WHERE new.e >= old.e)"""


@query(f"{BREATH_SQL} {_rows_sql('best')}")
def breathing_cycle(spark: SparkSession, d: str) -> DataFrame:
    """One cycle of breathing over the suppliers: a round of Lloyd, a clone, a round, a removal, a round; the better set."""
    df = suppliers(spark, d)
    return _vectors(spark, kmeans.BreathingKMeans(K, 1, 0.0, m0=1, max_cycles=1, initial=first_rows(df, K)).fit(P.PointSet(df)).prototypes)


def nations(spark: SparkSession, d: str) -> DataFrame:
    """One row a nation: the balance of its customers in thousands and their number, which is also the weight."""
    t = spark.read.parquet(f"{d}/customer.parquet").groupBy(F.col("c_nationkey").cast("long").alias("rid"))
    t = t.agg(F.round(F.sum(F.col("c_acctbal").cast("double")) / 1e3, 6).alias("total"), F.count(F.lit(1)).cast("double").alias("weight"))
    return t.select("rid", F.array("total", "weight").alias("features"), "weight")


def _split_sql(source: str, tag: str) -> str:
    """CTEs of one split of ``source``: the least row and the farthest from it, two rounds, and the last assignment a{tag}2."""
    return f"""lo{tag} AS (SELECT v AS c FROM {source} ORDER BY v LIMIT 1), hi{tag} AS (SELECT x.v AS c FROM {source} x, lo{tag} lo ORDER BY list_distance(x.v, lo.c) DESC, x.v LIMIT 1),
c{tag}0 AS (SELECT 0 AS i, c FROM lo{tag} UNION ALL SELECT 1 AS i, c FROM hi{tag}), {_lloyd_sql(3, source=source, tag=tag)}"""


N_SQL = "e AS (SELECT CAST(c_nationkey AS BIGINT) AS rid, [round(sum(CAST(c_acctbal AS DOUBLE)) / 1e3, 6), CAST(count(*) AS DOUBLE)] AS v, CAST(count(*) AS DOUBLE) AS w FROM customer GROUP BY c_nationkey)"


@query(
    f"""WITH {N_SQL}, {_split_sql('e', 'f')}, worst AS (SELECT i FROM af2 GROUP BY i ORDER BY sum(w * d1 * d1) DESC, i LIMIT 1), e2 AS (SELECT rid, v, w FROM af2 WHERE i IN (SELECT i FROM worst)), {_split_sql('e2', 'h')}
SELECT af2.rid, CAST(CASE WHEN (SELECT i FROM worst) = 0 THEN CASE WHEN af2.i = 0 THEN ah2.i ELSE 2 END ELSE CASE WHEN af2.i = 0 THEN 0 ELSE 1 + ah2.i END END AS INTEGER) AS label FROM af2 LEFT JOIN ah2 USING (rid)"""
)
def bisecting_nations(spark: SparkSession, d: str) -> DataFrame:
    """Bisecting k-means into three leaves; a table of at most 256 rows is its own sample of seeds."""
    df = nations(spark, d)
    return bisecting.BisectingKMeans(3, 2, 0.0).fit(P.PointSet(df)).transform(df).select("rid", "label")


SPLIT_SQL = f"""WITH {P_SQL}, e AS (SELECT rid, v, 1.0 AS w FROM p),
lo AS (SELECT v AS c FROM e ORDER BY v LIMIT 1), hi AS (SELECT e.v AS c FROM e, lo ORDER BY list_distance(e.v, lo.c) DESC, e.v LIMIT 1),
c0 AS (SELECT 0 AS i, c FROM lo UNION ALL SELECT 1 AS i, c FROM hi), {_lloyd_sql(2)}"""


@query(f"{SPLIT_SQL} SELECT CAST(i AS INTEGER) AS label, count(*) AS rows, round(sum(d1 * d1) / 1e3, 6) AS cost FROM a1 GROUP BY i")
def bisect_first_split(spark: SparkSession, d: str) -> DataFrame:
    t = parts(spark, d).select("rid", "features", "weight")
    low = t.agg(F.min("features")).first()[0]
    far = t.orderBy(F.desc(V.euclidean(F.col("features"), V.literal(low))), "features").first()["features"]
    start = np.array([low, far])
    means = sums.cell_stats(t, start, V.EUCLIDEAN).means(start, V.PLANE.project)
    s = sums.cell_stats_table(t, means, V.EUCLIDEAN)
    return s.select("label", "rows", r6(F.col("error") / 1e3).alias("cost"))


# ---------------------------------------------------------------- medoids
def _build_sql(k: int) -> str:
    """CTEs b0..b(k-1), the chosen rows."""
    out = [f"{S_SQL}", "pd AS (SELECT x.rid AS x, y.rid AS c, x.w AS w, list_distance(x.v, y.v) AS d FROM s x, s y)", "b0 AS (SELECT c FROM pd GROUP BY c ORDER BY sum(w * d), c LIMIT 1)"]
    for r in range(1, k):
        chosen = " UNION ALL ".join(f"SELECT c FROM b{j}" for j in range(r))
        out.append(f"g{r} AS (SELECT x, min(d) AS near FROM pd WHERE c IN ({chosen}) GROUP BY x)")
        out.append(f"b{r} AS (SELECT c FROM pd JOIN g{r} USING (x) WHERE c NOT IN ({chosen}) GROUP BY c ORDER BY sum(w * greatest(near - d, 0)) DESC, c LIMIT 1)")
    return "WITH " + ", ".join(out)


BUILD3 = _build_sql(3)
CHOSEN3 = "SELECT 0 AS slot, c FROM b0 UNION ALL SELECT 1, c FROM b1 UNION ALL SELECT 2, c FROM b2"


def _supplier_points(spark: SparkSession, d: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return P.PointSet(suppliers(spark, d)).collect()


@query(f"{BUILD3} SELECT CAST(slot AS INTEGER) AS slot, c AS rid FROM ({CHOSEN3})")
def medoid_build_k(spark: SparkSession, d: str) -> DataFrame:
    df = suppliers(spark, d)
    rid, x, _ = P.PointSet(df).collect()
    chosen: list[int] = []
    for _ in range(3):
        gain = medoids._objective_sums(df, x, x[chosen], V.EUCLIDEAN, "build")[0]
        gain[chosen] = -np.inf
        chosen.append(int(gain.argmax()))
    return spark.createDataFrame([(s, int(rid[c])) for s, c in enumerate(chosen)], "slot int, rid long")


NEAR3 = f"m AS ({CHOSEN3}), nd AS (SELECT x, any_value(w) AS w, min(d) AS d1, arg_min(slot, d) AS slot, list_sort(list(d))[2] AS d2 FROM pd JOIN m USING (c) GROUP BY x)"


@query(
    f"""{BUILD3}, {NEAR3}, t AS (SELECT pd.c, nd.slot, nd.w, CASE WHEN pd.d < d1 THEN nd.w * (pd.d - d1) ELSE 0 END AS gain, nd.w * (least(d2, pd.d) - d1) AS own FROM pd JOIN nd USING (x) WHERE pd.c NOT IN (SELECT c FROM m)),
sh AS (SELECT c, sum(gain) AS shared FROM t GROUP BY c), sl AS (SELECT c, slot, sum(own - gain) AS loss FROM t GROUP BY c, slot)
SELECT CAST(m.slot AS INTEGER) AS slot, sh.c AS rid, round(shared + coalesce(loss, 0), 4) AS delta FROM sh CROSS JOIN (SELECT slot FROM m) m LEFT JOIN sl ON sl.c = sh.c AND sl.slot = m.slot"""
)
def swap_deltas(spark: SparkSession, d: str) -> DataFrame:
    rid, x, w = _supplier_points(spark, d)
    spread = medoids.Spread(spark, x, w, V.EUCLIDEAN)
    chosen = spread.build(3)
    deltas = spread.deltas(chosen, np.arange(len(spread.x)))
    spread.close()
    left = np.setdiff1d(np.arange(len(x)), chosen)
    rows = pa.table({"slot": pa.array(np.repeat(np.arange(3, dtype=np.int32), len(left))), "rid": pa.array(np.tile(rid[left], 3)), "delta": pa.array(deltas[:, spread.place[left]].ravel())})
    return spark.createDataFrame(rows).select("slot", "rid", F.round("delta", 4).alias("delta"))


def _swaps_sql(swaps: int) -> str:
    """BUILD, then up to ``swaps`` rounds that each make the best swap if it lowers the objective: CTEs m0..m{swaps}."""
    out = [BUILD3, f"m0 AS MATERIALIZED ({CHOSEN3})"]
    for r in range(swaps):
        out.append(f"nd{r} AS (SELECT x, any_value(w) AS w, min(d) AS d1, arg_min(slot, (d, slot)) AS slot, list_sort(list(d))[2] AS d2 FROM pd JOIN m{r} USING (c) GROUP BY x)")
        out.append(f"t{r} AS (SELECT pd.c, nd.slot, nd.w * least(pd.d - d1, 0) AS gain, nd.w * (least(d2, pd.d) - d1) AS own FROM pd JOIN nd{r} nd USING (x) WHERE pd.c NOT IN (SELECT c FROM m{r}))")
        out.append(f"sh{r} AS (SELECT c, sum(gain) AS shared FROM t{r} GROUP BY c), sl{r} AS (SELECT c, slot, sum(own - gain) AS loss FROM t{r} GROUP BY c, slot)")
        out.append(f"best{r} AS (SELECT m.slot, sh.c, shared + coalesce(loss, 0) AS delta FROM sh{r} sh CROSS JOIN m{r} m LEFT JOIN sl{r} sl ON sl.c = sh.c AND sl.slot = m.slot ORDER BY delta, m.slot, sh.c LIMIT 1)")
        out.append(f"m{r + 1} AS MATERIALIZED (SELECT m.slot, CASE WHEN m.slot = b.slot AND delta < 0 THEN b.c ELSE m.c END AS c FROM m{r} m CROSS JOIN best{r} b)")
    return ", ".join(out)


@query(f"{_swaps_sql(1)} SELECT CAST(slot AS INTEGER) AS slot, c AS rid, round(delta, 4) AS delta FROM best0")
def swap_best_move(spark: SparkSession, d: str) -> DataFrame:
    rid, x, w = _supplier_points(spark, d)
    spread = medoids.Spread(spark, x, w, V.EUCLIDEAN)
    chosen = spread.build(3)
    # a place's least row that is no medoid itself: what the SQL's order takes
    left = np.setdiff1d(np.arange(len(x)), chosen)
    slot, c, change = medoids.best_swap(spread.deltas(chosen, np.arange(len(spread.x)))[:, spread.place[left]])
    spread.close()
    return spark.createDataFrame([(slot, int(rid[left[c]]), change)], "slot int, rid long, delta double").select("slot", "rid", F.round("delta", 4).alias("delta"))


def _medoid_rows_sql(cte: str) -> str:
    return f"SELECT CAST(slot AS INTEGER) AS label, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS pos, round(unnest(v), 6) AS val FROM {cte} k JOIN s ON s.rid = k.c"


SWAPS = 2


@query(f"{_swaps_sql(SWAPS)} {_medoid_rows_sql(f'm{SWAPS}')}")
def fastpam_small(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, medoids.LocalMedoids(3, max_iter=SWAPS).fit(P.PointSet(suppliers(spark, d))).prototypes)


@query(f"{_swaps_sql(SWAPS)} {_medoid_rows_sql(f'm{SWAPS}')}")
def distfastpam_small(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, medoids.DistributedFastPAM(3, max_iter=SWAPS).fit(P.PointSet(suppliers(spark, d))).prototypes)


def _whole(points: P.PointSet) -> dict[str, int]:
    """CLARA and PAMAE take a table that is no larger than a sample as a whole, so that their results have an SQL form."""
    return {"num_samples": 2, "sample_size": max(12_000, points.count()), "max_iter": SWAPS}


@query(f"{_swaps_sql(SWAPS)} {_medoid_rows_sql(f'm{SWAPS}')}")
def clara_whole(spark: SparkSession, d: str) -> DataFrame:
    points = P.PointSet(suppliers(spark, d))
    return _vectors(spark, medoids.Clara(3, **_whole(points)).fit(points).prototypes)


REFINE_SQL = f"""{_swaps_sql(SWAPS)}, cell AS (SELECT x, any_value(w) AS w, arg_min(slot, (d, slot)) AS slot, min(d) AS d FROM pd JOIN m{SWAPS} USING (c) GROUP BY x),
cost AS (SELECT k.x AS cand, any_value(k.slot) AS slot, sum(pd.w * pd.d) AS cost FROM cell k JOIN pd ON pd.c = k.x JOIN cell o ON o.x = pd.x AND o.slot = k.slot GROUP BY k.x),
pick AS (SELECT cost.slot, cand AS c FROM cost JOIN m{SWAPS} m USING (slot) QUALIFY row_number() OVER (PARTITION BY cost.slot ORDER BY cost, cand <> m.c, cand) = 1),
was AS (SELECT sum(w * d) AS total FROM cell), now AS (SELECT sum(w * d) AS total FROM (SELECT x, any_value(w) AS w, min(d) AS d FROM pd JOIN pick USING (c) GROUP BY x)),
refined AS (SELECT slot, CASE WHEN now.total < was.total THEN pick.c ELSE m.c END AS c FROM pick JOIN m{SWAPS} m USING (slot), was, now)"""


@query(f"{REFINE_SQL} {_medoid_rows_sql('refined')}")
def pamae_whole(spark: SparkSession, d: str) -> DataFrame:
    points = P.PointSet(suppliers(spark, d))
    whole = _whole(points)
    return _vectors(spark, medoids.Pamae(3, **whole, refine_iters=1, pool_size=whole["sample_size"]).fit(points).prototypes)


SETS_SQL = "sets AS (SELECT CAST(rid % 4 AS INTEGER) AS set, v AS c FROM s)"


@query(f"WITH {S_SQL}, {SETS_SQL}, t AS (SELECT set, x.rid, any_value(x.w) AS w, min(list_distance(x.v, c)) AS d FROM s x, sets GROUP BY set, x.rid) SELECT set, round(sum(w * d) / 1e3, 6) AS cost FROM t GROUP BY set")
def candidate_set_costs(spark: SparkSession, d: str) -> DataFrame:
    rid, x, _ = _supplier_points(spark, d)
    names = [s for s in range(4) if (rid % 4 == s).any()]
    costs = medoids.set_costs(suppliers(spark, d), [x[rid % 4 == s] for s in names], V.EUCLIDEAN)
    return spark.createDataFrame([(s, float(c)) for s, c in zip(names, costs, strict=True)], "set int, cost double").select("set", r6(F.col("cost") / 1e3).alias("cost"))


@query(
    f"""WITH {S_SQL}, m AS (SELECT CAST(row_number() OVER (ORDER BY rid) - 1 AS INTEGER) AS slot, rid AS mid, v AS c FROM s ORDER BY rid LIMIT 3),
cell AS (SELECT x.rid, any_value(x.v) AS v, any_value(x.w) AS w, arg_min(slot, list_distance(x.v, c)) AS slot FROM s x, m GROUP BY x.rid),
cost AS (SELECT k.rid AS cand, any_value(k.slot) AS slot, sum(p.w * list_distance(p.v, k.v)) AS cost FROM cell k JOIN cell p ON p.slot = k.slot GROUP BY k.rid)
SELECT slot, cand AS rid FROM (SELECT cost.slot, cand, row_number() OVER (PARTITION BY cost.slot ORDER BY cost, CASE WHEN cand = mid THEN 0 ELSE 1 END, cand) AS k FROM cost JOIN m USING (slot)) WHERE k = 1"""
)
def pamae_refine_round(spark: SparkSession, d: str) -> DataFrame:
    df = suppliers(spark, d)
    rid, x, _ = P.PointSet(df).collect()
    start = x[:3]
    candidates, ids = np.vstack([start, x]), np.concatenate([rid[:3], rid])
    cell = V.EUCLIDEAN.pairwise(candidates, start).argmin(1)
    costs = medoids.cell_candidate_costs(df, start, candidates, cell, V.EUCLIDEAN)
    rows = []
    for j in range(3):
        at = np.flatnonzero(cell == j)
        rows.append((j, int(ids[at[int(costs[at].argmin())]])))
    return spark.createDataFrame(rows, "slot int, rid long")


# ---------------------------------------------------------------- range joins and density
EPS, MIN_PTS = 2.05, 5
NEAR = f"(a.v[1] - b.v[1]) * (a.v[1] - b.v[1]) + (a.v[2] - b.v[2]) * (a.v[2] - b.v[2]) <= {EPS} * {EPS}"
DENSE_SQL = f"{P_SQL}, n AS (SELECT a.rid, count(*) AS n, sum(b.size) AS mass FROM p a JOIN p b ON {NEAR} GROUP BY a.rid)"
CORE_SQL = f"""WITH RECURSIVE {DENSE_SQL}, cores AS (SELECT rid, v FROM p JOIN n USING (rid) WHERE n >= {MIN_PTS}),
edges AS (SELECT a.rid AS a, b.rid AS b FROM cores a JOIN cores b ON a.rid <> b.rid AND {NEAR}),
reach AS (SELECT rid, rid AS root FROM cores UNION SELECT edges.b AS rid, reach.root FROM reach JOIN edges ON edges.a = reach.rid AND reach.root < edges.b),
comp AS (SELECT rid, min(root) AS root FROM reach GROUP BY rid), num AS (SELECT rid, CAST(dense_rank() OVER (ORDER BY root) - 1 AS INTEGER) AS label FROM comp)"""


@query(f"WITH {DENSE_SQL} SELECT rid, n FROM n")
def eps_counts(spark: SparkSession, d: str) -> DataFrame:
    df = parts(spark, d).select("rid", "features", "weight")
    return epsilon.mass_within_table(df, df, EPS, V.EUCLIDEAN).select(F.col("cid").alias("rid"), F.col("mass").cast("long").alias("n"))


@query(f"WITH {DENSE_SQL} SELECT rid, round(mass, 6) AS mass FROM n")
def eps_mass(spark: SparkSession, d: str) -> DataFrame:
    df = parts(spark, d).select("rid", "features", F.col("size").alias("weight"))
    return epsilon.mass_within_table(df, df, EPS, V.EUCLIDEAN).select(F.col("cid").alias("rid"), r6("mass").alias("mass"))


@query(f"WITH {P_SQL} SELECT a.rid AS a, b.rid AS b FROM p a JOIN p b ON a.rid < b.rid AND {NEAR}")
def eps_edges(spark: SparkSession, d: str) -> DataFrame:
    return epsilon.grid_pairs(parts(spark, d), EPS, V.EUCLIDEAN)


def _core_rows(spark: SparkSession, d: str) -> DataFrame:
    df = parts(spark, d).select("rid", "features", "weight")
    return epsilon.mass_within_table(df, df, EPS, V.EUCLIDEAN).filter(F.col("mass") >= MIN_PTS).select(F.col("cid").alias("rid")).join(df, "rid")


@query(f"{CORE_SQL} SELECT rid, root AS component FROM comp")
def eps_components(spark: SparkSession, d: str) -> DataFrame:
    cells = grid.Grid(EPS, V.EUCLIDEAN, 2)
    found = P.written(cells.place(_core_rows(spark, d)).select("rid", "features", "cell"))
    return found.join(grid.cell_components(cells, found, epsilon.components_table), "cell").select("rid", "component")


def _dbscan(spark: SparkSession, d: str, how: str) -> DataFrame:
    df = parts(spark, d).select("rid", "features", "weight")
    model = dbscan.DBSCANpp(EPS, MIN_PTS, 1.0, assign=how).fit(P.PointSet(df))
    return model.transform(df).select("rid", "label")


NEAREST_CORE = "SELECT a.rid, arg_min(label, (list_distance(a.v, b.v), b.rid)) AS label, min(list_distance(a.v, b.v)) AS d FROM p a, (SELECT rid, v, label FROM cores JOIN num USING (rid)) b GROUP BY a.rid"


@query(f"{CORE_SQL}, near AS ({NEAREST_CORE}) SELECT rid, CAST(CASE WHEN d <= {EPS} THEN label ELSE -1 END AS INTEGER) AS label FROM near")
def dbscan_exact(spark: SparkSession, d: str) -> DataFrame:
    return _dbscan(spark, d, "eps")


@query(f"{CORE_SQL}, near AS ({NEAREST_CORE}) SELECT rid, CAST(label AS INTEGER) AS label FROM near")
def dbscan_closest(spark: SparkSession, d: str) -> DataFrame:
    return _dbscan(spark, d, "closest")


@query(f"{CORE_SQL}, near AS ({NEAREST_CORE}) SELECT count(DISTINCT label) FILTER (WHERE d <= {EPS}) AS n_clusters, round(avg(CASE WHEN d <= {EPS} THEN 0.0 ELSE 1.0 END), 6) AS noise_fraction FROM near")
def dbscan_summary(spark: SparkSession, d: str) -> DataFrame:
    t = _dbscan(spark, d, "eps")
    return t.agg(F.countDistinct(F.when(F.col("label") >= 0, F.col("label"))).alias("n_clusters"), r6(F.avg(F.when(F.col("label") == -1, 1.0).otherwise(0.0))).alias("noise_fraction"))


# ---------------------------------------------------------------- evaluation
def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings by their given label, the label 9 as noise."""
    return embeddings(spark, d).withColumn("label", F.when(F.col("label") == 9, -1).otherwise(F.col("label")).cast("int"))


LABELLED_SQL = f"{E_SQL}, g AS (SELECT rid, v, w, CASE WHEN label = 9 THEN -1 ELSE label END AS label FROM e)"
MOMENT_SQL = f"""WITH {LABELLED_SQL}, t AS (SELECT label, w, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM g WHERE label <> -1),
cm AS (SELECT label, pos, sum(w * x) / sum(w) AS m, sum(w) AS mass FROM t GROUP BY label, pos), ce AS (SELECT label, list(m ORDER BY pos) AS c, any_value(mass) AS mass FROM cm GROUP BY label),
sq AS (SELECT g.label, sum(w * list_distance(v, c)) AS s, sum(w * list_distance(v, c) * list_distance(v, c)) AS q FROM g JOIN ce USING (label) GROUP BY g.label),
mo AS (SELECT label, mass, c, s, q FROM ce JOIN sq USING (label))"""


@query(f"WITH {LABELLED_SQL} SELECT CAST(label AS INTEGER) AS label, count(*) AS rows, round(sum(w), 6) AS mass FROM g GROUP BY label")
def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    return sums.label_stats(labelled(spark, d)).select("label", "rows", r6("mass").alias("mass"))


@query(f"WITH {LABELLED_SQL} SELECT count(DISTINCT label) FILTER (WHERE label >= 0) AS n_clusters, round(avg(CASE WHEN label = -1 THEN 1.0 ELSE 0.0 END), 6) AS noise_fraction FROM g")
def label_summary(spark: SparkSession, d: str) -> DataFrame:
    s = evaluate.summarize_labels(labelled(spark, d))
    return spark.createDataFrame([(s.n_clusters, round(s.noise_fraction, 6))], "n_clusters long, noise_fraction double")


@query(f"{MOMENT_SQL} SELECT CAST(label AS INTEGER) AS label, round(mass, 6) AS mass, round(s, 6) AS spread, round(q, 6) AS squares FROM mo")
def cluster_moments(spark: SparkSession, d: str) -> DataFrame:
    m = sums.cluster_moments(labelled(spark, d), V.EUCLIDEAN)
    rows = [(int(x), float(a), float(b), float(c)) for x, a, b, c in zip(m.labels, m.mass, m.spread, m.squares, strict=True)]
    return spark.createDataFrame(rows, "label int, mass double, spread double, squares double").select("label", *[r6(c).alias(c) for c in ("mass", "spread", "squares")])


@query(f"{MOMENT_SQL} SELECT CAST(pos - 1 AS INTEGER) AS pos, round(sum(m * mass) / sum(mass), 6) AS val FROM cm GROUP BY pos")
def global_centroid(spark: SparkSession, d: str) -> DataFrame:
    c = sums.cluster_moments(labelled(spark, d), V.EUCLIDEAN).global_centroid
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(c)], "pos int, val double").select("pos", r6("val").alias("val"))


@query(f"{MOMENT_SQL}, r AS (SELECT a.label, max((a.s / a.mass + b.s / b.mass) / list_distance(a.c, b.c)) AS worst FROM mo a JOIN mo b ON a.label <> b.label GROUP BY a.label) SELECT round(avg(worst), 6) AS score FROM r")
def davies_bouldin(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(round(evaluate.davies_bouldin(labelled(spark, d)), 6),)], "score double")


@query(
    f"""{MOMENT_SQL}, gc AS (SELECT list(m ORDER BY pos) AS c FROM (SELECT pos, sum(m * mass) / sum(mass) AS m FROM cm GROUP BY pos))
SELECT round((sum(mass * list_distance(mo.c, gc.c) * list_distance(mo.c, gc.c)) / (count(*) - 1)) / (sum(q) / (sum(mass) - count(*))), 6) AS score FROM mo, gc"""
)
def calinski_harabasz(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(round(evaluate.calinski_harabasz(labelled(spark, d)), 6),)], "score double")


def _silhouette_sql(w: str) -> str:
    return f"""WITH {LABELLED_SQL}, k AS (SELECT rid, v, {w} AS w, label FROM g WHERE label <> -1), mass AS (SELECT label, sum(w) AS total FROM k GROUP BY label),
d AS (SELECT a.rid, a.label, a.w, b.label AS other, sum(b.w * list_distance(a.v, b.v)) AS s FROM k a JOIN k b ON true GROUP BY a.rid, a.label, a.w, b.label),
ab AS (SELECT d.rid, d.w, min(s / (total - least(1.0, d.w))) FILTER (WHERE d.label = other) AS a, min(s / total) FILTER (WHERE d.label <> other) AS b FROM d JOIN mass ON mass.label = d.other GROUP BY d.rid, d.w)"""


@query(f"{_silhouette_sql('1.0')} SELECT rid, round((b - a) / greatest(a, b), 6) AS s FROM ab")
def silhouette_per_point(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.silhouette_table(labelled(spark, d), V.EUCLIDEAN).select("rid", r6("s").alias("s"))


@query(f"{_silhouette_sql('1.0')} SELECT round(avg((b - a) / greatest(a, b)), 6) AS score, count(*) AS scored FROM ab")
def silhouette_full(spark: SparkSession, d: str) -> DataFrame:
    s = evaluate.silhouette(labelled(spark, d).withColumn("weight", F.lit(1.0)), V.EUCLIDEAN, None)
    return spark.createDataFrame([(round(s.score, 6), s.scored)], "score double, scored long")


@query(f"{_silhouette_sql('w')} SELECT round(sum(w * (b - a) / greatest(a, b)) / sum(w), 6) AS score, count(*) AS scored FROM ab")
def silhouette_weighted(spark: SparkSession, d: str) -> DataFrame:
    s = evaluate.silhouette(labelled(spark, d), V.EUCLIDEAN, None)
    return spark.createDataFrame([(round(s.score, 6), s.scored)], "score double, scored long")


# ---------------------------------------------------------------- seeded operators (no SQL form)
@query()
def bernoulli_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.bernoulli(lines(spark, d), 0.1, 42).select("rid")


@query()
def uniform_candidates(spark: SparkSession, d: str) -> DataFrame:
    return sampling.exact_sample(lines(spark, d), 500, 42).select("rid")


@query()
def bernoulli_streams(spark: SparkSession, d: str) -> DataFrame:
    return sampling.streams(lines(spark, d), [0.01, 0.02, 0.05], 42).groupBy("stream").agg(F.count(F.lit(1)).alias("n"))


@query()
def content_uniform(spark: SparkSession, d: str) -> DataFrame:
    return sampling.content_uniform(lines(spark, d), 42).select("rid", "u")


@query()
def mass_proportional_draw(spark: SparkSession, d: str) -> DataFrame:
    t = labelled(spark, d)
    total = t.filter("label <> -1").agg(F.sum("weight")).first()[0]
    return sampling.mass_proportional(t, 200, total, 42).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query()
def silhouette_sampled(spark: SparkSession, d: str) -> DataFrame:
    s = evaluate.silhouette(labelled(spark, d), V.EUCLIDEAN, 300)
    return spark.createDataFrame([(s.score, s.scored, s.sample_clusters, s.unscored)], "score double, scored long, clusters long, unscored long")


def _fit_sizes(name: str, make: Callable, table: Callable = lines) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        t = table(spark, d).select("rid", "features", "weight")
        return _sizes(make().fit(P.PointSet(t)).transform(t))

    f.__name__ = name
    query()(f)


_fit_sizes("kmeans_fit", lambda: kmeans.KMeans(10, 20))
_fit_sizes("kmeans_spherical_fit", lambda: kmeans.KMeans(10, 20, geometry=V.SPHERE))
_fit_sizes("kmeans_breathing_fit", lambda: kmeans.BreathingKMeans(10, 10, m0=2, max_cycles=2), parts)
_fit_sizes("bisecting_fit", lambda: bisecting.BisectingKMeans(5, 10), parts)
_fit_sizes("fastpam_fit", lambda: medoids.LocalMedoids(3), suppliers)
_fit_sizes("fasterpam_fit", lambda: medoids.LocalMedoids(3, solver="fasterpam"), suppliers)
_fit_sizes("distfastpam_fit", lambda: medoids.DistributedFastPAM(3, max_iter=20), suppliers)
_fit_sizes("clara_fit", lambda: medoids.Clara(5, num_samples=3, sample_size=200), lines)
_fit_sizes("pamae_fit", lambda: medoids.Pamae(5, num_samples=3, sample_size=200, refine_iters=2, pool_size=400), lines)
_fit_sizes("dbscanpp_fit", lambda: dbscan.DBSCANpp(EPS, MIN_PTS, 0.5), parts)


@query()
def run_config(spark: SparkSession, d: str) -> DataFrame:
    """A whole run from its configuration; the requested scores as rows."""
    document = {"runId": "query", "dataset": {"type": "parquet", "params": {"path": f"{d}/embeddings.parquet", "featureColumnName": "embedding", "idColumn": "vec_id"}}, "algorithm": {"name": "kmeans", "params": {"k": 5, "maxIter": 5}}, "evaluation": {"metrics": list(run.METRICS), "sampleSize": None}}
    result = run.execute(spark, config.RunConfig.of(document))
    if result["status"] != "ok":
        raise RuntimeError(result["errorMessage"])
    return spark.createDataFrame([(k, float(result[k])) for k in ("nRows", "nClusters", "noiseFraction", "silhouette", "daviesBouldin", "calinskiHarabasz")], "name string, value double")


@query(SQL["kmeans_lloyd_sizes"])
def stream_scoring(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings labelled as a stream by a fitted model."""
    model = _fitted(spark, d, weighted=False)
    folder = f"{P.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    source = embeddings(spark, d).select("rid", "features")
    source.write.mode("overwrite").parquet(f"{folder}/in")
    stream = spark.readStream.schema(source.schema).parquet(f"{folder}/in")
    scoring.write_labels(scoring.score_stream(model, stream), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return _sizes(spark.read.parquet(f"{folder}/out"))
