"""What larger tables need: searches without a matrix, joins on cells, kernels in place of joins of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline import queries as Q
from weftline.functions import randomness
from weftline.functions.vectors import COSINE, EUCLIDEAN, MANHATTAN, UNIT_SPHERE
from weftline.operators import epsilon, evaluate, pairs
from weftline.plans import dbscan, models
from weftline.plans import medoids as M
from weftline.sources import points as P


def refuse(*_, **__):
    raise AssertionError("not the whole job")


@pytest.fixture
def copies(spark, tmp_path):
    """12,500 suppliers at 25 places, their keys dealt over them."""
    rng = np.random.default_rng(5)
    rows = [(i, i % 25, float(b)) for i, b in enumerate(np.tile(rng.integers(-900, 9000, 25), 500))]
    spark.createDataFrame(rows, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    x = np.array([(100.0 * n, b) for _, n, b in rows[:25]])
    return str(tmp_path), x, 500.0 * np.arange(1, 26)


def values(df):
    return np.array([r["val"] for r in df.orderBy("label", "pos").collect()]).reshape(-1, 2)


def test_clara_whole_takes_every_row(spark, copies, monkeypatch):
    d, x, w = copies
    monkeypatch.setattr(M, "draw_samples", refuse)
    assert np.array_equal(values(Q.clara_whole(spark, d)), x[M.fastpam(EUCLIDEAN.pairwise(x, x), w, 3, Q.SWAPS).medoids])


@pytest.mark.parametrize("by_driver", [0, 1 << 30])
def test_searches_without_a_matrix_equal_those_on_one(spark, monkeypatch, by_driver):
    monkeypatch.setattr(M, "DRIVER_DISTANCES", by_driver)
    rng = np.random.default_rng(2)
    x, w = np.round(rng.normal(size=(150, 2)) * 3), rng.integers(1, 5, 150).astype(float)
    d, spread = EUCLIDEAN.pairwise(x, x), M.Spread(spark, x, w, EUCLIDEAN)
    assert spread.build(4) == M.build(d, w, 4) and spread.fastpam(4) == M.fastpam(d, w, 4).medoids
    near = M.Nearest(d, spread.build(4))
    assert np.allclose(spread.deltas(near.medoids, np.arange(len(spread.x)))[:, spread.place], M.swap_deltas(d, w, near, np.arange(150)))
    if by_driver:
        assert np.array_equal(x[spread.fasterpam(4, seed=3)], x[M.fasterpam(d, w, 4, seed=3).medoids])
    few = np.repeat([[0.0], [1.0]], [4, 1], 0)
    assert M.Spread(spark, few, np.ones(5), EUCLIDEAN).build(4) == M.build(EUCLIDEAN.pairwise(few, few), np.ones(5), 4)


def test_swap_deltas_without_a_matrix(spark, copies, monkeypatch):
    d, x, w = copies
    monkeypatch.setattr(M, "build", refuse)
    rows = Q.swap_deltas(spark, d).collect()
    assert len(rows) == 3 * (12_500 - 3) and len({(r["slot"], r["rid"]) for r in rows}) == len(rows)
    monkeypatch.undo()
    dist = EUCLIDEAN.pairwise(x, x)
    want = M.swap_deltas(dist, w, M.Nearest(dist, M.build(dist, w, 3)), np.arange(25))
    assert np.allclose([r["delta"] for r in rows], [want[r["slot"], r["rid"] % 25] for r in rows], rtol=1e-9, atol=1e-3)


def test_pamae_whole_takes_every_row(spark, copies, monkeypatch):
    d, x, w = copies
    monkeypatch.setattr(M, "draw_samples", refuse)
    got = values(Q.pamae_whole(spark, d))
    dist = EUCLIDEAN.pairwise(x, x)
    cost = lambda m: (w * EUCLIDEAN.pairwise(x, m).min(1)).sum()
    assert cost(got) <= cost(x[M.fastpam(dist, w, 3, Q.SWAPS).medoids]) * (1 + 1e-12)


def test_best_swap_without_a_matrix(spark, copies, monkeypatch):
    d, x, w = copies
    monkeypatch.setattr(M, "build", refuse)
    best = Q.swap_best_move(spark, d).first()
    monkeypatch.undo()
    dist = EUCLIDEAN.pairwise(x, x)
    chosen = M.build(dist, w, 3)
    deltas = M.swap_deltas(dist, w, M.Nearest(dist, chosen), np.arange(25))
    deltas[:, chosen] = np.inf
    slot, at, change = M.best_swap(deltas)
    assert (best["slot"], best["rid"]) == (slot, at) and best["delta"] == pytest.approx(change, rel=1e-9)


@pytest.mark.parametrize("name", ["fastpam_small", "fasterpam_fit", "fastpam_fit"])
def test_fits_of_more_points_than_a_matrix_holds(spark, copies, name):
    d, x, _ = copies
    rows = Q.QUERIES[name](spark, d).collect()
    assert sum(r["rows"] for r in rows) == 12_500 if name.endswith("fit") else len(rows) == 6


def test_pamae_whole_refines_by_every_row(spark, copies, monkeypatch):
    """On no matrix of the sample."""
    d, x, w = copies
    monkeypatch.setitem(M.INNER, "fastpam", refuse)
    dist = EUCLIDEAN.pairwise(x, x)
    medoids = M.fastpam(dist, w, 3, Q.SWAPS).medoids
    cell, cost = dist[:, medoids].argmin(1), lambda m: (w * dist[:, m].min(1)).sum()
    pick = [min(np.flatnonzero(cell == j), key=lambda c, own=cell == j: (w * dist[c])[own].sum()) for j in range(3)]
    assert np.array_equal(values(Q.pamae_whole(spark, d)), x[pick if cost(pick) < cost(medoids) else medoids])


def test_fastpam_small_equals_the_search_on_places(spark, copies):
    d, x, w = copies
    assert np.array_equal(values(Q.fastpam_small(spark, d)), x[M.fastpam(EUCLIDEAN.pairwise(x, x), w, 3, Q.SWAPS).medoids])


def sizes(df):
    return [r["rows"] for r in df.orderBy("label").collect()]


def test_fasterpam_fit_makes_the_swaps_of_one_by_one(spark, copies):
    d, x, w = copies
    dist, improved = EUCLIDEAN.pairwise(x, x), True
    near = M.Nearest(dist, M.build(dist, w, 3))
    while improved:
        improved = False
        for c in np.array(randomness.permutation(12_500, 42)) % 25:
            slot, _, change = M.best_swap(M.swap_deltas(dist, w, near, np.array([c])))
            if c not in near.medoids and change < 0:
                near.swap(slot, c)
                improved = True
    assert sizes(Q.QUERIES["fasterpam_fit"](spark, d)) == (500 * np.bincount(near.slot)).tolist()


def test_fastpam_fit_equals_the_search_on_places(spark, copies):
    d, x, w = copies
    assert sizes(Q.QUERIES["fastpam_fit"](spark, d)) == (500 * np.bincount(M.fastpam(EUCLIDEAN.pairwise(x, x), w, 3).slot)).tolist()


def scattered(spark, n=400):
    """Points at few places and far from all, two without a place."""
    rng = np.random.default_rng(11)
    x = np.vstack([np.round(rng.normal(size=(n - 42, 2)) * 2, 1), rng.uniform(-300, 300, (40, 2)), [[np.nan, 0], [np.inf, 1]]])
    return x, P.from_rows(spark, x, rng.integers(0, 4, n).astype(float), 3).df


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("metric", [EUCLIDEAN, MANHATTAN])
def test_edges_meet_once_and_nothing_is_broadcast(spark, metric):
    x, df = scattered(spark)
    got = epsilon.grid_pairs(df, 0.75, metric)
    assert "Broadcast" not in plan(got)
    i, j = np.nonzero(metric.within_pairs(x, x, 0.75))
    assert sorted(map(tuple, got.collect())) == sorted(zip(i[i < j].tolist(), j[i < j].tolist(), strict=True))


def test_nearest_core_at_any_distance_on_grids(spark, monkeypatch):
    x, df = scattered(spark)
    want = dbscan.DBSCANpp(0.7, 6, 1.0, assign="closest").fit(P.PointSet(df)).transform(df).orderBy("rid").collect()
    monkeypatch.setattr(dbscan, "MOST_DISTANCES", 0)
    for most in (0, 1 << 40):
        monkeypatch.setattr(models, "FAR_DISTANCES", most)
        model = dbscan.DBSCANpp(0.7, 6, 1.0, assign="closest").fit(P.PointSet(df))
        assert model.grid is not None and model.num_clusters > 1
        assert [r["label"] for r in model.transform(df).orderBy("rid").collect()] == [r["label"] for r in want]


@pytest.mark.parametrize("metric", [EUCLIDEAN, MANHATTAN])
def test_mass_on_cells_without_a_join_of_all_pairs(spark, metric):
    x, df = scattered(spark)
    got = epsilon.mass_within_table(df, df, 0.75, metric)
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    _, _, w = P.PointSet(df).collect()
    want = metric.within_pairs(x, x, 0.75) @ w
    assert [r["mass"] for r in got.orderBy("cid").collect()] == want.tolist()


@pytest.fixture
def part_table(spark, tmp_path):
    """700 parts at 35 places."""
    rng = np.random.default_rng(4)
    places = [(int(s), 900 + float(p)) for s, p in zip(rng.integers(1, 40, 35), rng.integers(0, 30, 35), strict=True)]
    spark.createDataFrame([(i, *places[i % 35]) for i in range(700)], "p_partkey long, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path), np.array([[s, p - 900] for s, p in places])[np.arange(700) % 35]


def test_components_come_from_cells(spark, part_table, monkeypatch):
    d, x = part_table
    monkeypatch.setattr(epsilon, "grid_pairs", refuse)
    got = {r["rid"]: r["component"] for r in Q.eps_components(spark, d).collect()}
    number = epsilon.core_components(spark, x, Q.EPS, EUCLIDEAN)
    assert got == {i: int(np.flatnonzero(number == c)[0]) for i, c in enumerate(number)} and len(set(got.values())) > 1


def test_counts_stay_in_tables(spark, part_table, monkeypatch):
    d, x = part_table
    monkeypatch.setattr(P.PointSet, "collect", refuse)
    want = EUCLIDEAN.within_pairs(x, x, Q.EPS).sum(1)
    assert [r["n"] for r in Q.eps_counts(spark, d).orderBy("rid").collect()] == want.tolist()


@pytest.fixture
def embedding_table(spark, tmp_path):
    """120 vectors of 64 numbers in four labels, some of them copies or nearly so."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 64)) * 0.12 + np.repeat(np.eye(4, 64), 30, 0)
    x[7], x[40] = x[3], x[35] + 1e-9
    x = x.astype(np.float32)
    spark.createDataFrame([(i * 3, v.tolist(), i // 30) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path), x.astype(float)


@pytest.mark.parametrize(("name", "metric"), [("dist_manhattan", MANHATTAN), ("dist_cosine", COSINE), ("dist_unit_sphere", UNIT_SPHERE), ("dist_euclidean", EUCLIDEAN)])
def test_distances_of_all_pairs_by_kernels(spark, embedding_table, monkeypatch, name, metric):
    d, x = embedding_table
    monkeypatch.setattr(Q, "_pairs", refuse)
    monkeypatch.setattr(pairs, "BLOCK", (7, 11))
    got = {(r["a"], r["b"]): r["d"] for r in Q.QUERIES[name](spark, d).collect()}
    want = metric.pairwise(x, x)
    assert sorted(got) == [(3 * a, 3 * b) for a in range(120) for b in range(a + 1, 120)]
    assert all(abs(v - want[a // 3, b // 3]) < 6e-7 for (a, b), v in got.items()) and (got[9, 21] == 0 or metric is UNIT_SPHERE)


def test_pairs_meet_once_through_chunks(spark, embedding_table):
    d, x = embedding_table
    df = Q.embeddings(spark, d)
    made = pairs.with_later(df, lambda a, x, b, y, later: [a[np.nonzero(later)[0]], b[np.nonzero(later)[1]]], "a long, b long", 8 * 64 * 20)
    assert sorted(map(tuple, made.collect())) == [(3 * a, 3 * b) for a in range(120) for b in range(a + 1, 120)]
    assert pairs.distance_rows(df.withColumn("features", F.slice("features", 1, (F.col("rid") % 3 + F.col("label") + 1).cast("int"))), EUCLIDEAN) is None


@pytest.mark.parametrize(("name", "metric"), [("dist_euclidean", EUCLIDEAN), ("dist_manhattan", MANHATTAN), ("dist_cosine", COSINE), ("dist_unit_sphere", UNIT_SPHERE)])
def test_equal_distances_stand_together(spark, embedding_table, monkeypatch, name, metric):
    """Every task hands on the pairs of a tile in order of their distances, each pair once, through one tile or many."""
    d, x = embedding_table
    want = metric.pairwise(x, x)
    for tile in (1 << 24, 60):
        monkeypatch.setattr(pairs, "TILE", tile)
        rows = Q.QUERIES[name](spark, d).withColumn("task", F.spark_partition_id()).collect()
        assert sorted((r["a"], r["b"]) for r in rows) == [(3 * a, 3 * b) for a in range(120) for b in range(a + 1, 120)]
        assert all(abs(r["d"] - want[r["a"] // 3, r["b"] // 3]) < 6e-7 for r in rows)
        by_task = [[r["d"] for r in rows if r["task"] == k] for k in {r["task"] for r in rows}]
        assert tile == 60 or len(by_task) > 1 and all(own == sorted(own) for own in by_task)


def test_pairs_without_order_are_kept():
    """Distances that are no numbers, infinite, too far for a key or below zero."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(50, 9))
    x[3, 0], x[8, 1], x[20], x[31, 2] = np.nan, np.inf, 1e8, 1e300
    a = np.arange(0, 100, 2)
    for metric in (EUCLIDEAN, MANHATTAN, COSINE, UNIT_SPHERE):
        with np.errstate(all="ignore"):
            pieces = list(pairs.by_distance(a, x, a, x, a > a[:, None], metric, (7, 11)))
            want = metric.pairwise(x, x)
        got = {(i, j): d for p in pieces for i, j, d in zip(*p, strict=True)}
        assert sum(len(p[0]) for p in pieces) == len(got) and sorted(got) == [(i, j) for i in a for j in a[a > i]]
        at = np.array([(i // 2, j // 2) for i, j in got])
        assert np.allclose(list(got.values()), want[at[:, 0], at[:, 1]], rtol=1e-9, atol=6e-7, equal_nan=True)


def test_products_lose_no_digits():
    rng = np.random.default_rng(3)
    x = 1e4 + rng.normal(size=(40, 64)) * np.array([1e-6, 1.0])[np.arange(40) % 2, None]
    x[5], x[8, 0], x[9, 0] = x[4], np.nan, np.inf
    with np.errstate(invalid="ignore"):
        assert np.allclose(pairs.distances(x, x, EUCLIDEAN), EUCLIDEAN.pairwise(x, x), rtol=1e-12, atol=0, equal_nan=True)


def test_distances_up_to_a_bound_by_kernels(spark, embedding_table, monkeypatch):
    d, x = embedding_table
    monkeypatch.setattr(Q, "_pairs", refuse)
    far = EUCLIDEAN.pairwise(x, x)
    got = {r["a"]: r for r in Q.distance_up_to(spark, d).collect()}
    assert sorted(got) == [3 * a for a in range(119)]
    for a in range(119):
        own = far[a, a + 1 :]
        assert got[3 * a]["beyond"] == (own > 1.3).sum() and abs(got[3 * a]["total"] - own[own <= 1.3].sum()) < 1e-6


def test_counts_within_a_radius_by_kernels(spark, embedding_table, monkeypatch):
    d, x = embedding_table
    monkeypatch.setattr(Q, "_pairs", refuse)
    far = EUCLIDEAN.pairwise(x, x)
    got = {r["a"]: r["n"] for r in Q.within_radius(spark, d).collect()}
    assert got == {3 * a: int((far[a, a + 1 :] <= 1.3).sum()) for a in range(119)}


def test_silhouettes_by_the_kernel(spark, embedding_table, monkeypatch):
    d, x = embedding_table
    monkeypatch.setattr(evaluate, "SCORE_BLOCK", (9, 13))
    t = evaluate.silhouette_table(Q.labelled(spark, d), EUCLIDEAN)
    assert "Join" not in plan(t)
    far, label = EUCLIDEAN.pairwise(x, x), np.repeat(np.arange(4), 30)
    means = np.stack([far[:, label == c].sum(1) for c in range(4)], 1) / np.where(label[:, None] == np.arange(4), 29, 30)
    a = means[np.arange(120), label]
    means[np.arange(120), label] = np.inf
    want = (means.min(1) - a) / np.maximum(means.min(1), a)
    assert np.allclose([r["s"] for r in t.orderBy("rid").collect()], want)
    s = evaluate.silhouette(Q.labelled(spark, d).withColumn("weight", F.lit(1.0)), EUCLIDEAN, None)
    assert s.scored == 120 and s.score == pytest.approx(want.mean())


def test_full_silhouette_of_more_than_50000_rows(spark):
    """Told as 50,001 rows, scored as the few that they are."""
    x = np.array([[0.0], [0.1], [5.0], [5.1]])
    df = P.from_rows(spark, x).df.withColumn("label", (F.col("rid") >= 2).cast("int"))
    s = evaluate.silhouette(df, EUCLIDEAN, None, rows=50_001)
    assert s.scored == 4 and s.score == pytest.approx(1 - 0.1 / 5.0, abs=1e-3)
