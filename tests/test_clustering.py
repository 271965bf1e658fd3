import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions.vectors import COSINE, EUCLIDEAN, PLANE, SPHERE
from weftline.operators import epsilon, evaluate, sampling, sums
from weftline.plans import medoids as M
from weftline.plans.bisecting import BisectingKMeans
from weftline.plans.dbscan import DBSCANpp
from weftline.plans.kmeans import BreathingKMeans, KMeans
from weftline.sources import points as P
from weftline.streaming import scoring


def grid(x, y, n, step):
    return [(x + i * step, y + j * step) for i in range(n) for j in range(n)]


BLOBS = np.array(grid(0, 0, 4, 0.2) + grid(20, 0, 4, 0.2) + grid(0, 20, 4, 0.2))
TRUTH = np.repeat([0, 1, 2], 16)
DENSE = np.array(grid(0, 0, 5, 0.3) + grid(10, 10, 5, 0.3) + [(50, 50)])


def same_partition(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def points(spark, rows, weights=None):
    return P.from_rows(spark, rows, weights)


@pytest.mark.parametrize(
    "make",
    [lambda: KMeans(3, 20, seed=7), lambda: BreathingKMeans(3, 20, seed=42, m0=5, max_cycles=10), lambda: BisectingKMeans(3), lambda: BisectingKMeans(3, trials=3, select="size"), lambda: M.LocalMedoids(3), lambda: M.LocalMedoids(3, solver="fasterpam"), lambda: M.DistributedFastPAM(3), lambda: M.Clara(3, num_samples=4, sample_size=24), lambda: M.Pamae(3, num_samples=4, sample_size=24, pool_size=24)],
)
def test_blobs_are_recovered(spark, make):
    p = points(spark, BLOBS)
    model = make().fit(p)
    labels = model.predict_all(BLOBS)
    assert same_partition(labels, TRUTH)
    assert [r["label"] for r in model.transform(p.df).orderBy("rid").collect()] == labels.tolist()


def test_breathing_escapes_where_lloyd_is_trapped(spark):
    p = points(spark, BLOBS)
    lloyd, breathing = KMeans(3, 20, seed=42).fit(p), BreathingKMeans(3, 20, seed=42, m0=5, max_cycles=10).fit(p)
    cost = lambda m: sums.cell_stats(p.df, m.prototypes, EUCLIDEAN).error.sum()
    assert not same_partition(lloyd.predict_all(BLOBS), TRUTH) and cost(breathing) < cost(lloyd)


def test_weighted_mean_and_spherical(spark):
    assert KMeans(1).fit(points(spark, [(0.0,), (10.0,)], [1, 9])).prototypes[0, 0] == pytest.approx(9.0)
    rays = np.array([(1, 0), (50, 0.5), (10, 0.1), (0, 1), (0.5, 50), (0.1, 10)])
    m = KMeans(2, geometry=SPHERE).fit(points(spark, rays))
    assert same_partition(m.predict_all(rays), [0, 0, 0, 1, 1, 1]) and np.linalg.norm(m.prototypes, axis=1) == pytest.approx([1, 1])


def test_bisecting_stops_on_equal_rows(spark):
    assert BisectingKMeans(3).fit(points(spark, [(1.0, 1.0)] * 6)).num_clusters == 1
    with pytest.raises(ValueError, match="too small"):
        BisectingKMeans(3).fit(points(spark, [(1.0,)]))
    with pytest.raises(ValueError):
        BisectingKMeans(2, select="other")


def test_nearest_cache_equals_recomputation():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 4))
    d, w = EUCLIDEAN.pairwise(x, x), rng.integers(1, 4, 120).astype(float)
    for k in (1, 2, 5):
        near = M.Nearest(d, list(range(k)))
        for _ in range(60):
            slot, c = int(rng.integers(k)), int(rng.integers(120))
            if c in near.medoids:
                continue
            change = M.swap_deltas(d, w, near, np.array([c]))[slot, 0]
            before = near.cost(w)
            near.swap(slot, c)
            fresh = M.Nearest(d, near.medoids)
            assert np.array_equal(near.first, fresh.first) and np.array_equal(near.second, fresh.second)
            assert near.cost(w) - before == pytest.approx(change)


def test_local_and_distributed_fastpam_agree(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 2)) + np.repeat([[0, 0], [9, 0], [0, 9]], 30, axis=0)
    a, b = M.LocalMedoids(3).fit(points(spark, x)), M.DistributedFastPAM(3).fit(points(spark, x))
    assert np.array_equal(a.prototypes, b.prototypes)
    c = M.LocalMedoids(3, solver="fasterpam").fit(points(spark, x))
    cost = lambda m: M.set_costs(points(spark, x).df, [m.prototypes], EUCLIDEAN)[0]
    assert cost(c) == pytest.approx(cost(a), rel=0.05)


def test_pamae_is_no_worse_than_clara(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(600, 2)) * 2 + np.repeat([[0, 0], [30, 0], [0, 30], [30, 30]], 150, axis=0)
    p = points(spark, x)
    cost = lambda m: M.set_costs(p.df, [m.prototypes], EUCLIDEAN)[0]
    options = {"num_samples": 3, "sample_size": 120, "seed": 9}
    assert cost(M.Pamae(4, refine_iters=3, pool_size=200, **options).fit(p)) <= cost(M.Clara(4, **options).fit(p)) + 1e-9


@pytest.mark.parametrize("chunk", [7, 2000])
def test_exact_dbscan(spark, chunk):
    m = DBSCANpp(0.5, 4, 1.0, chunk_size=chunk).fit(points(spark, DENSE))
    assert m.num_clusters == 2 and m.predict_all(DENSE).tolist() == [0] * 25 + [1] * 25 + [-1]
    assert -1 not in DBSCANpp(0.5, 4, 1.0, assign="closest").fit(points(spark, DENSE)).predict_all(DENSE)


def test_dbscan_without_cores_and_masses(spark):
    assert set(DBSCANpp(0.01, 10, 1.0).fit(points(spark, DENSE)).predict_all(DENSE)) == {-1}
    pairs = [(0, 0), (0.4, 0), (10, 0), (10.4, 0), (30, 0), (30.4, 0)]
    m = DBSCANpp(1, 8, 1.0).fit(points(spark, pairs, [1, 1, 5, 5, 4, 4]))
    assert sorted(m.cores[:, 0]) == [10, 10.4, 30, 30.4]
    for bad in ({"eps": 0, "min_pts": 1}, {"eps": 1, "min_pts": 0}, {"eps": 1, "min_pts": 1, "core_fraction": 0}):
        with pytest.raises(ValueError):
            DBSCANpp(**bad)


def test_components_by_both_ways(spark):
    u = epsilon.UnionFind(7)
    u.union(5, 6)
    u.union(1, 3)
    assert u.numbers().tolist() == [0, 1, 2, 1, 3, 4, 4]
    rng = np.random.default_rng(2)
    x = rng.random((60, 2)) * 6
    p = points(spark, x)
    for most in (0, 10_000):
        table = epsilon.components_table(p.df, epsilon.grid_pairs(p.df, 0.8, EUCLIDEAN), most).orderBy("rid").collect()
        assert same_partition([r["component"] for r in table], epsilon.core_components(spark, x, 0.8, EUCLIDEAN).tolist())
    assert [r["component"] for r in epsilon.components_table(p.df, epsilon.grid_pairs(p.df, 1e-9, EUCLIDEAN)).orderBy("rid").collect()] == list(range(60))
    want = EUCLIDEAN.within_pairs(x, x, 0.8).sum(1)
    assert epsilon.mass_within(p.df, x, 0.8, EUCLIDEAN, 13).tolist() == want.tolist()


def labelled(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in f], float(w), label) for i, (f, w, label) in enumerate(rows)], "rid long, features array<double>, weight double, label int")


PAIRS = [((0,), 1, 0), ((2,), 1, 0), ((10,), 1, 1), ((12,), 1, 1)]


def test_indices(spark):
    t = labelled(spark, [*PAIRS, ((500,), 1, -1), ((-500,), 1, -1)])
    assert evaluate.davies_bouldin(t) == pytest.approx(0.2) and evaluate.calinski_harabasz(t) == pytest.approx(50.0)
    assert evaluate.silhouette(t, EUCLIDEAN, None).score == pytest.approx(79 / 99)
    one = labelled(spark, PAIRS[:2])
    assert (evaluate.davies_bouldin(one), evaluate.calinski_harabasz(one), evaluate.silhouette(one, EUCLIDEAN, None).score) == (0, 0, 0)
    s = evaluate.summarize_labels(t)
    assert (s.n_clusters, s.noise_fraction, s.sizes) == (2, pytest.approx(1 / 3), {"-1": 2, "0": 2, "1": 2})


def test_silhouette_goldens(spark):
    twin = labelled(spark, [((0,), 1, 0), ((0,), 1, 0), ((2,), 1, 0), ((10,), 1, 1)])
    assert evaluate.silhouette(twin, EUCLIDEAN, None).score == pytest.approx(0.6375)
    single = labelled(spark, [((0,), 1, 0), ((2,), 1, 0), ((100,), 1, 1)])
    assert evaluate.silhouette(single, EUCLIDEAN, None).score == pytest.approx((0.98 + 96 / 98) / 3)
    zero = labelled(spark, [((0, 0), 1, 0), ((0, 0), 1, 0), ((1, 0), 1, 1), ((0, 1), 1, 1)])
    assert evaluate.silhouette(zero, COSINE, None).score == pytest.approx(0.0)
    weighted, copies = labelled(spark, [((0,), 2, 0), ((2,), 1, 0), ((10,), 3, 1), ((12,), 1, 1)]), labelled(spark, [((0,), 1, 0)] * 2 + [((2,), 1, 0)] + [((10,), 1, 1)] * 3 + [((12,), 1, 1)])
    for score in (lambda t: evaluate.silhouette(t, EUCLIDEAN, None).score, evaluate.davies_bouldin, evaluate.calinski_harabasz):
        assert score(weighted) == pytest.approx(score(copies))


def test_mass_proportional_draw(spark):
    t = labelled(spark, [((0,), 900, 0), ((1,), 100, 0), ((2,), float("nan"), 0), ((3,), 5, -1)])
    n = {r["rid"]: r["count"] for r in sampling.mass_proportional(t, 100, 1000.0, 42).groupBy("rid").count().collect()}
    assert n == {0: 90, 1: 10}


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i), i + 0.5], float(i + 1)) for i in range(20)], "id long, v array<float>, w double")
    df.write.parquet(str(tmp_path / "t"))
    p = P.read_parquet(spark, str(tmp_path / "t"), "v", "w", "id")
    assert p.df.agg(F.sum("weight")).first()[0] == 210 and p.dimension() == 2
    with pytest.raises(ValueError, match="columns: id, v, w"):
        P.read_parquet(spark, str(tmp_path / "t"), "missing")
    with pytest.raises(ValueError, match="array of numbers"):
        P.read_parquet(spark, str(tmp_path / "t"), "w")
    copy = P.materialize(p, f"file://{tmp_path}")
    assert copy.points.known_count == 20 and copy.points.df.count() == 20
    copy.delete()
    null = spark.createDataFrame([(1, None)], "id long, v array<double>")
    with pytest.raises(Exception, match="null in feature column"):
        P.from_dataframe(null, "v").df.collect()


def test_stream_scoring(spark, tmp_path):
    p = points(spark, BLOBS)
    model = KMeans(3, 20, seed=7).fit(p)
    p.df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(P.SCHEMA).parquet(str(tmp_path / "in"))
    scoring.write_labels(scoring.score_stream(model, stream), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("rid").collect()
    assert [r["label"] for r in got] == model.predict_all(BLOBS).tolist()
    with pytest.raises(ValueError):
        scoring.score_stream(model, p.df)


def test_tree_merge_of_partials_gives_the_same_sums(spark, monkeypatch):
    p = P.synthetic(spark, 500, 20)
    one = sums.cell_stats(p.df, BLOBS[:3, [0, 1, 1]], EUCLIDEAN)
    monkeypatch.setattr(sums, "DRIVER_VALUES", 1)
    two = sums.cell_stats(p.df, BLOBS[:3, [0, 1, 1]], EUCLIDEAN)
    assert np.allclose(one.sums, two.sums) and one.count.tolist() == two.count.tolist() and PLANE.name == "euclidean"


def test_partials_merge_by_as_many_levels_as_it_takes(spark, monkeypatch):
    df = points(spark, BLOBS, range(1, 49)).df.repartition(20, "rid")
    one = sums.cell_stats(df, BLOBS[:3], EUCLIDEAN)
    monkeypatch.setattr(sums, "DRIVER_VALUES", 1)
    monkeypatch.setattr(sums, "FAN_IN", 2)
    many = sums.cell_stats(df, BLOBS[:3], EUCLIDEAN)
    assert np.allclose(one.sums, many.sums) and one.count.tolist() == many.count.tolist() and one.error == pytest.approx(many.error)


def test_a_sample_of_files_is_the_same_however_they_are_split(spark, tmp_path):
    points(spark, [(float(i), 0.0) for i in range(4000)]).df.repartition(3).write.parquet(f"{tmp_path}/p")
    take = lambda seed: [r["rid"] for r in P.read_parquet(spark, f"{tmp_path}/p", "features", rid="rid", sample_fraction=0.3, seed=seed).df.orderBy("rid").collect()]
    first = take(1)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        assert take(1) == first != take(2) and abs(len(first) - 1200) < 150
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
