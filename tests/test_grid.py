import numpy as np
import pytest

from weftline.functions.vectors import COSINE, EUCLIDEAN, MANHATTAN
from weftline.operators import sampling
from weftline.operators.assign import Windows, nearest_within
from weftline.plans.dbscan import DBSCANpp
from weftline.sources import points as P


def cloud(d, seed):
    rng = np.random.default_rng(seed)
    thick = rng.normal(size=(150, d)) * 0.15
    path = np.linspace(-4, 4, 120)[:, None] + rng.normal(size=(120, d)) * 0.15
    return np.vstack([thick, path, rng.uniform(-5, 5, (60, d)), np.repeat(rng.uniform(-5, 5, (1, d)), 30, 0), np.round(rng.uniform(-3, 3, (80, d)) * 2) / 2])


@pytest.mark.parametrize(("d", "metric", "fraction", "eps"), [(1, EUCLIDEAN, 0.4, 0.03), (2, EUCLIDEAN, 1.0, 0.35), (2, MANHATTAN, 0.5, 0.45), (3, EUCLIDEAN, 1.0, 0.6)])
def test_tables_equal_the_broadcast_way(spark, d, metric, fraction, eps):
    x = cloud(d, d)
    weights = np.random.default_rng(9).integers(0, 3, len(x)).astype(float)
    p = P.from_rows(spark, x, weights, 4)
    want = DBSCANpp(eps, 7, fraction, metric).fit(p)
    got = DBSCANpp(eps, 7, fraction, metric, candidate_bytes=0).fit(p)
    assert got.num_clusters == want.num_clusters > 1 and got.cores.count() == len(want.cores)
    assert [r["label"] for r in got.transform(p.df).orderBy("rid").collect()] == want.predict_all(x).tolist()
    other = np.vstack([cloud(d, 77), np.full((1, d), 99.0), np.full((1, d), np.nan)])
    assert got.predict_all(other).tolist() == want.predict_all(other).tolist()


def test_odd_inputs_in_tables(spark):
    x = [(0.0, 0.0), (0.1, 0.0), (float("nan"), 0.0), (float("inf"), 1.0), (0.5, 0.0)]
    # the negative weight within the radius undoes the mass of the own cell
    p = P.from_rows(spark, x, [5, 5, 9, 9, -8])
    want, got = (DBSCANpp(1, 4, 1.0, candidate_bytes=b).fit(p) for b in (1 << 20, 0))
    assert got.cores.count() == len(want.cores) == 0 and set(got.predict_all(np.array(x))) == {-1} and got.num_clusters == 0


@pytest.mark.parametrize(("d", "metric", "assign", "eps"), [(5, EUCLIDEAN, "eps", 1.1), (2, EUCLIDEAN, "closest", 0.35), (4, COSINE, "eps", 0.02), (2, MANHATTAN, "eps", 1e-12)])
def test_chunks_equal_the_broadcast_way(spark, d, metric, assign, eps):
    """More dimensions, other metrics, every row assigned, and coordinates too fine for cells."""
    x = cloud(d, d)
    p = P.from_rows(spark, x, np.random.default_rng(9).integers(0, 3, len(x)).astype(float), 4)
    want = DBSCANpp(eps, 7, 0.9, metric, assign=assign).fit(p)
    got = DBSCANpp(eps, 7, 0.9, metric, assign=assign, candidate_bytes=2500 * d).fit(p)
    assert got.grid is None and got.num_clusters == want.num_clusters >= 1 and got.cores.count() == len(want.cores)
    assert [r["label"] for r in got.transform(p.df).orderBy("rid").collect()] == want.predict_all(x).tolist()
    other = np.vstack([cloud(d, 77), np.full((1, d), 99.0), np.full((1, d), np.nan)])
    assert got.predict_all(other).tolist() == want.predict_all(other).tolist()


def test_cores_in_tables_label_streams(spark, tmp_path):
    x = cloud(2, 2)
    p = P.from_rows(spark, x, np.ones(len(x)), 4)
    model = DBSCANpp(0.35, 7, 1.0, candidate_bytes=2000).fit(p)
    assert model.grid is not None
    p.df.write.parquet(str(tmp_path / "in"))
    stream = model.transform(spark.readStream.schema(p.df.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("labelled").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [r["label"] for r in spark.table("labelled").orderBy("rid").collect()] == [r["label"] for r in model.transform(p.df).orderBy("rid").collect()]


@pytest.mark.parametrize("metric", [EUCLIDEAN, MANHATTAN, COSINE])
def test_windows_hold_all_pairs_within_reach(metric):
    rng = np.random.default_rng(5)
    x, own = np.round(rng.uniform(-3, 3, (700, 2)), 1), np.round(rng.uniform(-3, 3, (300, 2)), 1)
    x[5], x[6], own[3] = np.nan, np.inf, np.nan
    windows = Windows(own, 0.5, metric)
    assert (windows.axis is None) == (metric is COSINE)
    near = np.zeros((700, 300), bool)
    for rows, s in windows.meet(x, 64):
        near[np.ix_(rows, windows.order[s])] |= metric.within_pairs(x[rows], windows.points[s], 0.5)
    assert (near == metric.within_pairs(x, own, 0.5)).all()
    index, d = nearest_within(x, windows, metric, 0.5)
    full = metric.pairwise(x, own)
    full[np.isnan(full)] = np.inf
    hit = near[np.arange(700), full.argmin(1)] & np.isfinite(full.min(1))
    assert (index == np.where(hit, full.argmin(1), -1)).all() and (d[hit] == full.min(1)[hit]).all()


def test_large_samples_are_the_same(spark, monkeypatch):
    df = spark.range(3000).withColumnRenamed("id", "rid")
    want = {r["rid"] for r in sampling.exact_sample(df, 700, 3).collect()}
    monkeypatch.setattr(sampling, "SORTED_ROWS", 10)
    monkeypatch.setattr(sampling, "SLOT_BITS", 4)
    assert {r["rid"] for r in sampling.exact_sample(df, 700, 3).collect()} == want and len(want) == 700
    assert sampling.exact_sample(df, 5000, 3).count() == 3000
