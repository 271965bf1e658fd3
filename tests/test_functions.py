import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import randomness as R
from weftline.functions import vectors as V


def test_java_random_known_answers():
    assert [R.JavaRandom(42).next_int() for _ in range(1)] == [-1170105035]
    r = R.JavaRandom(42)
    assert [r.next_double() for _ in range(3)] == [0.7275636800328681, 0.6832234717598454, 0.30871945533265976]
    r = R.JavaRandom(42)
    assert [r.next_gaussian() for _ in range(3)] == pytest.approx([1.1419053154730547, 0.9194079489827879, -0.9498666368908959], abs=1e-12)
    r = R.JavaRandom(42)
    assert [r.next_int(1000) for _ in range(5)] == [130, 763, 248, 884, 970]
    assert [R.JavaRandom(7).next_int(48)] == [28]


def test_permutations_and_draws():
    assert R.permutation(10, 42) == [4, 6, 2, 1, 7, 9, 8, 5, 3, 0]
    assert R.permutation(8, 7) == [0, 2, 6, 1, 4, 3, 7, 5]
    assert R.row_uniform(np.array([[1.0, 2.0]]), np.array([3.0]), 42)[0] == 0.2698756618871059
    assert R.row_uniform(np.array([[0.0, 0.0]]), np.array([1.0]), 7)[0] == 0.2978681947501871
    skips = R.geometric_skips(7, 0, 0.05, 0)
    assert [next(skips) for _ in range(5)] == [25, 21, 9, 24, 44]
    skips = R.geometric_skips(7, 0, 0.05, 1)
    assert [next(skips) for _ in range(5)] == [7, 22, 6, 37, 16]


def test_mixture_known_answers_and_independence_of_batches():
    rows = R.mixture_points(np.arange(3), 42)
    assert rows[0] == pytest.approx([201.10274449778746, 198.8487633918313, 198.76857745040428], abs=1e-12)
    assert rows[2] == pytest.approx([4.8961903432543785, 2.2131467040093025, 4.941209889554311], abs=1e-12)
    assert (R.mixture_points(np.arange(1000), 42)[500:510] == R.mixture_points(np.arange(500, 510), 42)).all()


def test_take_random_spans_the_input():
    taken = R.take_random(list(range(20_000)), 500, 5)
    assert 8000 < np.mean(taken) < 12000 and max(taken) > 18000


@pytest.mark.parametrize("metric", [V.EUCLIDEAN, V.MANHATTAN, V.COSINE, V.UNIT_SPHERE], ids=lambda m: m.name)
def test_columns_agree_with_kernels(spark, metric):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(40, 5)), rng.normal(size=(40, 5))
    a[0], b[1] = 0, 0
    df = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b, strict=True))], "i int, x array<double>, y array<double>")
    r = 1.5
    rows = df.select("i", metric.column(F.col("x"), F.col("y")).alias("d"), metric.within(F.col("x"), F.col("y"), r).alias("w"), metric.up_to(F.col("x"), F.col("y"), r).alias("u")).orderBy("i").collect()
    full = np.diag(metric.pairwise(a, b))
    assert [x["d"] for x in rows] == pytest.approx(full.tolist(), abs=1e-12)
    assert [x["w"] for x in rows] == np.diag(metric.within_pairs(a, b, r)).tolist()
    assert all(x["u"] == pytest.approx(x["d"]) if x["d"] <= r else math.isinf(x["u"]) for x in rows)


def test_edges_of_distances(spark):
    df = spark.createDataFrame([([0.0, 0.0], [3.0, 4.0], [float("nan"), 1.0])], "a array<double>, b array<double>, n array<double>")
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    row = df.select(V.EUCLIDEAN.within(a, b, 5.0), V.MANHATTAN.within(a, b, 7.0), V.EUCLIDEAN.within(a, n, 1e9), V.cosine(a, a), V.l2_normalize(a), V.l2_normalize(b)).first()
    assert list(row) == [True, True, False, 1.0, [0.0, 0.0], pytest.approx([0.6, 0.8])]
    weights = spark.createDataFrame([(x,) for x in (1.5, -1.0, float("nan"), float("inf"), 0.0)], "w double")
    assert [r[0] for r in weights.select(V.sanitize_weight(F.col("w"))).collect()] == [1.5, 0, 0, 0, 0]
    assert V.compare_by_coordinates([1, 2], [1, 2, 3]) == -1 and V.compare_by_coordinates([2], [1, 9]) == 1
    assert sorted(r[0] for r in spark.range(7).select(V.balanced_row(F.col("id"), 7)).collect()) == list(range(7))
