import json
import os
import time

import pytest

import __spark_entry__
from weftline.plans import config, registry, run

SF = "/root/testdata/sf0.001"


def document(**changes):
    return {"runId": "r1", "dataset": {"type": "synthetic", "params": {"numPoints": 2000, "numPartitions": 2, "seed": 42}}, "algorithm": {"name": "KMeans", "params": {"k": 5}}, "evaluation": {"metrics": list(run.METRICS), "sampleSize": 500}, "unknown": 1} | changes


def test_a_run_and_its_result(spark, tmp_path):
    result = run.execute(spark, config.RunConfig.of(document()))
    assert (result["status"], result["nRows"], result["nFeatures"]) == ("ok", 2000, 3) and result["nClusters"] > 0
    assert sum(result["clusterSizes"].values()) == 2000 and list(result) == [f for f in run.FIELDS if f in result]
    path = run.write_result(result, str(tmp_path))
    assert json.load(open(path))["runId"] == "r1" and os.listdir(tmp_path) == ["r1.json"]


def test_the_sampler_sees_a_peak_between_two_looks_of_its_caller(spark):
    sampler = run.Sampler(spark).start()
    before = sampler.read()
    kept = spark.sparkContext._gateway.new_array(spark._jvm.byte, 64 << 20)
    time.sleep(0.5)
    del kept
    sampler.stop()
    after = sampler.read()
    assert sampler.executor_peaks() == [int(sampler.peak)] and sampler.peak >= 64 << 20
    assert 0 < sampler.byte_seconds <= sampler.peak * 60 and after["cpu"] >= 0 and before["stage_cpu"] == {}
    assert run.sum_delta({"1.0": 5, "2.0": 9}, {"1.0": 7, "2.0": 3, "3.0": 4}) == 6


def test_failed_runs_are_results(spark):
    for algorithm, word in (({"name": "fastpam", "params": {"k": 9999, "distance": "euclidean"}}, "too small"), ({"name": "clara", "params": {"k": 2}}, "distance"), ({"name": "nothing"}, "Known")):
        result = run.execute(spark, config.RunConfig.of(document(algorithm=algorithm)))
        assert result["status"] == "failed" and word in result["errorMessage"]
    assert "Unknown metrics" in run.execute(spark, config.RunConfig.of(document(evaluation={"metrics": ["x"]})))["errorMessage"]


def test_dbscan_run(spark):
    made = document(dataset={"type": "synthetic", "params": {"numPoints": 800}}, algorithm={"name": "dbscanpp", "params": {"eps": 3, "minPts": 5, "coreSampleFraction": 0.5, "distance": "euclidean"}})
    result = run.execute(spark, config.RunConfig.of(made))
    assert 0 < result["noiseFraction"] < 1 and sum(result["clusterSizes"].values()) == 800


def test_configuration_and_cli():
    c = config.RunConfig.of(document(sparkConf={"a": 1, "b": 1}, flink_config={"b": 2}))
    assert c.engine_conf == {"a": "1", "b": "2"} and c.profile == "local" and c.evaluation.seed == 42
    assert run.main([]) == 64 and run.main(["--help"]) == 0
    assert run.sum_delta({"a": 5, "b": 9}, {"a": 7, "b": 1, "c": 3}) == 5 and run.cores_busy(1, 0) is None
    with pytest.raises(ValueError, match="needs the parameter 'k'"):
        registry.ALGORITHMS.get("KMEANS")(registry.Params({}, "algorithm 'kmeans'"))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["dist_cosine", "assign_cell_stats", "kmeans_weighted", "kmeans_spherical", "bisect_first_split", "bisecting_nations", "breathing_cycle", "distfastpam_small", "pamae_whole", "medoid_build_k", "pamae_refine_round", "eps_mass", "dbscan_exact", "davies_bouldin", "calinski_harabasz", "silhouette_weighted"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    ours, theirs = __spark_entry__.queries()[name](spark, SF).toPandas(), c.sql(__spark_entry__.oracle_sql()[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    a, b = (t[columns].sort_values(columns).reset_index(drop=True) for t in (ours, theirs))
    assert a.equals(b.astype(a.dtypes.to_dict()))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
