"""One configuration in, one result out: load, fit, evaluate, write.

``python -m weftline.plans.run --config run.json`` exits with 0, 2 (the run failed; its result says
why) or 64 (usage). A failed run writes its result too.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import threading
import time
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions.vectors import Metric
from ..operators.evaluate import calinski_harabasz_of, davies_bouldin_of, silhouette, summarize_labels
from ..operators.sums import cluster_moments
from .config import RunConfig
from .registry import ALGORITHMS, SOURCES, NamedRegistry, Params

METRICS = ("nClusters", "noiseFraction", "clusterSizes", "silhouette", "daviesBouldin", "calinskiHarabasz")
PROFILES: NamedRegistry[str | None] = NamedRegistry("profile", {"local": "local[*]", "ares": None})
#: The result's fields in their order (a fixed contract).
FIELDS = (
    "runId", "framework", "profile", "startedAtIso", "finishedAtIso", "status", "errorMessage", "algorithm", "algorithmParams", "dataset", "datasetMetadata", "engineConf", "experimentMetadata",
    "nRows", "nPartitions", "nFeatures", "loadDurationMs", "fitDurationMs", "evalDurationMs", "totalDurationMs", "phaseDurationsMs", "phaseCpuTimeNs", "phaseGcTimeMs", "jvmGcTimeMs", "executorCpuTimeNs", "avgCpuCoresBusy", "cpuCoreHours",
    "peakExecutorMemoryBytes", "totalExecutorMemoryBytes", "memoryGbHours", "driverCpuTimeNs", "driverCpuCoreHours", "driverPeakHeapBytes", "driverGcTimeMs", "driverMemoryGbHours",
    "nClusters", "noiseFraction", "silhouette", "silhouetteScoredPoints", "silhouetteSampleClusters", "silhouetteUnscoredPoints", "clusterSizes", "daviesBouldin", "calinskiHarabasz",
)


def cpu_core_hours(ns: float) -> float:
    return ns / 3.6e12


def memory_gb_hours(byte_seconds: float) -> float:
    return byte_seconds / (2**30 * 3600)


def cores_busy(cpu_ns: float, wall_ms: float) -> float | None:
    return cpu_ns / (wall_ms * 1e6) if wall_ms > 0 else None


def sum_delta(before: dict[str, float], after: dict[str, float]) -> float:
    """Growth of per-process counters, none below 0; processes that appeared count whole."""
    return sum(max(0, v - before.get(k, 0)) for k, v in after.items())


class Sampler:
    """Counters of the driver's JVM and of the executors; a thread follows the driver's heap every 200 ms.

    In local mode the driver's JVM is the executor. On a cluster executors' figures come from Spark's status
    store: CPU and collection times of the stages it retains, and the peak of each executor's heap since its
    start (updated with its heartbeats).
    """

    EVERY_S = 0.2

    def __init__(self, spark: SparkSession):
        self.spark, self.beans = spark, spark._jvm.java.lang.management.ManagementFactory
        self.store = spark._jsc.sc().statusStore()
        self.local = bool(re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master))
        self.peak = self.byte_seconds = 0.0
        self.last: tuple[float, float] | None = None
        self.done = threading.Event()
        self.thread = threading.Thread(target=self._follow, daemon=True)

    def start(self) -> Sampler:
        self.note()
        self.thread.start()
        return self

    def stop(self) -> None:
        self.done.set()
        self.thread.join()
        self.note()

    def _follow(self) -> None:
        while not self.done.wait(self.EVERY_S):
            self.note()

    def note(self) -> None:
        """One look at the heap: its peak, and its integral over time by trapezoids."""
        now, used = time.monotonic(), float(self.beans.getMemoryMXBean().getHeapMemoryUsage().getUsed())
        if self.last is not None:
            self.byte_seconds += (now - self.last[0]) * (used + self.last[1]) / 2
        self.peak, self.last = max(self.peak, used), (now, used)

    def read(self) -> dict[str, Any]:
        """The driver's CPU and collection times, and those of each retained stage where executors are processes of their own."""
        pools = self.beans.getGarbageCollectorMXBeans()
        gc = sum(max(0, pools[i].getCollectionTime()) for i in range(len(pools)))
        threads = self.beans.getThreadMXBean()
        cpu = sum(max(0, threads.getThreadCpuTime(i)) for i in threads.getAllThreadIds())
        out: dict[str, Any] = {"cpu": cpu, "gc": gc, "stage_cpu": {}, "stage_gc": {}}
        if not self.local:
            jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
            stages = self.store.stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
            for i in range(stages.size()):
                stage = stages.apply(i)
                key = f"{stage.stageId()}.{stage.attemptId()}"
                out["stage_cpu"][key], out["stage_gc"][key] = stage.executorCpuTime(), stage.jvmGcTime()
        return out

    def executor_peaks(self) -> list[int]:
        """The peak heap of each executor."""
        if self.local:
            return [int(self.peak)]
        found, out = self.store.executorList(False), []
        for i in range(found.size()):
            one = found.apply(i)
            if one.id() != "driver" and one.peakMemoryMetrics().isDefined():
                out.append(int(one.peakMemoryMetrics().get().getMetricValue("JVMHeapMemory")))
        return out


def evaluate(labelled: DataFrame, metric: Metric, metrics: list[str], sample_size: int | None, seed: int) -> dict[str, Any]:
    """Only what is asked for; unknown names are an error that lists them."""
    unknown = [m for m in metrics if m not in METRICS]
    if unknown:
        raise ValueError(f"Unknown metrics: {unknown}. Known: {list(METRICS)}")
    out: dict[str, Any] = {}
    if not metrics:
        return out
    summary = summarize_labels(labelled)
    out["nClusters"] = summary.n_clusters
    if "noiseFraction" in metrics:
        out["noiseFraction"] = summary.noise_fraction
    if "clusterSizes" in metrics:
        out["clusterSizes"] = summary.sizes
    if "silhouette" in metrics:
        rows = sum(n for label, n in summary.sizes.items() if label != "-1")
        s = silhouette(labelled, metric, sample_size, seed, summary.masses, rows)
        out |= {"silhouette": s.score, "silhouetteScoredPoints": s.scored, "silhouetteSampleClusters": s.sample_clusters, "silhouetteUnscoredPoints": s.unscored}
    if {"daviesBouldin", "calinskiHarabasz"} & set(metrics):
        moments = cluster_moments(labelled, metric)
        if "daviesBouldin" in metrics:
            out["daviesBouldin"] = davies_bouldin_of(moments, metric)
        if "calinskiHarabasz" in metrics:
            out["calinskiHarabasz"] = calinski_harabasz_of(moments, metric)
    return out


def _iso(t: float) -> str:
    return datetime.fromtimestamp(t, timezone.utc).isoformat().replace("+00:00", "Z")


def execute(spark: SparkSession, config: RunConfig) -> dict[str, Any]:
    """Run a configuration; an error becomes a failed result."""
    started = time.time()
    result: dict[str, Any] = {"runId": config.run_id, "framework": "spark", "profile": config.profile, "startedAtIso": _iso(started), "status": "ok", "algorithm": config.algorithm.name, "algorithmParams": Params(config.algorithm.params, "").as_strings(), "dataset": config.dataset.name, "datasetMetadata": Params(config.dataset.params, "").as_strings(), "engineConf": config.engine_conf, "experimentMetadata": config.metadata, "nRows": 0, "nPartitions": 0}
    phases = dict.fromkeys(("load", "fit", "eval"), 0)
    counters: list[dict[str, float]] = []
    sampler, points, labelled = Sampler(spark).start(), None, None
    try:
        PROFILES.get(config.profile)
        for key, value in config.engine_conf.items():
            if key.startswith("spark.sql."):
                spark.conf.set(key, value)
        counters.append(sampler.read())
        mark = time.time()
        built = ALGORITHMS.get(config.algorithm.name)(Params(config.algorithm.params, f"algorithm '{config.algorithm.name}'"))
        points = SOURCES.get(config.dataset.name)(spark, Params(config.dataset.params, f"data source '{config.dataset.name}'"))
        if str(config.engine_conf.get("clustering.materialize.source", "true")).lower() != "false":
            points = points.persist()
        result["nRows"] = points.count()
        result["nPartitions"] = points.df.rdd.getNumPartitions()
        result["nFeatures"] = points.dimension()
        result["dataset"] = points.label
        phases["load"], mark = int(1000 * (time.time() - mark)), time.time()
        counters.append(sampler.read())
        model = built.clusterer.fit(points)
        phases["fit"], mark = int(1000 * (time.time() - mark)), time.time()
        counters.append(sampler.read())
        labelled = model.transform(points.df).persist()
        result |= evaluate(labelled, built.metric, config.evaluation.metrics, config.evaluation.sample_size, config.evaluation.seed)
        phases["eval"] = int(1000 * (time.time() - mark))
        counters.append(sampler.read())
    except Exception as error:  # noqa: BLE001  every failure is a result
        result |= {"status": "failed", "errorMessage": f"{type(error).__name__}: {error}"[:2000]}
    finally:
        sampler.stop()
        for x in (labelled, points):
            if x is not None:
                x.unpersist()
    finished = time.time()
    total = int(1000 * (finished - started))
    result |= {"finishedAtIso": _iso(finished), "loadDurationMs": phases["load"], "fitDurationMs": phases["fit"], "evalDurationMs": phases["eval"], "totalDurationMs": total, "phaseDurationsMs": phases}
    if len(counters) > 1:
        delta = lambda key, a, b: int(max(0, b[key] - a[key]))
        steps = list(zip(("load", "fit", "eval"), counters, counters[1:], strict=False))
        own_cpu, own_gc = (sum(delta(key, a, b) for _, a, b in steps) for key in ("cpu", "gc"))
        work = delta if sampler.local else lambda key, a, b: int(sum_delta(a[f"stage_{key}"], b[f"stage_{key}"]))
        result["phaseCpuTimeNs"] = {p: work("cpu", a, b) for p, a, b in steps}
        result["phaseGcTimeMs"] = {p: work("gc", a, b) for p, a, b in steps}
        cpu, gc, peaks, held = sum(result["phaseCpuTimeNs"].values()), sum(result["phaseGcTimeMs"].values()), sampler.executor_peaks(), memory_gb_hours(sampler.byte_seconds)
        result |= {"jvmGcTimeMs": gc, "executorCpuTimeNs": cpu, "avgCpuCoresBusy": cores_busy(cpu, total), "cpuCoreHours": cpu_core_hours(cpu)}
        result |= {"driverCpuTimeNs": own_cpu, "driverCpuCoreHours": cpu_core_hours(own_cpu), "driverPeakHeapBytes": int(sampler.peak), "driverGcTimeMs": own_gc, "driverMemoryGbHours": held}
        if peaks:
            # an executor's integral over time is not known on a cluster: its peak stands for the whole run, an upper bound
            result |= {"peakExecutorMemoryBytes": max(peaks), "totalExecutorMemoryBytes": sum(peaks), "memoryGbHours": held if sampler.local else memory_gb_hours(sum(peaks) * total / 1000)}
    return {k: result[k] for k in FIELDS if result.get(k) is not None}


def write_result(result: dict[str, Any], folder: str) -> str:
    """One line of JSON at ``folder``/runId.json, complete or absent."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{result['runId']}.json")
    handle, part = tempfile.mkstemp(dir=folder, prefix=".part")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(json.dumps(result) + "\n")
    os.replace(part, path)
    return path


def main(argv: list[str]) -> int:
    usage = "usage: run [--config] PATH"
    if argv in (["--help"], ["-h"]):
        print(usage)
        return 0
    paths = argv[1:] if argv[:1] == ["--config"] else argv
    if len(paths) != 1 or paths[0].startswith("-"):
        print(usage, file=sys.stderr)
        return 64
    config = RunConfig.from_file(paths[0])
    builder = SparkSession.builder.appName(config.run_id)
    master = PROFILES.entries.get(config.profile.lower())
    if master:
        builder = builder.master(master)
    for key, value in config.engine_conf.items():
        if key.startswith("spark."):
            builder = builder.config(key, value)
    result = execute(builder.getOrCreate(), config)
    print(write_result(result, config.output_dir))
    return 0 if result["status"] == "ok" else 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
