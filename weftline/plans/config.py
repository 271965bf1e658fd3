"""A run's configuration: one JSON document; unknown keys are ignored."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any


@dataclass
class Named:
    name: str
    params: dict[str, Any] = field(default_factory=dict)


@dataclass
class EvaluationSpec:
    metrics: list[str] = field(default_factory=list)
    sample_size: int | None = 10_000
    seed: int = 42


@dataclass
class RunConfig:
    run_id: str
    profile: str = "local"
    output_dir: str = "benchmark-results"
    dataset: Named | None = None
    algorithm: Named | None = None
    evaluation: EvaluationSpec = field(default_factory=EvaluationSpec)
    engine_conf: dict[str, str] = field(default_factory=dict)
    metadata: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def of(document: dict[str, Any]) -> RunConfig:
        """``engineConf``, ``flink_config`` and ``flinkConf`` are one setting; ``sparkConf`` lies under them."""
        if not document.get("runId"):
            raise ValueError("a configuration needs a runId")
        conf = dict(document.get("sparkConf") or {})
        for key in ("flinkConf", "flink_config", "engineConf"):
            conf |= document.get(key) or {}
        evaluation = document.get("evaluation") or {}
        dataset, algorithm = document.get("dataset") or {}, document.get("algorithm") or {}
        return RunConfig(
            str(document["runId"]),
            document.get("profile") or "local",
            document.get("outputDir") or "benchmark-results",
            Named(dataset.get("type", ""), dataset.get("params") or {}),
            Named(algorithm.get("name", ""), algorithm.get("params") or {}),
            EvaluationSpec(list(evaluation.get("metrics") or []), evaluation["sampleSize"] if "sampleSize" in evaluation else 10_000, int(evaluation.get("seed") or 42)),
            {k: str(v) for k, v in conf.items()},
            {k: str(v) for k, v in (document.get("experimentMetadata") or {}).items()},
        )

    @staticmethod
    def from_file(path: str) -> RunConfig:
        with open(path, encoding="utf-8") as f:
            return RunConfig.of(json.load(f))
