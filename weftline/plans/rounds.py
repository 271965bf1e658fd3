"""Iteration: a driver loop over cached points, one Spark job for each round.

State is a small driver value that each round broadcasts; the points' plan never grows with the
rounds, so a lost executor costs the recomputation of its cached partitions alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark import StorageLevel

from ..sources.points import PointSet


@dataclass
class Decision:
    state: Any
    stop: bool = False


def run_rounds(points: PointSet, state: Any, measure: Callable[[Any, Any], Any], decide: Callable[[int, Any, Any], Decision]) -> Any:
    """``measure(df, state)`` runs a job over the cached points, ``decide(round, state, stats)`` gives the next state."""
    df = points.df.select("rid", "features", "weight").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        epoch = 0
        while True:
            step = decide(epoch, state, measure(df, state))
            if step.stop:
                return step.state
            state, epoch = step.state, epoch + 1
    finally:
        df.unpersist()
