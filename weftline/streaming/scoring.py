"""Labels for unbounded inputs: fitted models are stateless projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.models import Model


def score_stream(model: Model, stream: DataFrame) -> DataFrame:
    """``stream`` (with ``features``) and ``label``; works on any streaming DataFrame."""
    if not stream.isStreaming:
        raise ValueError("not a stream; use model.transform")
    return model.transform(stream)


def write_labels(labelled: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append labelled rows as Parquet; processes what is there and ends."""
    return labelled.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
