"""Score rows as they arrive: the batch operator on a streaming frame.

Scoring keeps no state, so there is no watermark and nothing to recover but
the offsets in the checkpoint of the query.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from panelmill.operators.models import score


def score_stream(
    requests: DataFrame,
    model: PipelineModel,
    keys: Sequence[str],
    labels: Sequence[str],
    path: str,
    checkpoint: str,
) -> StreamingQuery:
    """Append the scores of every available request to a Parquet table, then stop."""
    scored = score(requests, model, keys, labels)
    return (
        scored.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
