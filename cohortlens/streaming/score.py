"""Score a stream of new records with a fitted training result (M21 on
Structured Streaming).

Everything in the scoring chain is a per-row expression plus the fitted
Spark ML model, so the same plan runs on ``readStream`` sources; the sink
gets input columns + ``risk_probability`` + the High/Low label.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cohortlens.plans.train import batch_score


def score_stream(stream: DataFrame, res, keep: Sequence[str] | None = None) -> DataFrame:
    """Scoring of a streaming (or batch) DataFrame: the batch function itself, which is row-wise."""
    return batch_score(stream, res, keep)


def start_scoring(stream: DataFrame, res, sink_path: str, checkpoint: str, keep: Sequence[str] | None = None,
                  trigger_once: bool = False) -> StreamingQuery:
    """Append scored rows to a Parquet sink with a checkpoint in the shared
    folder (exactly-once file sink, restartable after executor or driver loss)."""
    w = score_stream(stream, res, keep).writeStream.format("parquet").option("path", sink_path) \
        .option("checkpointLocation", checkpoint).outputMode("append")
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
