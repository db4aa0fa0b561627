"""Serving a fitted pipeline over a stream, and watching each of its batches for drift."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.plans.pipeline import Prepared


def serve(prepared: Prepared, stream: DataFrame) -> DataFrame:
    """The rows of a stream through the pipeline: a projection, without state."""
    return prepared.transform(stream)


def watch(prepared: Prepared, stream: DataFrame, told: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Measures each batch against the tallies of training and hands the distances to `told`."""

    def measure(batch: DataFrame, number: int) -> None:
        told(prepared.watched(prepared.transform(batch)), number)

    return stream.writeStream.foreachBatch(measure).option("checkpointLocation", checkpoint).trigger(**trigger).start()
