"""Queries that arrive as a stream, against static postings: an extension beyond the batch plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import blocking as B
from tessera.plans.linkage import link


def link_stream(queries: DataFrame, targets: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, index: B.Index = B.MULTI_CHANNEL) -> StreamingQuery:
    """Links each micro-batch and hands its matches to sink. One owner holds within a batch; the sink settles it across batches."""

    def each(batch: DataFrame, number: int) -> None:
        sink(link(batch, targets, index).matches, number)

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
