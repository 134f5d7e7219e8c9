"""Searching a stream of queries against a built index: an extension, as no part of search needs streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from skerry.operators.index import Index


def search_stream(queries: DataFrame, index: Index, k: int, path: str, checkpoint: str, beam: int = 64) -> StreamingQuery:
    """Answers each micro-batch of (qid, qv) and writes it once under its batch number."""

    def answer(batch: DataFrame, number: int) -> None:
        index.search(batch, k, beam).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
