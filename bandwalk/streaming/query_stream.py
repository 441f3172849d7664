"""Answering a stream of queries over a fixed index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def answer_stream(queries: DataFrame, answer: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Start a stream that writes ``answer(batch)`` for every micro-batch of ``queries`` to ``path``.

    Each batch has a folder of its own, so a batch that is replayed replaces what it wrote.
    """

    def each(batch: DataFrame, number: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
