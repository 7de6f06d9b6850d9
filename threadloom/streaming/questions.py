"""Structured Streaming wrapper: questions that arrive as files are answered batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def answer_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, retrieve: Callable[[DataFrame], DataFrame], schema: str = "qid long, text string", per_batch: int = 100) -> StreamingQuery:
    """Read new question files, run ``retrieve`` on each micro-batch, write each batch once under its own number.

    A batch that is run again after a failure overwrites its own folder, so
    results are exactly once.
    """
    questions = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).json(folder)

    def handle(batch: DataFrame, number: int) -> None:
        retrieve(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return questions.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
