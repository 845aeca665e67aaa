"""Uploads as a stream: each micro-batch of new documents goes through the batch plan; no state is kept between batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def analyze_stream(spark: SparkSession, source: str, schema: str, plan: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Parquet files that arrive in source, through plan, to Parquet in sink; a repeated batch overwrites its own folder."""

    def one(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
