"""Scoring pairs as they arrive: micro-batches through a batch operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_pairs(source: DataFrame, operator: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Every micro-batch of ``source`` goes through ``operator`` and is written under its batch number.

    A repeated batch overwrites its own folder, so results stay exactly-once.
    """

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_votes(source: DataFrame, late: str = "1 day", window: str = "1 hour") -> DataFrame:
    """Rows and mean target per event-time window; rows later than ``late`` are left to a batch run."""
    return source.withWatermark("scored_at", late).groupBy(F.window("scored_at", window)).agg(F.count(F.lit(1)).alias("n"), F.avg("target").alias("mean_target")).select(F.col("window.start").alias("start"), "n", "mean_target")
