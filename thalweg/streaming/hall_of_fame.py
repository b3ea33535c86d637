"""Model results as a stream: a hall of fame kept up to date batch by batch, and windowed statistics of fitness."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.inference import merge_top


def keep_top(path: str, k: int) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: merges each batch of models into the table at path, of at most k rows.

    Each batch writes a version of its own, named by its number, so a batch that is run again after a failure overwrites
    its own version and reads that of the batch before: exactly-once results.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{path}/batch={number - 1}") if number else batch.limit(0)
        merge_top(old, batch, k).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return merge


def fitness_windows(results: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """results: a stream of (ts, fitness) -> per window the number, worst, best and mean; windows close `late` after."""
    return results.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(
        F.count(F.lit(1)).alias("n"), F.min("fitness").alias("worst"), F.max("fitness").alias("best"), F.avg("fitness").alias("mean")
    )
