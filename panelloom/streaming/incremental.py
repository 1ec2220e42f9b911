"""Incremental twins of the batch scans: only new files are processed, and progress is counted by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def process_new(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], target: str, progress: str) -> DataFrame:
    """Appends the transformed rows of files not seen before to `target` and returns the whole of it.

    `progress` is the query's checkpoint folder: a run that is interrupted resumes there, and a run without new files
    adds nothing. `transform` must be stateless.
    """
    rows = transform(spark.readStream.schema(schema).parquet(source))
    rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(target)


def completed_keys(spark: SparkSession, source: str, schema: str, key: str, group: str, target: str, progress: str) -> DataFrame:
    """(group, completed): distinct keys seen so far, kept as state; every batch replaces the counts in `target`."""

    def replace(counts: DataFrame, _: int) -> None:
        counts.write.mode("overwrite").parquet(target)

    seen = spark.readStream.schema(schema).parquet(source).dropDuplicates([key])
    counts = seen.groupBy(group).agg(F.count(F.lit(1)).alias("completed"))
    counts.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(target)
