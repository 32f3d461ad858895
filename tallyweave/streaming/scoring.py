"""Resumable scoring: query files as a stream, each micro-batch an output partition of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.records import Manifest


def score_stream(
    spark: SparkSession,
    queries_path: str,
    schema,
    out: str,
    score: Callable[[DataFrame], DataFrame],
    settings: dict | None = None,
    files_per_batch: int = 1,
    file_format: str = "parquet",
) -> int:
    """Score all query files that are not scored yet; returns the number of batches of this run.

    score: queries -> rows (a join with static tables is fine, it is stateless). A batch that is run
    again after a failure overwrites its own partition, so nothing is doubled. Other settings than those
    of the first run are refused."""
    Manifest(out).ensure(settings or {})
    done = 0

    def write(batch: DataFrame, batch_id: int) -> None:
        nonlocal done
        score(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        done += 1

    source = spark.readStream.format(file_format).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(queries_path)
    query = source.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return done


def scored(spark: SparkSession, out: str) -> DataFrame:
    """All batches' rows; the same query scored twice is an error of the input, not hidden here."""
    return spark.read.option("basePath", out).parquet(f"{out}/batch_id=*")


def missing_batches(expected: DataFrame, done: DataFrame) -> DataFrame:
    """Batch numbers that have no rows yet."""
    return expected.select("batch_id").distinct().join(done.select(F.col("batch_id").cast("bigint").alias("batch_id")).distinct(), "batch_id", "left_anti")
