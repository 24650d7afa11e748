"""Counting as a stream: the state is what a batch would have summed, so both give the same tables.

A stream's counts are additive. Each micro-batch is counted and written as a delta of its own, a partition of the table named by
the batch's number; replaying a batch after a failure overwrites its own delta and nothing else. Readers sum the deltas; compaction sums those up to a
number into one, which is read from the moment its marker is there. Nothing is held in memory, nor brought to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import sketch, tokens
from ..sources.staging import discard, exists, listed


def additive_stream(rows: DataFrame, counted: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Starts a stream of ``rows`` whose batches, as ``counted`` gives them, become deltas under ``path``. ``checkpoint`` is where the query resumes."""

    def write(batch: DataFrame, number: int) -> None:
        counted(batch).write.mode("overwrite").parquet(f"{path}/delta/{number:012d}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def _state(spark: SparkSession, path: str) -> tuple[str | None, list[str]]:
    """The folder of the newest whole compaction, and the deltas after it."""
    whole = [n for n in listed(spark, f"{path}/base") if exists(spark, f"{path}/base/{n}/_SUCCESS")]
    last = max(whole, default="")
    deltas = [n for n in listed(spark, f"{path}/delta") if n > last and exists(spark, f"{path}/delta/{n}/_SUCCESS")]
    return f"{path}/base/{last}" if last else None, [f"{path}/delta/{n}" for n in sorted(deltas)]


def read_counts(spark: SparkSession, path: str, keys: list[str], count: str = "n") -> DataFrame | None:
    """The counts under ``path`` so far, summed by ``keys``; None before the first batch is written."""
    base, deltas = _state(spark, path)
    parts = [*([base] if base else []), *deltas]
    return spark.read.parquet(*parts).groupBy(*keys).agg(F.sum(count).alias(count)) if parts else None


def compact(spark: SparkSession, path: str, keys: list[str], count: str = "n") -> int:
    """Sums all deltas so far into one table and deletes them and older ones; how many deltas that were.

    A crash at any point loses nothing: the new table counts once it is whole, and deltas it holds are no longer read from then on, deleted or not. A batch that is
    being replayed is newer than what has been summed: Spark starts a batch only after the one before has been written.
    """
    base, deltas = _state(spark, path)
    # The last delta may be replayed after a restart: it stays a delta.
    done = deltas[:-1]
    if not done:
        return 0
    last = done[-1].rsplit("/", 1)[1]
    rows = spark.read.parquet(*([base] if base else []), *done)
    rows.groupBy(*keys).agg(F.sum(count).alias(count)).write.mode("overwrite").parquet(f"{path}/base/{last}")
    discard(spark, *done, *([base] if base else []))
    return len(done)


def sketch_stream(keys: DataFrame, params: sketch.SketchParams, path: str, checkpoint: str) -> StreamingQuery:
    """A growing sketch (sketch, row, bucket, cnt) of a stream of ``key`` values under ``path``; a delta has width * depth rows at most."""
    return additive_stream(keys.select("key"), lambda batch: sketch.build(batch, params, "stream"), path, checkpoint)


def read_sketch(spark: SparkSession, path: str) -> DataFrame | None:
    return read_counts(spark, path, ["sketch", "row", "bucket"], "cnt")


def compact_sketch(spark: SparkSession, path: str) -> int:
    return compact(spark, path, ["sketch", "row", "bucket"], "cnt")


def word_stream(corpus: DataFrame, path: str, checkpoint: str, min_length: int = tokens.MIN_LENGTH) -> StreamingQuery:
    """Growing counts (slice, word, n) of a stream of lines (slice, line) under ``path``."""
    return additive_stream(corpus.select("slice", "line"), lambda batch: tokens.word_counts(batch, min_length), path, checkpoint)


def read_words(spark: SparkSession, path: str) -> DataFrame | None:
    return read_counts(spark, path, ["slice", "word"])


def compact_words(spark: SparkSession, path: str) -> int:
    return compact(spark, path, ["slice", "word"])


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of ``key`` by window of ``ts``; what comes later than ``late`` is left out once its window is closed."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "key").agg(F.count("*").alias("n"))
