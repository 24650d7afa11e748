"""Totals, heavy hitters, ranked vocabulary and word probabilities, exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import small, staged

THRESHOLD = 1e-4
MIN_COUNT = 5
#: Slices up to which their totals (a row each) are broadcast.
BROADCAST_SLICES = 100_000


def totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("slice").agg(F.sum("n").alias("total"))


def heavy_hitters(counts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Words whose count is over ``floor(total * threshold)``: fewer than 1 / threshold a slice, once the total is 1 / threshold or more."""
    over = F.col("n") > F.floor(F.col("total") * F.lit(threshold))
    # Slices are a key of few values: the totals go to the counts, not the counts to a task for each slice.
    by_slice = small(staged(totals(counts)), BROADCAST_SLICES)
    return counts.join(by_slice, "slice").where(over).select("slice", "word", "n", "total")


#: Keys that a state of :func:`top_states` tracks. As long as a range has under three quarters as many different keys, its counts are exact.
TRACKED = 10_000


def top_states(keys: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """(slice, part, total, state) of ``keys`` (slice, part, key): mergeable states of the most frequent keys of each slice and part (a day, say), to be kept as a table.

    A state is bounded whatever the number of keys. Null keys count for nothing.
    """
    rows = keys.where("key is not null")
    return rows.groupBy("slice", "part").agg(F.count("*").alias("total"), F.call_function("approx_top_k_accumulate", F.col("key"), F.lit(tracked)).alias("state"))


def range_heavy_hitters(states: DataFrame, by: str | Column, threshold: float = THRESHOLD, tracked: int = TRACKED) -> DataFrame:
    """(slice, range, key, estimate, total) of the keys over ``floor(total * threshold)`` in each range of parts, from states alone; ``by`` says which range a part is in.

    An estimate is never over the true count by more than what the merged states have dropped, under total / (0.75 * ``tracked``) or so; with
    fewer keys than that it is exact.
    """
    merged = states.groupBy("slice", (F.col(by) if isinstance(by, str) else by).alias("range")).agg(F.sum("total").alias("total"), F.call_function("approx_top_k_combine", F.col("state"), F.lit(tracked)).alias("state"))
    top = merged.select("slice", "range", "total", F.explode(F.call_function("approx_top_k_estimate", F.col("state"), F.lit(tracked))).alias("one"))
    rows = top.select("slice", "range", F.col("one.item").alias("key"), F.col("one.count").alias("estimate"), "total")
    return rows.where(F.col("estimate") > F.floor(F.col("total") * F.lit(threshold)))


def ranked(counts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Vocabulary (slice, word, rank, n, total): rank 0 is the most frequent, ties by word."""
    order = Window.partitionBy("slice").orderBy(F.col("n").desc(), "word")
    return heavy_hitters(counts, threshold).select("slice", "word", (F.row_number().over(order) - 1).alias("rank"), "n", "total")


def marginals(vocabulary: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """Probabilities of the words with more than ``min_count`` occurrences."""
    return vocabulary.where(F.col("n") > min_count).withColumn("p", F.col("n") / F.col("total"))
