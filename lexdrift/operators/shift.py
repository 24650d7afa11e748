"""From a sliced corpus to semantic shift and topic evolution, all slices in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged
from . import alignment, embedding, periods, ppmi, topics


@dataclass(frozen=True)
class Model:
    """Tables of all slices; ``skipped`` (slice, stage, reason) has those that couldn't be trained."""

    params: ppmi.Params
    vocabulary: DataFrame
    entries: DataFrame
    embeddings: DataFrame
    skipped: DataFrame


def train(corpus: DataFrame, components: int = embedding.COMPONENTS, params: ppmi.Params = ppmi.Params(), common: bool = True) -> Model:
    """Counts, vocabulary, PPMI and embeddings of every slice of ``corpus`` (slice, .., line), all of them written tables.

    With ``common`` all slices get as many dimensions as the smallest can have, so that they can be aligned.
    An error if no slice has a vocabulary. A slice that fails is a row of ``skipped``; the others are complete.
    """
    vocab, entries = ppmi.prepared(corpus, params)
    if vocab.isEmpty():
        raise ValueError("the corpus has no vocabulary")
    entries = staged(entries)
    k = embedding.common_components(vocab, components) if common else components
    vectors, failed = embedding.attempted(entries, vocab, k)
    none = corpus.select("slice").distinct().join(vocab.select("slice").distinct(), "slice", "left_anti")
    skipped = none.select("slice", F.lit("vocabulary").alias("stage"), F.lit("no vocabulary").alias("reason")).unionByName(failed)
    return Model(params, vocab, entries, staged(vectors), skipped)


def slices_as_periods(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(F.col("slice").alias("period")).distinct()


def shifts(embeddings: DataFrame, pairs: DataFrame, words: list[str] | None = None, low: int | None = None, high: int | None = alignment.MAX_RANK) -> DataFrame:
    """(source, target, label, word, shift): 1 - similarity of each shared word after alignment."""
    fitted, _ = alignment.fit(embeddings, pairs, low, high)
    rows = alignment.stability(embeddings, fitted)
    rows = rows.where(F.col("word").isin(words)) if words is not None else rows
    label = F.concat("source", F.lit("->"), "target")
    return rows.select("source", "target", label.alias("label"), "word", (1 - F.col("similarity")).alias("shift"))


def top_shifts(shift_rows: DataFrame, n: int = 5, descending: bool = True) -> DataFrame:
    """The words of each pair that moved most (or least); words without a direction on a side (NaN) come last."""
    known = F.nanvl("shift", F.lit(None).cast("double"))
    by = known.desc_nulls_last() if descending else known.asc_nulls_last()
    order = Window.partitionBy("source", "target").orderBy(by, "word")
    return shift_rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def consecutive_shifts(embeddings: DataFrame, words: list[str] | None = None) -> DataFrame:
    rows = shifts(embeddings, periods.consecutive(slices_as_periods(embeddings)), words)
    return rows.withColumn("year", periods.period_start("target"))


def cumulative_shifts(embeddings: DataFrame, words: list[str] | None = None) -> DataFrame:
    """From the first period to each later one."""
    rows = shifts(embeddings, periods.from_first(slices_as_periods(embeddings)), words)
    return rows.withColumn("year", periods.period_start("target")).withColumnRenamed("shift", "cumulative_shift")


def stable_words(embeddings: DataFrame, source: str, target: str, n: int = 10) -> DataFrame:
    """The shared words of two slices with the least similarity, ascending."""
    pairs = embeddings.sparkSession.createDataFrame([(source, target)], "source string, target string")
    fitted, _ = alignment.fit(embeddings, pairs)
    return alignment.stability(embeddings, fitted).orderBy("similarity", "word").limit(n)


def topic_evolution(weights: DataFrame, pairs: DataFrame, first: str, min_similarity: float = topics.MIN_SIMILARITY) -> DataFrame:
    """(slice, year, topic_id, chain_id, topic_label, weight, words): chains with the label of their first topic and the weight of the top word."""
    matched = topics.match(topics.similarities(weights, pairs), min_similarity)
    top = topics.top_words(weights)
    start = weights.where(F.col("slice") == first).select("slice", "topic_id").distinct()
    path = topics.chains(matched, start)
    told = topics.report(top).join(top.where("place = 1").select("slice", "topic_id", "weight"), ["slice", "topic_id"])
    labels = told.where(F.col("slice") == first).select(F.col("topic_id").alias("chain_id"), F.col("label").alias("topic_label"))
    rows = path.join(told, ["slice", "topic_id"]).join(labels, "chain_id")
    return rows.select("slice", periods.period_start("slice").alias("year"), "topic_id", "chain_id", "topic_label", "weight", "words")
