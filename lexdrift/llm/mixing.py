"""Mixing sources to target weights: capped water-filling, then seeded repetitions.

Targets share a budget of words in proportion to the sources' weights. A source whose share is over
``most`` times its own words is clamped there, and the rest of the budget is shared by the others,
until no share is over its clamp. Sorted by clamp / weight, the clamped sources are a prefix, so one
running sum finds them.

A source then repeats each document ``floor(target / words)`` times, and once more the documents that
come first in a seeded random order until their words reach what is left. That is a key for each source, its cutoff. It is
found digit by digit: words are summed by the key's next ``DIGITS`` digits, which leaves one bucket of a
source, and so on until that has few rows. So no task orders more than a bucket, however large a source is, and taking the
mix is a lookup of each document's source: documents aren't shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, staged

#: Characters that don't belong to a word: ``[\x20\x09-\x0D]``.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Sources up to which their table is broadcast (under 100 bytes each); beyond, Spark joins by shuffle.
BROADCAST_SOURCES = 10_000
#: Rows of a source in a bucket that is put in order, and digits of the key that are looked at in a step.
BUCKET_ROWS, DIGITS = 4_096, 3
#: Digits of a key: of the document's random number, its size and a hash of its text.
KEY = 32 + 16 + 16


def water_fill(sources: DataFrame, weights: tuple[float, ...], share: float, most: int) -> DataFrame:
    """``sources`` (source, words: a row each) with target; weights go round in the sources' order, null last.

    Sources are few against documents; their table is put in order in one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn(
        "weight", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    )
    by_clamp = Window.orderBy(F.col("words") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_clamp.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranked = (
        ranked.withColumn("budget", share * F.sum("words").over(every))
        .withColumn("spent", most * F.coalesce(F.sum("words").over(before), F.lit(0)))
        .withColumn("left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        # the level, were all sources before this one clamped and the others not
        .withColumn("level", (F.col("budget") - F.col("spent")) / F.col("left"))
        .withColumn("free", F.col("level") * F.col("weight") <= most * F.col("words"))
        .withColumn("at", F.row_number().over(by_clamp))
        .withColumn("level", F.min(F.when(F.col("free"), F.struct("at", "level"))).over(every)["level"])
    )
    clamp = (most * F.col("words")).cast("double")
    return ranked.select("source", "words", F.coalesce(F.least(clamp, F.col("level") * F.col("weight")), clamp).alias("target"))


def size_of(text: str | Column = "text") -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def key_of(seed: int, doc_id: Column, size: Column, text: Column) -> Column:
    """A document's place in the seeded order, as hexadecimal digits."""
    wide = lambda c: F.lpad(F.hex(c), 16, "0")
    return F.concat(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary")), wide(size), wide(F.xxhash64(F.coalesce(text, F.lit("")))))


def cutoffs(rows: DataFrame, rest: DataFrame, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(source, cutoff): the last key of each source to take ``rest`` words of, from ``rows`` (source, size, key) and ``rest`` (source, rest)."""
    cut = rest.select(F.col("source").alias("s"), "rest", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("before"))
    order = Window.partitionBy("s").orderBy("part")
    for length in range(0, KEY, DIGITS):
        inside = rows.join(small(cut), rows["source"].eqNullSafe(cut["s"]) & F.col("key").startswith(F.col("prefix")))
        part = F.substring("key", length + 1, DIGITS).alias("part")
        sums = inside.groupBy("s", part).agg(F.sum("size").alias("words"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("rest", "prefix", "before")))
        through = sums.withColumn("through", F.col("before") + F.sum("words").over(order)).where("through > rest")
        first = F.min(F.struct("part", (F.col("through") - F.col("words")).alias("before"), "rest", "prefix", "n")).alias("first")
        cut = staged(through.groupBy("s").agg(first).select("s", "first.rest", F.concat("first.prefix", "first.part").alias("prefix"), "first.before", "first.n"))
        if (cut.agg(F.max("n")).first()[0] or 0) <= BUCKET_ROWS:
            break
    inside = rows.join(small(cut), rows["source"].eqNullSafe(cut["s"]) & F.col("key").startswith(F.col("prefix")))
    # Equal keys are rows of one id and text, which are taken alike.
    keys = inside.groupBy("s", "rest", "prefix", "before", "key").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("s").orderBy("key")
    middle = F.col("before") + F.sum("words").over(order) - F.col("words") / 2
    taken = keys.withColumn("take", middle <= F.col("rest"))
    # Without any, all keys of the bucket are behind its prefix.
    return taken.groupBy(F.col("s").alias("source")).agg(F.coalesce(F.max(F.when(F.col("take"), F.col("key"))), F.first("prefix")).alias("cutoff"))


def plan(
    docs: DataFrame, weights: tuple[float, ...], share: float, most: int, seed: int
) -> tuple[DataFrame, DataFrame, Callable[[DataFrame], DataFrame]]:
    """(doc_id, source, size, key) of all documents, a row for each source (s, source_size, target, whole, cutoff), and how to join that."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size_of().alias("size"), "text")
    rows = staged(rows.withColumn("key", key_of(seed, F.col("doc_id"), F.col("size"), F.col("text"))).drop("text"))
    counts = rows.groupBy("source").agg(F.sum("size").alias("words"))
    targets = water_fill(counts, weights, share, most)
    targets = targets.withColumn("whole", F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0))
    targets = staged(targets.withColumn("rest", F.col("target") - F.col("whole") * F.col("words")))
    few = targets.count() <= BROADCAST_SOURCES
    # Many sources: the join's side with a hot source is split by Spark's skew join.
    small = F.broadcast if few else lambda df: df
    cut = cutoffs(rows, targets.where("rest > 0").select("source", "rest"), small).withColumnRenamed("source", "c")
    sources = targets.join(cut, targets["source"].eqNullSafe(cut["c"]), "left")
    return rows, staged(sources.select(F.col("source").alias("s"), F.col("words").alias("source_size"), "target", "whole", "cutoff")), small


def copies_of(key: str, whole: str, cutoff: str) -> Column:
    return F.col(whole) + F.coalesce(F.col(key) <= F.col(cutoff), F.lit(False)).cast("long")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    seed: int = 11,
) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, source, text): doc_id, source, size, source_size, target, copies, taken.

    size counts the text's words (null: 0). Targets add up to ``share`` of all words, at most ``most``
    times a source's own. copies is how often the mix takes the whole document; taken = copies * size.
    Sources are by code point, null a source of its own, last. Documents of one id are ordered by size, then by a hash of their text;
    rows of one id and text are taken alike. No documents give no rows; other columns are ignored.
    """
    rows, sources, small = plan(docs, weights, share, most, seed)
    joined = rows.join(small(sources), rows["source"].eqNullSafe(sources["s"]))
    return joined.withColumn("copies", copies_of("key", "whole", "cutoff")).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeat(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    seed: int = 11,
) -> DataFrame:
    """``docs`` (doc_id, source, text and any other columns) as :func:`mix` takes them: a row for each time, all columns.

    Documents without words (or null) aren't counted in a size; they are taken as often as their key says. A null source is a source of its own.
    Columns may be called anything; no documents give no rows.
    """
    _, sources, small = plan(docs, weights, share, most, seed)
    key, time, s, whole, cutoff = free_names(docs, "key", "time", "s", "whole", "cutoff")
    sources = sources.select(F.col("s").alias(s), F.col("whole").alias(whole), F.col("cutoff").alias(cutoff))
    keyed = docs.withColumn(key, key_of(seed, docs["doc_id"].cast("long"), size_of(docs["text"]), docs["text"]))
    joined = keyed.join(small(sources), keyed["source"].eqNullSafe(F.col(s)))
    times = copies_of(key, whole, cutoff)
    return joined.withColumn(time, F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(*docs.columns)
