"""Questions to embeddings (slice, word, rank, vector): vectors, neighbours, distances, analogies.

Words asked for come from the caller. Their vectors are looked up first and meet the embeddings by an equi-join
on the slice; Spark broadcasts that side by its size and shuffles it otherwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.staging import staged

#: Words of a block of :func:`nearest`, and digits to which similarities are told apart there.
BLOCK, DIGITS = 1024, 12


def _asked(spark: SparkSession, words: list[str]) -> DataFrame:
    return spark.createDataFrame([(w,) for w in dict.fromkeys(words)], "word string")


def lookup(embeddings: DataFrame, words: list[str]) -> DataFrame:
    """(slice, word, vector) of each word asked for in each slice; vector is null where the slice hasn't the word."""
    slices = embeddings.select("slice").distinct()
    asked = slices.withColumn("word", F.explode(F.array(*[F.lit(w) for w in dict.fromkeys(words)])))
    return asked.join(embeddings.select("slice", "word", "vector"), ["slice", "word"], "left")


def top(scored: DataFrame, by: list[str], n: int) -> DataFrame:
    """The ``n`` rows of most similarity for each ``by`` with their place; all of them where n is not positive."""
    order = Window.partitionBy(*by).orderBy(F.col("similarity").desc(), F.col("rank").asc())
    placed = scored.withColumn("place", F.row_number().over(order))
    return placed.where(F.col("place") <= n) if n > 0 else placed


def most_similar(embeddings: DataFrame, words: list[str], n: int = 10) -> DataFrame:
    """(slice, query, word, similarity, place): nearest words by cosine, without the query itself.

    Unknown queries and those of zero norm have no rows, nor has a similarity of exactly -1.
    """
    query = embeddings.where(F.col("word").isin(words)).select("slice", F.col("word").alias("query"), F.col("vector").alias("q"))
    query = query.where(V.norm(F.col("q")) >= V.TINY)
    scored = embeddings.join(query, "slice").where("word != query").withColumn("similarity", V.cosine(F.col("q"), F.col("vector")))
    return top(scored.where("similarity > -1"), ["slice", "query"], n).select("slice", "query", "word", "similarity", "place")


def nearest(embeddings: DataFrame, n: int = 10) -> DataFrame:
    """(slice, query, word, similarity, place): what :func:`most_similar` gives, of every word at once. ``n`` is positive.

    Unit vectors are packed into blocks of words, which are written once. A task reads its part of the blocks and all others, a part at a time, multiplies each two and keeps the
    ``n`` best of its words; the best are merged by word. No vector is shuffled: the time is quadratic, what is on disk is the blocks and the best. A task holds
    the best of its words, a part of the blocks and the products of two. Similarities that are equal to 12 digits are ties, settled by rank, which must be different for each word of a slice.
    """
    if n < 1:
        raise ValueError(f"at least one neighbour is needed, not {n}")

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        vectors = rows.column("vector").combine_chunks()
        x = vectors.flatten().to_numpy().reshape(rows.num_rows, -1) if rows.num_rows else np.zeros((0, 1))
        norm = np.sqrt((x * x).sum(1))
        raw = lambda a: pa.array([a.tobytes()], pa.binary())
        return pa.table(
            {
                "slice": pa.array([key[0].as_py()], pa.string()), "block": pa.array([key[1].as_py()], pa.int32()), "ranks": raw(rows.column("rank").to_numpy().astype("<i4")),
                "units": raw((x / np.maximum(norm, V.TINY)[:, None]).astype("<f8")), "known": raw(norm >= V.TINY),
            }
        )

    def best(batches):
        held: dict[tuple, Best] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                array = lambda c, kind: np.frombuffer(batch.column(c)[i].as_buffer(), kind)  # noqa: B023, E731
                key = (batch.column("slice")[i].as_py(), batch.column("block")[i].as_py())
                known, theirs = array("known", bool), array("their_ranks", "<i4")
                if key not in held:
                    held[key] = Best(key[0], array("ranks", "<i4")[known], n)
                held[key].meet(array("units", "<f8").reshape(len(known), -1)[known], theirs, array("their_units", "<f8").reshape(len(theirs), -1))
        for one in held.values():
            yield from one.rows()

    rows = embeddings.where("slice is not null").select("slice", F.floor(F.col("rank") / BLOCK).cast("int").alias("block"), F.col("rank").cast("int").alias("rank"), "vector")
    packs = staged(rows.groupBy("slice", "block").applyInArrow(pack, "slice string, block int, ranks binary, units binary, known binary"))
    theirs = packs.select(F.col("slice").alias("of"), F.col("ranks").alias("their_ranks"), F.col("units").alias("their_units"))
    # Not an equality, which would send every block to every other by shuffle.
    met = packs.join(theirs.hint("shuffle_replicate_nl"), ~((F.col("slice") < F.col("of")) | (F.col("slice") > F.col("of")))).drop("of")
    # One part of the blocks after another meets all parts: a task takes all that meet its part, and so gives each of its words once.
    met = met.coalesce(max(packs.rdd.getNumPartitions(), packs.sparkSession.sparkContext.defaultParallelism)).mapInArrow(best, "slice string, rank int, near array<struct<away:double,other:int>>")
    merged = met.groupBy("slice", "rank").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, n).alias("near"))
    out = merged.select("slice", "rank", F.posexplode("near").alias("at", "one")).select("slice", "rank", (F.col("at") + 1).alias("place"), F.col("one.other").alias("other"), (-F.col("one.away")).alias("similarity"))
    names = embeddings.select("slice", F.col("rank").cast("int").alias("rank"), F.col("word").alias("query"))
    others = embeddings.select("slice", F.col("rank").cast("int").alias("other"), "word")
    return out.join(names, ["slice", "rank"]).join(others, ["slice", "other"]).select("slice", "query", "word", "similarity", "place")


class Best:
    """The ``n`` nearest so far of a block's words, by similarity to 12 digits, then rank; the word itself and similarities of -1 aren't any."""

    def __init__(self, name: str, ranks: np.ndarray, n: int):
        self.name, self.ranks, self.n = name, ranks, n
        self.away, self.other = np.full((len(ranks), n), 1.0), np.zeros((len(ranks), n), np.int32)

    def meet(self, mine: np.ndarray, ranks: np.ndarray, units: np.ndarray) -> None:
        if not len(self.ranks) or not len(ranks):
            return
        away = -np.round(np.clip(np.nan_to_num(mine @ units.T, nan=-1.0), -1, 1), DIGITS) + 0.0
        away[self.ranks[:, None] == ranks] = 1
        k = min(self.n, len(ranks))
        # Up to the n-th least of a row all that are as near as that, for ties; and none that is farther than the n-th so far.
        most = np.minimum(np.partition(away, k - 1, axis=1)[:, k - 1], self.away[:, -1])
        row, column = np.nonzero((away <= most[:, None]) & (away < 1))
        if not len(row):
            return
        every_row = np.concatenate([np.repeat(np.arange(len(self.ranks)), self.n), row])
        every_away, every_other = np.concatenate([self.away.ravel(), away[row, column]]), np.concatenate([self.other.ravel(), ranks[column]])
        order = np.lexsort((every_other, every_away, every_row))
        begin = np.searchsorted(every_row[order], np.arange(len(self.ranks)))
        took = order[begin[:, None] + np.arange(self.n)]
        self.away, self.other = every_away[took], every_other[took]

    def rows(self):
        took = self.away < 1
        found = pa.StructArray.from_arrays([pa.array(self.away[took]), pa.array(self.other[took])], ["away", "other"])
        near = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(took.sum(1))), pa.int32()), found)
        if len(self.ranks):
            yield pa.RecordBatch.from_arrays([pa.array([self.name] * len(self.ranks), pa.string()), pa.array(self.ranks), near], ["slice", "rank", "near"])


def distance(embeddings: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(slice, w1, w2, distance): 1 - cosine, at most 1; null where a word is unknown or has no norm."""
    asked = embeddings.select("slice").distinct().withColumn("p", F.explode(F.array(*[F.struct(F.lit(a).alias("w1"), F.lit(b).alias("w2")) for a, b in pairs])))
    side = lambda k: embeddings.select("slice", F.col("word").alias(f"w{k}"), F.col("vector").alias(f"v{k}"))
    both = asked.select("slice", "p.*").join(side(1), ["slice", "w1"], "left").join(side(2), ["slice", "w2"], "left")
    a, b = F.col("v1"), F.col("v2")
    ok = (V.norm(a) >= V.TINY) & (V.norm(b) >= V.TINY)
    return both.select("slice", "w1", "w2", F.when(ok, F.least(1 - V.dot(a, b) / (V.norm(a) * V.norm(b)), F.lit(1.0))).alias("distance"))


def analogy(embeddings: DataFrame, positive: list[str], negative: str, n: int = 3, min_length: int = 3) -> DataFrame | None:
    """(slice, word, similarity, place): words near ``negative - positive[0] + positive[1]``, not the three themselves.

    None without exactly two positive words; a slice without one of the words, or with a target of no norm, has no rows.
    """
    if len(positive) != 2:
        return None
    first, second = positive

    def one(word: str, name: str) -> DataFrame:
        return embeddings.where(F.col("word") == word).select("slice", F.col("vector").alias(name))

    target = one(negative, "n").join(one(first, "p0"), "slice").join(one(second, "p1"), "slice")
    aim: Column = V.plus(V.plus(F.col("n"), F.col("p0"), -1), F.col("p1"))
    target = target.select("slice", aim.alias("q")).where(V.norm(F.col("q")) >= V.TINY)
    others = embeddings.where(~F.col("word").isin(first, second, negative) & (F.length("word") >= min_length))
    scored = others.join(target, "slice").withColumn("similarity", V.cosine(F.col("q"), F.col("vector"))).where("similarity > -1")
    return top(scored, ["slice"], n).select("slice", "word", "similarity", "place")


def neighbour_overlap(embeddings: DataFrame, word: str, first: str, second: str, n: int = 10) -> DataFrame:
    """Neighbours of a word in two slices: those of both, of one only, and their Jaccard similarity."""
    near = most_similar(embeddings.where(F.col("slice").isin(first, second)), [word], n)
    sets = near.groupBy("query").agg(*[F.sort_array(F.collect_set(F.when(F.col("slice") == s, F.col("word")))).alias(c) for s, c in ((first, "a"), (second, "b"))])
    return sets.select(
        F.col("query").alias("word"),
        F.array_intersect("a", "b").alias("shared"),
        F.array_except("a", "b").alias("lost"),
        F.array_except("b", "a").alias("gained"),
        (F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))).alias("jaccard"),
    )
