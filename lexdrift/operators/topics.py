"""Topics of each slice by non-negative factorisation of its PPMI matrix, and their matching across slices.

Topics are rows (slice, topic_id, word, weight). A slice's matrix is one Arrow group of bounded size (see
:mod:`.embedding`); everything after the factors is joins and windows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import linalg
from ..sources.staging import staged

TOPICS, MAX_ITER, MIN_SIMILARITY = 10, 500, 0.1


def factors(entries: DataFrame, vocab: DataFrame, topics: int = TOPICS, max_iter: int = MAX_ITER) -> DataFrame:
    """(slice, topic_id, word, rank, focus, weight): the word's loading as a row of W, and as a column of H.

    Negative entries are an error, and so are more topics than words; a slice without entries has no rows. See :func:`attempted`.
    """
    return _with_words(vocab, _split(entries, vocab, topics, max_iter, strict=True))


def attempted(entries: DataFrame, vocab: DataFrame, topics: int = TOPICS, max_iter: int = MAX_ITER) -> tuple[DataFrame, DataFrame]:
    """What :func:`factors` gives, without slices that fail, and (slice, stage, reason) of those."""
    rows = staged(_split(entries, vocab, topics, max_iter, strict=False))
    failed = rows.where("reason is not null").select("slice", F.lit("topics").alias("stage"), "reason")
    return _with_words(vocab, rows.where("reason is null")), failed


def _with_words(vocab: DataFrame, rows: DataFrame) -> DataFrame:
    words = vocab.select("slice", "word", F.col("rank").cast("int").alias("rank"))
    return rows.join(words, ["slice", "rank"]).select("slice", "topic_id", "word", "rank", "focus", "weight")


def _split(entries: DataFrame, vocab: DataFrame, topics: int, max_iter: int, strict: bool) -> DataFrame:
    """(slice, topic_id, rank, focus, weight, reason): a slice's rows, or one row with the reason why it has none."""
    if topics < 1:
        raise ValueError(f"at least one topic is needed, not {topics}")
    cells = entries.select("slice", F.col("i").cast("int"), F.col("j").cast("int"), F.col("ppmi").cast("double").alias("value"))
    sizes = vocab.groupBy("slice").agg(F.count("*").cast("int").alias("i")).select("slice", "i", F.lit(-1).alias("j"), F.lit(0.0).alias("value"))

    def split(rows: pa.Table) -> pa.Table:
        try:
            return solved(rows)
        except (ValueError, np.linalg.LinAlgError) as e:
            if strict:
                raise
            none = {c: pa.array([None], kind) for c, kind in (("topic_id", pa.int32()), ("rank", pa.int32()), ("focus", pa.float64()), ("weight", pa.float64()))}
            return pa.table({"slice": rows.column("slice")[:1], **none, "reason": [str(e)]})

    def solved(rows: pa.Table) -> pa.Table:
        i, j, value = (rows.column(c).to_numpy() for c in ("i", "j", "value"))
        n, held, name = int(i[j < 0][0]), j >= 0, rows.column("slice")[0].as_py()
        if (value < 0).any():
            raise ValueError("negative values in the matrix")
        if held.any() and topics > n:
            raise ValueError(f"{topics} topics need as many words; {name} has {n}")
        k = topics if held.any() else 0
        w, h = linalg.factorise(linalg.Sparse(i[held], j[held], value[held], (n, n)), k, max_iter) if k else (np.zeros((n, 0)), np.zeros((0, n)))
        return pa.table(
            {
                "slice": pa.array([name] * (k * n), pa.string()), "topic_id": pa.array(np.repeat(np.arange(k, dtype=np.int32), n)), "rank": pa.array(np.tile(np.arange(n, dtype=np.int32), k)),
                "focus": pa.array(w.T.ravel()), "weight": pa.array(h.ravel()), "reason": pa.array([None] * (k * n), pa.string()),
            }
        )

    return sizes.unionByName(cells).groupBy("slice").applyInArrow(split, "slice string, topic_id int, rank int, focus double, weight double, reason string")


def distributions(weights: DataFrame) -> DataFrame:
    """Weights of each topic divided by their sum, where that is over zero."""
    total = F.sum("weight").over(Window.partitionBy("slice", "topic_id"))
    return weights.withColumn("weight", F.when(total > 0, F.col("weight") / total).otherwise(F.col("weight")))


def top_words(weights: DataFrame, n: int = 10) -> DataFrame:
    """(slice, topic_id, place, word, weight) of the heaviest words; ties by word."""
    order = Window.partitionBy("slice", "topic_id").orderBy(F.col("weight").desc(), "word")
    placed = weights.select("slice", "topic_id", F.row_number().over(order).alias("place"), "word", "weight")
    return placed.where(F.col("place") <= n)


def report(top: DataFrame, n: int = 10) -> DataFrame:
    """(slice, topic_id, label, words): the first three words, and ``word: weight`` of the first n."""
    entry = F.struct("place", "word", F.format_string("%s: %.4f", "word", "weight").alias("shown"))
    rows = top.where(F.col("place") <= n).groupBy("slice", "topic_id").agg(F.sort_array(F.collect_list(entry)).alias("t"))
    return rows.select("slice", "topic_id", F.array_join(F.slice(F.col("t.word"), 1, 3), ", ").alias("label"), F.array_join("t.shown", ", ").alias("words"))


#: Documents of a slice that are mixed in one group.
DOCS = 8192


def document_topics(documents: DataFrame, weights: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(slice, doc_id, topic_id, share): documents (slice, doc_id, word, weight) as non-negative mixes of the slice's topics, shares over ``threshold``.

    With the topics fixed only their products with each other and with the document count: both are sums by join. Documents of a slice are
    dealt to groups of about ``DOCS``, each of which gets the slice's products of topics. doc_id is a long. Documents of a slice without topics, and those that share no
    word with them, have no rows.
    """
    t = weights.select("slice", "topic_id", "word", F.col("weight").alias("h"))
    gram = t.join(t.select("slice", F.col("topic_id").alias("other"), "word", F.col("h").alias("g")), ["slice", "word"])
    gram = gram.groupBy("slice", "topic_id", "other").agg(F.sum(F.col("h") * F.col("g")).alias("v"))
    gram = gram.groupBy("slice").agg(F.collect_list(F.struct("topic_id", "other", "v")).alias("gram"))  # as many as topics squared
    target = documents.join(t, ["slice", "word"]).groupBy("slice", "doc_id", "topic_id").agg(F.sum(F.col("weight") * F.col("h")).alias("v"))
    docs = staged(target.groupBy("slice", "doc_id").agg(F.collect_list(F.struct("topic_id", "v")).alias("target")))
    sizes = staged(docs.groupBy("slice").agg(F.ceil(F.count("*") / DOCS).cast("int").alias("groups")))
    dealt = docs.join(sizes, "slice").select("slice", F.pmod(F.xxhash64("doc_id"), F.col("groups")).cast("int").alias("group"), "doc_id", "target")
    sent = gram.join(sizes.withColumnRenamed("slice", "s"), F.col("slice") == F.col("s")).select("s", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), "gram")

    def solve(key: tuple, rows: pa.Table, held: pa.Table) -> pa.Table:
        empty = pa.table({"slice": pa.array([], pa.string()), "doc_id": pa.array([], pa.int64()), "topic_id": pa.array([], pa.int32()), "share": pa.array([], pa.float64())})
        if not rows.num_rows or not held.num_rows:
            return empty
        cells = held.column("gram").combine_chunks().flatten()
        first, other, v = (cells.field(c).to_numpy() for c in ("topic_id", "other", "v"))
        ids = np.unique(first)
        gram = np.zeros((len(ids), len(ids)))
        gram[np.searchsorted(ids, first), np.searchsorted(ids, other)] = v
        found = rows.column("target").combine_chunks()
        parent, each = pc.list_parent_indices(found).to_numpy(), found.flatten()
        b = np.zeros((rows.num_rows, len(ids)))
        b[parent, np.searchsorted(ids, each.field("topic_id").to_numpy())] = each.field("v").to_numpy()
        w = linalg.non_negative_weights(gram, b)
        total = w.sum(1, keepdims=True)
        w = np.where(total > 0, w / np.where(total > 0, total, 1), w)
        x, c = np.nonzero(w > threshold)
        return pa.table({"slice": pa.array([key[0].as_py()] * len(x), pa.string()), "doc_id": rows.column("doc_id").take(pa.array(x)), "topic_id": pa.array(ids[c].astype(np.int32)), "share": pa.array(w[x, c])})

    return dealt.groupBy("slice", "group").cogroup(sent.groupBy("s", "g")).applyInArrow(solve, "slice string, doc_id long, topic_id int, share double")


def union_projection(weights: DataFrame, first: tuple[str, int], second: tuple[str, int]) -> DataFrame:
    """(word, w1, w2): two topics over the union of their words, absent ones 0, each normalised again."""

    def one(topic: tuple[str, int], name: str) -> DataFrame:
        return weights.where((F.col("slice") == topic[0]) & (F.col("topic_id") == topic[1])).select("word", F.col("weight").alias(name))

    every = Window.partitionBy()
    both = one(first, "w1").join(one(second, "w2"), "word", "full").na.fill(0.0, ["w1", "w2"])
    scaled = lambda c: F.when(F.sum(c).over(every) > 0, F.col(c) / F.sum(c).over(every)).otherwise(F.col(c)).alias(c)
    return both.select("word", scaled("w1"), scaled("w2"))


def similarities(weights: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source, target, source_topic, target_topic, similarity) of all topics of each pair of slices: cosine over all words, 0 without a norm."""
    norms = weights.groupBy("slice", "topic_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    p = pairs.select("source", "target")
    a = weights.select(F.col("slice").alias("source"), F.col("topic_id").alias("source_topic"), "word", F.col("weight").alias("w1")).join(p, "source")
    b = weights.select(F.col("slice").alias("target"), F.col("topic_id").alias("target_topic"), "word", F.col("weight").alias("w2"))
    dots = a.join(b, ["target", "word"]).groupBy("source", "target", "source_topic", "target_topic").agg(F.sum(F.col("w1") * F.col("w2")).alias("dot"))
    na = norms.select(F.col("slice").alias("source"), F.col("topic_id").alias("source_topic"), F.col("norm").alias("n1"))
    nb = norms.select(F.col("slice").alias("target"), F.col("topic_id").alias("target_topic"), F.col("norm").alias("n2"))
    every = p.join(na, "source").join(nb, "target").join(dots, ["source", "target", "source_topic", "target_topic"], "left")
    value = F.coalesce(F.col("dot") / F.nullif(F.col("n1") * F.col("n2"), F.lit(0.0)), F.lit(0.0))
    return every.select("source", "target", "source_topic", "target_topic", F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)).alias("similarity"))


def match(similarity: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """The one-to-one matching of each pair's topics of most total similarity, without matches under ``min_similarity``."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, columns = sorted(pdf.source_topic.unique()), sorted(pdf.target_topic.unique())
        table = pdf.pivot(index="source_topic", columns="target_topic", values="similarity").loc[rows, columns].to_numpy()
        out = [(pdf.source.iloc[0], pdf.target.iloc[0], rows[i], columns[j], table[i, j]) for i, j in linalg.assignment(1 - table)]
        return pd.DataFrame(out, columns=["source", "target", "source_topic", "target_topic", "similarity"])

    kind = "source string, target string, source_topic int, target_topic int, similarity double"
    found = similarity.groupBy("source", "target").applyInPandas(solve, kind)
    return found.where(F.col("similarity") >= min_similarity)


def chains(matches: DataFrame, first: DataFrame) -> DataFrame:
    """(slice, topic_id, chain_id): topics of the ``first`` slice (slice, topic_id) followed through ``matches`` as far as they go.

    A chain is a path of matches; a topic that isn't reached begins no chain. Matches of slices in a row are one to one. Each
    step doubles the paths (a topic, and the one so many slices on), so many slices need few steps. Matches that go round are
    an error.
    """
    m = matches.select("source", "source_topic", "target", "target_topic")
    slices, steps = m.select("source").distinct().count(), 1
    reached = staged(first.select("slice", "topic_id", F.col("topic_id").alias("chain_id")))
    jump = staged(m)
    while True:
        ahead = jump.withColumnsRenamed({"source": "slice", "source_topic": "topic_id"})
        further = staged(reached.join(ahead, ["slice", "topic_id"]).select(F.col("target").alias("slice"), F.col("target_topic").alias("topic_id"), "chain_id"))
        if further.isEmpty():
            return reached
        if steps > slices:
            raise ValueError("matches go round: a path is longer than there are slices")
        steps *= 2
        reached = staged(reached.unionByName(further))
        middle = jump.select(F.col("source").alias("target"), F.col("source_topic").alias("target_topic"), F.col("target").alias("to"), F.col("target_topic").alias("to_topic"))
        jump = staged(jump.join(middle, ["target", "target_topic"]).select("source", "source_topic", F.col("to").alias("target"), F.col("to_topic").alias("target_topic")))
