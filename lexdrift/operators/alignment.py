"""Orthogonal Procrustes between pairs of slices.

Anchors of all pairs are one join; A'B is summed where the rows are and only its d * d cells are shuffled.
The rotation of a pair is an array of its columns; the pair's vectors are turned by one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import linalg
from ..functions import vectors as V
from ..sources.staging import staged

MIN_RANK, MAX_RANK = None, 1000


def in_window(embeddings: DataFrame, low: int | None, high: int | None) -> DataFrame:
    """Rows whose rank is in ``[low:high]``; negative bounds count from the end of each slice."""

    def bound(x: int) -> Column:
        return F.lit(x) if x >= 0 else F.greatest(F.col("words") + x, F.lit(0))

    sized = embeddings
    if min(low or 0, high or 0) < 0:
        sized = embeddings.join(embeddings.groupBy("slice").agg(F.count("*").alias("words")), "slice")
    if low is not None:
        sized = sized.where(F.col("rank") >= bound(low))
    if high is not None:
        sized = sized.where(F.col("rank") < bound(high))
    return sized.select(*embeddings.columns)


def sides(embeddings: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of both slices of each pair (source, target)."""
    p = pairs.select("source", "target")
    a = embeddings.select(F.col("slice").alias("source"), "word", F.col("vector").alias("a")).join(p, "source")
    b = embeddings.select(F.col("slice").alias("target"), "word", F.col("vector").alias("b")).join(p, "target")
    return a, b


def common_words(embeddings: DataFrame, pairs: DataFrame, low: int | None = MIN_RANK, high: int | None = MAX_RANK) -> DataFrame:
    """(source, target, word) of words whose rank is in the window in both slices."""
    a, b = sides(in_window(embeddings, low, high), pairs)
    return a.join(b, ["source", "target", "word"]).select("source", "target", "word")


def anchors(embeddings: DataFrame, pairs: DataFrame, low: int | None = MIN_RANK, high: int | None = MAX_RANK, words: list[str] | None = None) -> DataFrame:
    """(source, target, word, a, b): unit vectors of the anchors, without words that are zero on a side.

    ``words`` takes the place of the rank window.
    """
    if words is not None:
        held = embeddings.where(F.col("word").isin(words))
    else:
        held = in_window(embeddings, low, high)
    a, b = sides(held, pairs)
    both = a.join(b, ["source", "target", "word"]).where(~V.is_zero(F.col("a")) & ~V.is_zero(F.col("b")))
    return both.select("source", "target", "word", V.unit(F.col("a")).alias("a"), V.unit(F.col("b")).alias("b"))


def cross_covariance(anchor_rows: DataFrame) -> DataFrame:
    """Cells (source, target, p, q, value) of A'B; a task sends its sum of each cell."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (source, target), rows in pdf.groupby(["source", "target"]):
                if rows.a.map(len).nunique() > 1 or not (rows.a.map(len) == rows.b.map(len)).all():
                    raise ValueError(f"{source} and {target} have different numbers of dimensions")
                m = np.stack(rows.a.to_numpy()).T @ np.stack(rows.b.to_numpy())
                p, q = np.indices(m.shape)
                yield pd.DataFrame({"source": source, "target": target, "p": p.ravel(), "q": q.ravel(), "value": m.ravel()})

    cells = anchor_rows.select("source", "target", "a", "b").mapInPandas(add, "source string, target string, p int, q int, value double")
    return cells.groupBy("source", "target", "p", "q").agg(F.sum("value").alias("value"))


def rotations(anchor_rows: DataFrame) -> DataFrame:
    """(source, target, columns, scale): the rotation of each pair by columns, and the sum of singular values."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((pdf.p.max() + 1, pdf.q.max() + 1))
        m[pdf.p, pdf.q] = pdf.value
        r, scale = linalg.rotation(m)
        return pd.DataFrame({"source": pdf.source[:1], "target": pdf.target[:1], "columns": [r.T.tolist()], "scale": scale})

    return cross_covariance(anchor_rows).groupBy("source", "target").applyInPandas(
        solve, "source string, target string, columns array<array<double>>, scale double"
    )


def turned(rows: DataFrame, fitted: DataFrame, column: str) -> DataFrame:
    """``rows`` (source, target, ..) with the vectors in ``column`` times their pair's rotation.

    A pair's rows are one matrix product: under 1 / threshold words, however large the corpus.
    """

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return left.slice(0, 0)
        r = np.array(right.column("columns")[0].as_py()).T
        vectors = left.column(column).combine_chunks()
        sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
        if (sizes != len(r)).any():
            raise ValueError(f"vectors of {sorted(set(sizes.tolist()))} dimensions, a rotation of {len(r)}")
        out = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(r)) @ r
        moved = pa.ListArray.from_arrays(pa.array(np.arange(left.num_rows + 1) * r.shape[1], pa.int32()), pa.array(out.ravel()))
        return left.set_column(left.schema.get_field_index(column), column, moved)

    by_pair = fitted.select(F.col("source").alias("s"), F.col("target").alias("t"), "columns").groupBy("s", "t")
    return rows.groupBy("source", "target").cogroup(by_pair).applyInArrow(work, rows.schema)


def metrics(anchor_rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """(source, target, average_cosine, num_anchors, alignment_error, residual_norm).

    alignment_error is the sum of singular values of A'B, residual_norm the Frobenius norm of AR - B.
    """
    rows = turned(anchor_rows.select("source", "target", F.col("a").alias("r"), "b"), fitted, "r")
    gap = V.plus(F.col("r"), F.col("b"), -1)
    sums = rows.groupBy("source", "target").agg(
        F.avg(V.dot(F.col("r"), F.col("b"))).alias("average_cosine"), F.count("*").alias("num_anchors"), F.sqrt(F.sum(V.dot(gap, gap))).alias("residual_norm")
    )
    scales = fitted.select("source", "target", F.col("scale").alias("alignment_error"))
    return sums.join(scales, ["source", "target"]).select("source", "target", "average_cosine", "num_anchors", "alignment_error", "residual_norm")


def transform(embeddings: DataFrame, fitted: DataFrame) -> DataFrame:
    """Vectors of each pair's source slice, turned towards its target: (source, target, word, rank, vector)."""
    pairs = fitted.select(F.col("source").alias("slice"), "target")
    rows = embeddings.join(pairs, "slice").withColumnRenamed("slice", "source")
    return turned(rows.select("source", "target", "word", "rank", "vector"), fitted, "vector")


def stability(embeddings: DataFrame, fitted: DataFrame) -> DataFrame:
    """(source, target, word, similarity) of all words of both slices: cosine of the turned source vector and the target's; NaN without a norm."""
    a = transform(embeddings, fitted).select("source", "target", "word", F.col("vector").alias("a"))
    b = embeddings.select(F.col("slice").alias("target"), "word", F.col("vector").alias("b"))
    n = V.norm(F.col("a")) * V.norm(F.col("b"))
    cosine = F.when(n == 0, F.lit(float("nan"))).otherwise(V.dot(F.col("a"), F.col("b")) / n)
    return a.join(b, ["target", "word"]).select("source", "target", "word", cosine.alias("similarity"))


def fit(embeddings: DataFrame, pairs: DataFrame, low: int | None = MIN_RANK, high: int | None = MAX_RANK, words: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rotations and metrics of all pairs; an error if no pair has words in common or none has anchors."""
    if words is None and common_words(embeddings, pairs, low, high).isEmpty():
        raise ValueError("No common words found for alignment")
    held = staged(anchors(embeddings, pairs, low, high, words))
    if held.isEmpty():
        raise ValueError("No valid anchor words found")
    fitted = staged(rotations(held))
    return fitted, metrics(held, fitted)
