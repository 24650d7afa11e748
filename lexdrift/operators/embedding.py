"""Word embeddings of each slice: U * sqrt(S) of the truncated SVD of its PPMI matrix.

A slice's entries go to one Arrow group as numbers, 16 bytes each. Their number is bounded whatever the corpus: the vocabulary has under
1 / threshold words, and only entries over the minimum count are in it. Slices run in parallel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import linalg
from ..sources.staging import staged

COMPONENTS, ROUNDS = 300, 200


def common_components(vocab: DataFrame, components: int = COMPONENTS) -> int:
    """The number of dimensions that every slice of ``vocab`` can have, so that slices can be aligned."""
    least = vocab.groupBy("slice").count().agg(F.min("count")).first()[0] or 0
    return max(1, min(components, least - 1))


def factorise(entries: DataFrame, vocab: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(slice, word, rank, vector) for each word of ``vocab`` from ``entries`` (slice, i, j, ppmi).

    A slice gets min(components, words - 1) dimensions, at least one; a slice without entries gets zeros.
    Signs are fixed: the largest entry of each dimension is positive. A slice that doesn't settle ends the job; see :func:`attempted`.
    """
    return _with_words(vocab, _embedded(entries, vocab, components, strict=True))


def attempted(entries: DataFrame, vocab: DataFrame, components: int = COMPONENTS, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """What :func:`factorise` gives, without slices that fail, and (slice, stage, reason) of those."""
    rows = staged(_embedded(entries, vocab, components, strict=False, rounds=rounds))
    failed = rows.where("reason is not null").select("slice", F.lit("embedding").alias("stage"), "reason")
    return _with_words(vocab, rows.where("reason is null")), failed


def _with_words(vocab: DataFrame, rows: DataFrame) -> DataFrame:
    return vocab.select("slice", "word", F.col("rank").cast("int").alias("rank")).join(rows, ["slice", "rank"]).select("slice", "word", "rank", "vector")


def _embedded(entries: DataFrame, vocab: DataFrame, components: int, strict: bool, rounds: int = ROUNDS) -> DataFrame:
    """(slice, rank, vector, reason): a slice's rows, or one row with the reason why it has none."""
    if components < 1:
        raise ValueError(f"at least one dimension is needed, not {components}")
    cells = entries.select("slice", F.col("i").cast("int"), F.col("j").cast("int"), F.col("ppmi").cast("double").alias("value"))
    sizes = vocab.groupBy("slice").agg(F.count("*").cast("int").alias("i")).select("slice", "i", F.lit(-1).alias("j"), F.lit(0.0).alias("value"))

    def embed(rows: pa.Table) -> pa.Table:
        i, j, value = (rows.column(c).to_numpy() for c in ("i", "j", "value"))
        n, held = int(i[j < 0][0]), j >= 0
        k = max(1, min(components, n - 1))
        vectors = np.zeros((n, k))
        if held.any():
            try:
                u, s, _ = linalg.truncated_svd(linalg.Sparse(i[held], j[held], value[held], (n, n)), k, rounds=rounds)
            except np.linalg.LinAlgError as e:
                if strict:
                    raise
                return pa.table({"slice": rows.column("slice")[:1], "rank": pa.array([None], pa.int32()), "vector": pa.array([None], pa.list_(pa.float64())), "reason": [str(e)]})
            vectors = u * np.sqrt(s)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(vectors.ravel()))
        return pa.table({"slice": pa.array([rows.column("slice")[0].as_py()] * n, pa.string()), "rank": pa.array(np.arange(n, dtype=np.int32)), "vector": flat, "reason": pa.array([None] * n, pa.string())})

    return sizes.unionByName(cells).groupBy("slice").applyInArrow(embed, "slice string, rank int, vector array<double>, reason string")


def missed(entries: DataFrame, embeddings: DataFrame, rounds: int = 60) -> DataFrame:
    """(slice, missed): the largest singular value of what a slice's dimensions leave of its matrix, by power iteration; 0 where they leave nothing.

    It isn't over the smallest value of the dimensions if these are the largest there are. For checks: a slice is one group, as in :func:`factorise`.
    """

    def power(key: tuple, cells: pa.Table, rows: pa.Table) -> pa.Table:
        n = rows.num_rows
        e = rows.sort_by("rank").column("vector").combine_chunks().flatten().to_numpy().reshape(n, -1) if n else np.zeros((0, 1))
        norms = np.sqrt((e * e).sum(0))
        u = e[:, norms > 0] / norms[norms > 0]
        m = linalg.Sparse(*(cells.column(c).to_numpy() for c in ("i", "j", "ppmi")), (n, n)) if cells.num_rows else None
        value = 0.0
        if m is not None:
            x = np.random.default_rng(5).standard_normal((n, 4))
            for _ in range(rounds):
                y = m.dot(x)
                y -= u @ (u.T @ y)
                value = float(np.linalg.norm(y, axis=0).max())
                x, r = np.linalg.qr(m.transposed_dot(y - u @ (u.T @ y)))
                if np.abs(r).max(initial=0) < 1e-18:
                    break
        return pa.table({"slice": pa.array([key[0].as_py()], pa.string()), "missed": pa.array([value])})

    left = entries.select("slice", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("ppmi").cast("double").alias("ppmi"))
    return left.groupBy("slice").cogroup(embeddings.select("slice", "rank", "vector").groupBy("slice")).applyInArrow(power, "slice string, missed double")


def diagnostics(embeddings: DataFrame) -> DataFrame:
    """Words, values other than zero, and the smallest norm of each slice."""
    from ..functions.vectors import norm

    nonzero = F.size(F.filter("vector", lambda x: x != 0))
    return embeddings.groupBy("slice").agg(
        F.count("*").alias("words"), F.max(F.size("vector")).cast("long").alias("dims"), F.sum(nonzero).alias("nonzero"), F.min(norm(F.col("vector"))).alias("min_norm")
    )


def dense(entries: DataFrame, slice_name: str, words: int) -> np.ndarray:
    """One slice's matrix on the driver, for inspection; refused beyond 2,000 words."""
    if words > 2000:
        raise ValueError("too large for a dense matrix")
    rows = entries.where(F.col("slice") == slice_name).select("i", "j", "ppmi").collect()
    out = np.zeros((words, words))
    for r in rows:
        out[r.i, r.j] = r.ppmi
    return out
