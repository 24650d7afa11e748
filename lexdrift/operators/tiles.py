"""Decompositions of slices' matrices in tiles: no task holds a slice, whatever its vocabulary and the number of its entries.

A matrix is a table of tiles of ``BLOCK`` x ``BLOCK`` words, each at most that many entries; a dense matrix of few columns is a table of
blocks of ``BLOCK`` rows, in panels of ``PANEL`` columns. A product sends each block to the tiles that need it and sums what they give by
block. Orthonormal columns come from the sum of the blocks' Gram matrices, columns squared, one a slice. Everything else is done
block by block, and every table of a round is written, so that a lost executor costs tasks.

Slices go on until they have settled, each for itself: those that have leave the loop with their result, those that don't are named.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import linalg
from ..sources.staging import Stages, staged

BLOCK, PANEL = 1024, 64
#: Rounds of the subspace iteration, the movement of values (to the largest) at which it has settled, and at which it is still taken at the end.
ROUNDS, SETTLED, TAKEN = 200, 1e-10, 1e-6
#: Squares of singular values that are zero, to the largest; and a movement of factors that is none, to the matrix's norm.
ZERO, STILL = 1e-13, 1e-9
DENSE = "slice string, block int, panel int, width int, data binary"


def array(raw: pa.Scalar, kind: str = "<f8") -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), kind)


def tiles(entries: DataFrame, value: str = "ppmi") -> DataFrame:
    """(slice, rb, cb, i, j, v, rows, columns) of entries (slice, i, j, ``value``): a row for each tile with entries, places within it."""

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        rb, cb = key[1].as_py(), key[2].as_py()
        i, j = (rows.column(c).to_numpy() - BLOCK * b for c, b in (("i", rb), ("j", cb)))
        v = rows.column("value").to_numpy()
        raw = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
        whole = lambda x: pa.array([int(x)], pa.int32())
        return pa.table({"slice": pa.array([key[0].as_py()], pa.string()), "rb": whole(rb), "cb": whole(cb), "i": raw(i, "<i4"), "j": raw(j, "<i4"), "v": raw(v, "<f8"), "rows": whole(i.max() + 1), "columns": whole(j.max() + 1)})

    at = lambda c: F.floor(F.col(c) / BLOCK).cast("int")
    cells = entries.select("slice", at("i").alias("rb"), at("j").alias("cb"), F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col(value).cast("double").alias("value"))
    return cells.groupBy("slice", "rb", "cb").applyInArrow(pack, "slice string, rb int, cb int, i binary, j binary, v binary, rows int, columns int")


def panels(name: str | None, block: int, x: np.ndarray) -> pa.Table:
    cuts = list(range(0, x.shape[1], PANEL)) or [0]
    data = [np.ascontiguousarray(x[:, c : c + PANEL], dtype="<f8") for c in cuts]
    return pa.table(
        {
            "slice": pa.array([name] * len(cuts), pa.string()),
            "block": pa.array([block] * len(cuts), pa.int32()),
            "panel": pa.array(range(len(cuts)), pa.int32()),
            "width": pa.array([d.shape[1] for d in data], pa.int32()),
            "data": pa.array([d.tobytes() for d in data], pa.binary()),
        }
    )


def dense(rows: pa.Table) -> np.ndarray:
    """A block from its panels, in whatever order they come."""
    rows = rows.sort_by("panel")
    return np.hstack([array(d).reshape(-1, max(1, w)) for d, w in zip(rows.column("data"), rows.column("width").to_pylist(), strict=True)])


def called(df: DataFrame, *columns: str) -> DataFrame:
    """Columns with an underscore before their names: the other side of a join or cogroup with the table they are from."""
    return df.select(*(F.col(c).alias(f"_{c}") for c in columns))


def per_block(x: DataFrame, by: DataFrame) -> DataFrame:
    """``by`` (slice, ..) for each block of ``x``: _slice, _block, .."""
    return called(x.select("slice", "block").distinct(), "slice", "block").join(by, F.col("_slice") == F.col("slice")).drop("slice")


def partial_products(tiled: DataFrame, x: DataFrame, transposed: bool) -> DataFrame:
    """What each tile of M (or M') gives for the product with ``x``: rows of :data:`DENSE` that are still to be summed by block and panel."""
    at = "rb" if transposed else "cb"

    def multiply(key: tuple, tile: pa.Table, block: pa.Table) -> pa.Table:
        if not tile.num_rows or not block.num_rows:
            return panels(None, 0, np.zeros((0, 1))).slice(0, 0)
        i, j = (array(tile.column(c)[0], "<i4") for c in (("j", "i") if transposed else ("i", "j")))
        out = linalg.product(i, j, array(tile.column("v")[0]), dense(block), int(i.max()) + 1)
        return panels(key[0].as_py(), (key[2] if transposed else key[1]).as_py(), out)

    wanted = called(tiled, "slice", "rb", "cb")
    sent = x.join(wanted, (F.col("slice") == F.col("_slice")) & (F.col("block") == F.col(f"_{at}"))).select("_slice", "_rb", "_cb", "panel", "width", "data")
    return tiled.groupBy("slice", "rb", "cb").cogroup(sent.groupBy("_slice", "_rb", "_cb")).applyInArrow(multiply, DENSE)


def summed(parts: pa.Table, width: int) -> np.ndarray:
    blocks = [array(d).reshape(-1, width) for d in parts.column("data")]
    total = np.zeros((max(map(len, blocks)), width))
    for b in blocks:
        total[: len(b)] += b
    return total


def product(tiled: DataFrame, x: DataFrame, transposed: bool = False) -> DataFrame:
    """M x, or M' x, of every slice; rows after the last with entries in a block are left out: they are zero."""

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        width = rows.column("width")[0].as_py()
        return pa.table({"slice": pa.array([key[0].as_py()], pa.string()), "block": pa.array([key[1].as_py()], pa.int32()), "panel": pa.array([key[2].as_py()], pa.int32()), "width": pa.array([width], pa.int32()), "data": pa.array([summed(rows, width).tobytes()], pa.binary())})

    return partial_products(tiled, x, transposed).groupBy("slice", "block", "panel").applyInArrow(add, DENSE)


def grams(y: DataFrame) -> DataFrame:
    """(slice, gram): Y'Y of each block."""

    def one(key: tuple, rows: pa.Table) -> pa.Table:
        block = dense(rows)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.string()), "gram": pa.array([(block.T @ block).tobytes()], pa.binary())})

    return y.groupBy("slice", "block").applyInArrow(one, "slice string, gram binary")


def turned(x: DataFrame, by: DataFrame) -> DataFrame:
    """``x`` times the matrix of its slice in ``by`` (slice, t, size: the matrix's rows); slices without one are left out."""

    def turn(key: tuple, block: pa.Table, matrix: pa.Table) -> pa.Table:
        if not block.num_rows or not matrix.num_rows:
            return panels(None, 0, np.zeros((0, 1))).slice(0, 0)
        t = array(matrix.column("t")[0]).reshape(matrix.column("size")[0].as_py(), -1)
        return panels(key[0].as_py(), key[1].as_py(), dense(block) @ t)

    sent = per_block(x, by.select("slice", "t", "size"))
    return x.groupBy("slice", "block").cogroup(sent.groupBy("_slice", "_block")).applyInArrow(turn, DENSE)


def orthonormal(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The matrix T that makes of Y, whose Gram matrix is given, Ritz vectors Y T, and their values in descending order; zero beyond the rank."""
    square, v = np.linalg.eigh((gram + gram.T) / 2)
    square, v = square[::-1], v[:, ::-1]
    held = square > ZERO * max(square[0], 1e-300)
    t = np.zeros_like(v)
    if held.any():
        v = v[:, held] / np.sqrt(square[held])
        # What rounding has left of the columns' products is taken out as well.
        left, rest = np.linalg.eigh(v.T @ gram @ v)
        t[:, held] = v @ (rest / np.sqrt(left)) @ rest.T
    return t, np.sqrt(np.where(held, square, 0))


def ritz(y: DataFrame, before: DataFrame | None) -> DataFrame:
    """(slice, t, size, values, k, moved): how to make Ritz vectors of ``y``, and how far the first k values are from those of ``before`` (slice, k, values)."""

    def solve(key: tuple, parts: pa.Table, last: pa.Table) -> pa.Table:
        if not parts.num_rows:
            return pa.table({"slice": pa.array([], pa.string()), "t": pa.array([], pa.binary()), "size": pa.array([], pa.int32()), "values": pa.array([], pa.binary()), "k": pa.array([], pa.int32()), "moved": pa.array([], pa.float64())})
        gram = sum(array(g) for g in parts.column("gram"))
        size = int(np.sqrt(len(gram)))
        t, values = orthonormal(gram.reshape(size, size))
        k, old = last.column("k")[0].as_py(), array(last.column("values")[0])
        moved = np.abs(values[:k] - old[:k]).max(initial=0) / max(values.max(initial=0), 1e-300) if len(old) else np.inf
        raw = lambda x: pa.array([x.tobytes()], pa.binary())
        return pa.table({"slice": pa.array([key[0].as_py()], pa.string()), "t": raw(t), "size": pa.array([size], pa.int32()), "values": raw(values), "k": pa.array([k], pa.int32()), "moved": pa.array([float(moved)])})

    return grams(y).groupBy("slice").cogroup(before.groupBy("slice")).applyInArrow(solve, "slice string, t binary, size int, values binary, k int, moved double")


def started(tiled: DataFrame, shapes: DataFrame, seed: int) -> DataFrame:
    """Seeded random columns for the columns' side of each slice of ``shapes`` (slice, size)."""

    def draw(key: tuple, rows: pa.Table) -> pa.Table:
        name, block = key[0].as_py(), key[1].as_py()
        rng = np.random.default_rng([seed, zlib.crc32((name or "").encode()), block])
        return panels(name, block, rng.standard_normal((rows.column("n")[0].as_py(), rows.column("size")[0].as_py())))

    blocks = tiled.groupBy("slice", F.col("cb").alias("block")).agg(F.max("columns").alias("n"))
    return blocks.join(shapes.select("slice", "size"), "slice").groupBy("slice", "block").applyInArrow(draw, DENSE)


def svd(tiled: DataFrame, shapes: DataFrame, rounds: int = ROUNDS, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Left singular vectors, (slice, values, k, size) and (slice, reason) of slices that don't settle.

    ``tiled`` is a written table of :func:`tiles`; ``shapes`` (slice, k, size) says how many values are wanted, and with how many columns
    they are looked for. Vectors beyond a slice's rank are zero. Signs are as they come.
    """
    stages = Stages(tiled.sparkSession)
    x = stages.keep("x", started(tiled, shapes, seed))
    last = stages.keep("last", shapes.select("slice", "k", F.lit(b"").alias("values")))
    found, values = [], []
    failed = None
    for r in range(2 * max(1, rounds) + 1):
        left = r % 2 == 0
        y = stages.keep("y", product(tiled, x, transposed=not left))
        now = stages.keep("last", ritz(y, last))
        x = stages.keep("x", turned(y, now))
        last = now.select("slice", "k", "values")
        if not left:
            continue
        end = r == 2 * max(1, rounds)
        done = now.where(F.col("moved") <= (TAKEN if end else SETTLED))
        rest = now.where(F.col("moved") > (TAKEN if end else SETTLED))
        if not done.isEmpty():
            found.append(staged(x.join(F.broadcast(done.select("slice")), "slice", "left_semi")))
            values.append(staged(done.select("slice", "values", "k", "size")))
        if rest.isEmpty():
            break
        if end:
            reason = F.format_string(f"singular values still move by %.1e after {rounds} rounds", "moved")
            failed = staged(rest.select("slice", reason.alias("reason")))
        x = x.join(F.broadcast(rest.select("slice")), "slice", "left_semi")
        last = rest.select("slice", "k", "values")
    spark = tiled.sparkSession
    every = lambda parts, kind: _union(parts) if parts else spark.createDataFrame([], kind)
    out = every(found, DENSE), every(values, "slice string, values binary, k int, size int"), failed if failed is not None else spark.createDataFrame([], "slice string, reason string")
    stages.drop()
    return out


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scaled(left: DataFrame, values: DataFrame, root: bool) -> DataFrame:
    """(slice, t, size): the first k columns, with signs that make each column's largest entry positive, times the roots of their values if asked for."""

    def largest(key: tuple, rows: pa.Table) -> pa.Table:
        block = dense(rows)
        at = np.abs(block).argmax(0)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.string()), "block": pa.array([key[1].as_py()], pa.int32()), "most": pa.array([block[at, np.arange(block.shape[1])].tobytes()], pa.binary())})

    def diagonal(key: tuple, most: pa.Table, value: pa.Table) -> pa.Table:
        if not most.num_rows or not value.num_rows:
            return pa.table({"slice": pa.array([], pa.string()), "t": pa.array([], pa.binary()), "size": pa.array([], pa.int32())})
        each = np.array([array(m) for m in most.sort_by("block").column("most")])
        sign = np.sign(each[np.abs(each).argmax(0), np.arange(each.shape[1])])
        sign[sign == 0] = 1
        k, size, s = value.column("k")[0].as_py(), value.column("size")[0].as_py(), array(value.column("values")[0])
        t = np.zeros((size, k))
        n = min(k, size)
        t[np.arange(n), np.arange(n)] = sign[:n] * (np.sqrt(s[:n]) if root else 1)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.string()), "t": pa.array([t.tobytes()], pa.binary()), "size": pa.array([size], pa.int32())})

    most = left.groupBy("slice", "block").applyInArrow(largest, "slice string, block int, most binary")
    return most.groupBy("slice").cogroup(values.groupBy("slice")).applyInArrow(diagonal, "slice string, t binary, size int")


def unblocked(x: DataFrame) -> DataFrame:
    """(slice, rank, vector): a row for each row of the blocks."""

    def rows_of(key: tuple, rows: pa.Table) -> pa.Table:
        block = dense(rows)
        n, k = block.shape
        flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(block.ravel()))
        return pa.table({"slice": pa.array([key[0].as_py()] * n, pa.string()), "rank": pa.array(np.arange(n, dtype=np.int32) + BLOCK * key[1].as_py()), "vector": flat})

    return x.groupBy("slice", "block").applyInArrow(rows_of, "slice string, rank int, vector array<double>")


def shapes_of(vocab: DataFrame, k: Callable, room: int = 2, more: int = 16) -> DataFrame:
    """(slice, n, k, size) of a vocabulary: k values of the number of words n, looked for with ``room`` * k + ``more`` columns, or as many as there are words."""
    n = vocab.groupBy("slice").agg(F.count("*").cast("int").alias("n")).withColumn("k", k(F.col("n")).cast("int"))
    return n.withColumn("size", F.least("n", room * F.col("k") + more).cast("int"))


def embed(entries: DataFrame, vocab: DataFrame, components: int, rounds: int = ROUNDS, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(slice, word, rank, vector) as :func:`.embedding.factorise` has them, and (slice, reason) of slices that don't settle, which have no vectors.

    A slice of words without entries has zeros; null slices are slices of their own nowhere: entries and vocabulary have none.
    """
    if components < 1:
        raise ValueError(f"at least one dimension is needed, not {components}")
    tiled = staged(tiles(entries))
    shapes = staged(shapes_of(vocab, lambda n: F.greatest(F.lit(1), F.least(F.lit(components), n - 1))))
    left, values, failed = svd(tiled, shapes.join(tiled.select("slice").distinct(), "slice", "left_semi"), rounds, seed)
    rows = unblocked(turned(left, staged(scaled(left, values, root=True))))
    ok = shapes.join(failed.select("slice"), "slice", "left_anti").select("slice", "k")
    every = vocab.select("slice", "word", F.col("rank").cast("int").alias("rank")).join(ok, "slice").join(rows, ["slice", "rank"], "left")
    zeros = F.array_repeat(F.lit(0.0), F.col("k"))
    return every.select("slice", "word", "rank", F.coalesce("vector", zeros).alias("vector")), failed


# --- non-negative factors -------------------------------------------------------------------------------------

FACTOR = "slice string, block int, panel int, width int, data binary, gram binary, moved double, cross double"


def _half(x: DataFrame, sides: DataFrame) -> DataFrame:
    """Start factors of one side from its singular vectors: of each column the half that ``sides`` (slice, turn, scale) names, scaled."""

    def work(key: tuple, block: pa.Table, side: pa.Table) -> pa.Table:
        if not block.num_rows or not side.num_rows:
            return _factor(None, 0, np.zeros((0, 1)), 0.0, 0.0).slice(0, 0)
        turn, scale = array(side.column("turn")[0]), array(side.column("scale")[0])
        return _factor(key[0].as_py(), key[1].as_py(), np.maximum(dense(block)[:, : len(turn)] * turn, 0) * scale, 0.0, 0.0)

    return x.groupBy("slice", "block").cogroup(per_block(x, sides).groupBy("_slice", "_block")).applyInArrow(work, FACTOR)


def _factor(name: str | None, block: int, x: np.ndarray, moved: float, cross: float) -> pa.Table:
    gram = (x.T @ x).tobytes()
    one = lambda v, kind: pa.array([v], kind)
    return pa.table(
        {
            "slice": one(name, pa.string()), "block": one(block, pa.int32()), "panel": one(0, pa.int32()), "width": one(x.shape[1], pa.int32()), "data": one(np.ascontiguousarray(x, "<f8").tobytes(), pa.binary()),
            "gram": one(gram, pa.binary()), "moved": one(float(moved), pa.float64()), "cross": one(float(cross), pa.float64()),
        }
    )


def _sums(x: DataFrame, name: str) -> DataFrame:
    """(slice, ``name``): by column the sums of positive and negative parts and of their squares."""

    def one(key: tuple, rows: pa.Table) -> pa.Table:
        b = dense(rows)
        p, n = np.maximum(b, 0), np.maximum(-b, 0)
        return pa.table({"slice": pa.array([key[0].as_py()], pa.string()), "sums": pa.array([np.concatenate([p.sum(0), n.sum(0), (p * p).sum(0), (n * n).sum(0)]).tolist()])})

    each = x.groupBy("slice", "block").applyInArrow(one, "slice string, sums array<double>")
    places = each.select("slice", F.posexplode("sums").alias("at", "v")).groupBy("slice", "at").agg(F.sum("v").alias("v"))
    return places.groupBy("slice").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda p: p["v"]).alias(name))


def start_factors(tiled: DataFrame, shapes: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """W and H (rows of :data:`FACTOR`) to begin with: of each pair of singular vectors the halves of one sign with more weight; and slices that don't settle."""
    left, values, failed = svd(tiled, shapes, seed=seed)
    left = staged(turned(left, staged(scaled(left, values, root=False))))
    right = staged(product(tiled, left, transposed=True))  # the right vectors times their values
    sums = staged(_sums(left, "a").join(_sums(right, "b"), "slice").join(values, "slice"))

    def choose(batches):
        for batch in batches:
            names, turns, of_w, of_h = [], [], [], []
            for name, a, b, raw, k in zip(*(batch.column(c) for c in ("slice", "a", "b", "values", "k")), strict=True):
                a, b = (np.array(v.as_py()).reshape(4, -1)[:, : k.as_py()] for v in (a, b))
                s = array(raw)[: a.shape[1]]
                v = np.where(s > 0, s, 1)
                pos, neg = np.sqrt(a[2] * b[2]) / v, np.sqrt(a[3] * b[3]) / v
                turn = np.where(neg > pos, -1.0, 1.0)
                turn[0] = -1.0 if a[1][0] > a[0][0] else 1.0
                norm = np.where(turn > 0, pos, neg)
                size = np.sqrt(s * norm)
                x, y = np.sqrt(np.where(turn > 0, a[2], a[3])), np.sqrt(np.where(turn > 0, b[2], b[3])) / v
                names.append(name.as_py())
                turns.append(turn.tobytes())
                # The right vectors come times their values.
                of_w.append((np.divide(size, x, out=np.zeros_like(size), where=norm > 0)).tobytes())
                of_h.append((np.divide(size, y * v, out=np.zeros_like(size), where=norm > 0)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array(x, pa.binary()) for x in (turns, of_w, of_h))], ["slice", "turn", "w", "h"])

    chosen = staged(sums.mapInArrow(choose, "slice string, turn binary, w binary, h binary"))
    side = lambda x, c: _half(x, chosen.select("slice", "turn", F.col(c).alias("scale")))
    return side(left, "w"), side(right, "h"), failed


def _updated(tiled: DataFrame, x: DataFrame, other: DataFrame, transposed: bool) -> DataFrame:
    """``x`` after a sweep over its columns towards the other factor: every row by itself, from the other's Gram matrix and the product of M (or M') with it."""

    def sweep(key: tuple, parts: pa.Table, held: pa.Table) -> pa.Table:
        if not held.num_rows:
            return _factor(None, 0, np.zeros((0, 1)), 0.0, 0.0).slice(0, 0)
        now = dense(held).copy()
        k = now.shape[1]
        target = np.zeros_like(now)
        if parts.num_rows:
            got = summed(parts, k)[: len(now)]
            target[: len(got)] = got
        gram = np.array(held.column("other")[0].as_py()).reshape(k, k)
        moved = linalg.sweep(now, gram, target)
        return _factor(key[0].as_py(), key[1].as_py(), now, moved, (target * now).sum())

    keys = ["slice", "block"]
    parts = partial_products(tiled, other.select("slice", "block", "panel", "width", "data"), transposed)
    return parts.groupBy(*keys).cogroup(x.select(*keys, "panel", "width", "data").join(_gram(other, "other"), "slice").groupBy(*keys)).applyInArrow(sweep, FACTOR)


def _gram(x: DataFrame, name: str) -> DataFrame:
    """(slice, ``name``): the sum of the blocks' Gram matrices, as an array."""

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        return pa.table({"slice": pa.array([key[0].as_py()], pa.string()), "g": pa.array([sum(array(g) for g in rows.column("gram")).tolist()])})

    return x.groupBy("slice").applyInArrow(add, "slice string, g array<double>").withColumnRenamed("g", name)


def nmf(tiled: DataFrame, shapes: DataFrame, most: int = 500, tolerance: float = 1e-4, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """W, H (rows of :data:`FACTOR`), (slice, rounds, residual) and (slice, reason): M = W H without negative entries, by sweeps over one column at a time.

    A slice ends when a round moves its factors by at most ``tolerance`` times what the first one did, or by what is rounding, or after ``most`` rounds; residual is the norm of M - W H.
    """
    squares = tiled.select("slice", "v").mapInArrow(_square_sums, "slice string, v double").groupBy("slice").agg(F.sum("v").alias("whole"))
    squares = staged(squares)
    w, h, failed = start_factors(tiled, shapes, seed)
    stages = Stages(tiled.sparkSession)
    w, h = stages.keep("w", w), stages.keep("h", h)
    first, out_w, out_h, ends = None, [], [], []
    for r in range(1, most + 1):
        w = stages.keep("w", _updated(tiled, w, h, transposed=False))
        h = stages.keep("h", _updated(tiled, h, w, transposed=True))
        moves = w.select("slice", "moved", F.lit(0.0).alias("cross")).unionByName(h.select("slice", "moved", "cross")).groupBy("slice").agg(F.sum("moved").alias("moved"), F.sum("cross").alias("cross"))
        product_of = F.aggregate(F.zip_with("gw", "gh", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        state = moves.join(_gram(w, "gw"), "slice").join(_gram(h, "gh"), "slice").join(squares, "slice")
        residual = F.sqrt(F.greatest(F.lit(0.0), F.col("whole") - 2 * F.col("cross") + product_of))
        state = state.select("slice", "moved", residual.alias("residual"), F.sqrt("whole").alias("norm"))
        state = state.withColumn("first", F.col("moved")) if first is None else state.join(first, "slice")
        state = stages.keep("state", state)
        first = state.select("slice", "first")
        over = F.col("moved") <= F.greatest(tolerance * F.col("first"), STILL * F.col("norm")) if r < most else F.lit(True)
        done, rest = state.where(over), state.where(~over)
        if not done.isEmpty():
            ended = F.broadcast(done.select("slice"))
            out_w.append(staged(w.join(ended, "slice", "left_semi")))
            out_h.append(staged(h.join(ended, "slice", "left_semi")))
            ends.append(staged(done.select("slice", F.lit(r).alias("rounds"), "residual")))
        if rest.isEmpty():
            break
        going = F.broadcast(rest.select("slice"))
        w, h = w.join(going, "slice", "left_semi"), h.join(going, "slice", "left_semi")
    spark = tiled.sparkSession
    every = lambda parts, kind: _union(parts) if parts else spark.createDataFrame([], kind)
    out = every(out_w, FACTOR), every(out_h, FACTOR), every(ends, "slice string, rounds int, residual double"), failed
    stages.drop()
    return out


def _square_sums(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("slice"), pa.array([float((array(v) ** 2).sum()) for v in batch.column("v")])], ["slice", "v"])


def topic_factors(entries: DataFrame, vocab: DataFrame, topics: int, max_iter: int = 500, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(slice, topic_id, word, rank, focus, weight) as :func:`.topics.factors` has them, (slice, rounds, residual), and (slice, reason) of slices without a result.

    A slice of fewer words than topics, with negative entries, or whose start doesn't settle, has a reason and no rows; a slice without entries has neither.
    """
    if topics < 1:
        raise ValueError(f"at least one topic is needed, not {topics}")
    shapes = staged(shapes_of(vocab, lambda n: F.lit(topics)))
    below = entries.where("ppmi < 0").select("slice").distinct().select("slice", F.lit("negative values in the matrix").alias("reason"))
    few = shapes.where(F.col("n") < topics).join(entries.select("slice").distinct(), "slice", "left_semi")
    few = few.select("slice", F.concat(F.lit(f"{topics} topics need as many words; there are "), F.col("n").cast("string")).alias("reason"))
    unfit = staged(below.unionByName(few).groupBy("slice").agg(F.min("reason").alias("reason")))
    tiled = staged(tiles(entries.join(unfit, "slice", "left_anti")))
    w, h, ends, failed = nmf(tiled, shapes.join(tiled.select("slice").distinct(), "slice", "left_semi"), max_iter, seed=seed)
    side = lambda x, name: unblocked(x.select("slice", "block", "panel", "width", "data")).select("slice", "rank", F.posexplode("vector").alias("topic_id", name))
    got = side(w, "focus").join(side(h, "weight"), ["slice", "rank", "topic_id"], "full")
    words = vocab.select("slice", "word", F.col("rank").cast("int").alias("rank"))
    every = words.join(ends.select("slice"), "slice", "left_semi").withColumn("topic_id", F.explode(F.sequence(F.lit(0), F.lit(topics - 1))))
    rows = every.join(got, ["slice", "rank", "topic_id"], "left").fillna(0.0, ["focus", "weight"])
    return rows.select("slice", "topic_id", "word", "rank", "focus", "weight"), ends, unfit.unionByName(failed)
