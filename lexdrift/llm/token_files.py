"""Token ids as files: static range asymmetric numeral system (rANS).

All blocks share one frequency table. A block holds whole documents and is coded on its own by
interleaved states (lanes): lane ``i`` codes ids ``i, i + lanes, ...``. Every ``SEGMENT`` steps a block has a
checkpoint. What begins there is a segment, a row of its own: the states at the checkpoint, the words
to the end of the last document that begins in it, and a checksum of those documents' ids. So every segment is decoded
without the others, by whatever task reads its row.

A token set is a folder of two Parquet tables:

``table``     id, frequency (sum ``1 << SCALE``): the shared static model
``segments``  shard, block, segment, first (ids of the shard before its documents), n_tokens, doc_ids, doc_tokens, lanes,
              skip (ids between checkpoint and first document), left (ids from the checkpoint to the block's end),
              words (little-endian unsigned 32 bit), states (64 bit), checksum
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, parts, shared_dir, staged, text_bytes
from .tokens import binaries, documents_ids, flat, slices, vocabulary_path

SCALE = 20
LOW = np.uint64(1 << 31)
LANES, SEGMENT = 1024, 256
#: Ids after which a block is closed (with its document), and bytes of text in a shard.
BLOCK, SHARD_BYTES = 1 << 19, 64 << 20
#: Shards up to which their table (16 bytes each) is broadcast when a set is read; beyond, it is joined by shuffle.
BROADCAST_SHARDS = 200_000
SEGMENTS = (
    "shard int, block int, segment int, first long, n_tokens long, doc_ids array<bigint>, doc_tokens array<bigint>, lanes int, "
    "skip long, left long, words binary, states binary, checksum long"
)


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies with sum ``1 << SCALE``, at least 1 for each id that occurs."""
    counts = counts.astype(np.float64)
    present = counts > 0
    room = (1 << SCALE) - int(present.sum())
    out = np.where(present, 1 + np.floor(counts / max(counts.sum(), 1) * room), 0).astype(np.int64)
    if present.any():
        out[int(np.argmax(counts))] += (1 << SCALE) - int(out.sum())
    return out


class Coder:
    """Encodes and decodes blocks with one table of frequencies."""

    def __init__(self, frequencies: np.ndarray):
        self.f = frequencies.astype(np.uint64)
        self.c = np.concatenate([[0], np.cumsum(self.f)[:-1]]).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(frequencies), dtype=np.uint16), frequencies.astype(np.int64))

    def encode(self, ids: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """Lanes, words, words before each step, and the states at each checkpoint."""
        n = len(ids)
        lanes = LANES if n >= 64 * LANES else max(1, n // 64)
        steps = -(-n // lanes)
        state = np.full(lanes, LOW, np.uint64)
        words: list[np.ndarray] = []
        states: list[np.ndarray] = []
        shift, low = np.uint64(32), np.uint64(0xFFFFFFFF)
        scale = np.uint64(SCALE)
        for t in range(steps - 1, -1, -1):
            ids_t = ids[t * lanes : (t + 1) * lanes]
            f, x = self.f[ids_t], state[: len(ids_t)]
            full = x >= (f << np.uint64(63 - SCALE))
            words.append((x[full] & low).astype("<u4"))
            x = np.where(full, x >> shift, x)
            q = x // f
            state[: len(ids_t)] = (q << scale) + (x - q * f) + self.c[ids_t]
            if t % SEGMENT == 0:
                states.append(state.astype("<u8"))
        words.reverse()
        before = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        return lanes, np.concatenate([np.zeros(0, "<u4"), *words]), before, np.array(states[::-1]).reshape(-1, lanes)

    def segments(self, ids: np.ndarray, sizes: np.ndarray) -> Iterator[dict]:
        """The segments of a block in which documents begin; ``sizes`` (all over 0) has the documents' numbers of ids."""
        lanes, words, before, states = self.encode(ids)
        ends = np.cumsum(sizes)
        width, raw = SEGMENT * lanes, ids.astype("<u2")
        for k in range(len(states)):
            a = k * width
            i, j = np.searchsorted(ends - sizes, [a, a + width])
            if i < j:
                lo, hi = int(ends[i] - sizes[i]), int(ends[j - 1])
                some = words[before[k * SEGMENT] : before[-(-hi // lanes)]]
                yield {
                    "segment": k, "documents": (int(i), int(j)), "at": lo, "n": hi - lo, "lanes": lanes, "skip": lo - a, "left": len(ids) - a,
                    "words": some.tobytes(), "states": states[k].tobytes(), "checksum": zlib.crc32(raw[lo:hi]),
                }

    def decode(self, n: int, lanes: int, skip: int, left: int, words: bytes, states: bytes, checksum: int) -> np.ndarray:
        """The ids of a segment's documents; raises where the checksum doesn't hold."""
        words_, state, at = np.frombuffer(words, "<u4"), np.frombuffer(states, "<u8").astype(np.uint64), 0
        mask, scale, shift = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
        total = skip + n
        got = np.empty(-(-total // lanes) * lanes, np.uint16)
        for a in range(0, total, lanes):
            x = state[: left - a]
            low = x & mask
            s = self.slot[low.astype(np.int64)]
            got[a : a + len(s)] = s
            x = self.f[s] * (x >> scale) + low - self.c[s]
            (need,) = np.nonzero(x < LOW)
            more = words_[at : at + len(need)]
            if len(more) < len(need):
                raise ValueError("a segment ends too early")
            x[need] = (x[need] << shift) | more
            at += len(need)
            state[: len(x)] = x
        got = got[skip:total]
        if zlib.crc32(got.astype("<u2")) != checksum:
            raise ValueError("a segment is damaged")
        return got


def write_tokens(docs: DataFrame, out: str, path: str | None = None, end_id: int = 1, ordinary: bool = False) -> None:
    """Encodes ``docs`` (doc_id, text) into a token set at ``out``, in ascending order of doc_id.

    Null text is empty; null ids come first; rows with one id are ordered by a hash of their text and
    equal rows are interchangeable. With ``ordinary`` the strings of special tokens are ordinary text. No documents give an
    empty set. Other columns are ignored.
    """
    spark, path = docs.sparkSession, path or vocabulary_path()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    shards = parts(text_bytes(docs), SHARD_BYTES)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                ids, ends = documents_ids(batch.column("text"), path, end_id, ordinary)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("part"), binaries(ids, ends)], ["doc_id", "part", "ids"]
                )

    at = shared_dir(spark)
    coded = staged(
        docs.withColumn("part", F.xxhash64("text")).mapInArrow(tokenise, "doc_id long, part long, ids binary"), at
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            total += np.bincount(flat(batch.column("ids")), minlength=1 << 16)
        (there,) = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["id", "n"])

    # At most one row for each id of the vocabulary.
    found = coded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 << 16, np.int64)
    for row in found:
        counts[row.id] = row.n
    table = quantise(counts)
    spark.createDataFrame(
        [(int(i), int(table[i])) for i in np.flatnonzero(table)], "id int, frequency int"
    ).coalesce(1).write.mode("overwrite").parquet(f"{out}/table")
    shared = spark.sparkContext.broadcast(table)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, shard = Coder(shared.value), TaskContext.get().partitionId()
        number = first = 0
        held: list[np.ndarray] = []
        names: list[int | None] = []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal number, first, held, names
            sizes = np.array([len(x) for x in held])
            ids = np.concatenate(held)
            rows = []
            for got in coder.segments(ids, sizes):
                i, j = got.pop("documents")
                at, n = got.pop("at"), got.pop("n")
                rows.append({"shard": shard, "block": number, "first": first + at, "n_tokens": n, "doc_ids": names[i:j], "doc_tokens": sizes[i:j].tolist()} | got)
            number, first, held, names = number + 1, first + len(ids), [], []
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

        room = BLOCK
        for batch in batches:
            for name, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                held.append(np.frombuffer(raw.as_py(), "<u2"))
                names.append(name)
                room -= len(held[-1])
                if room <= 0:
                    yield from close()
                    room = BLOCK
        if held:
            yield from close()

    kinds = pa.schema(
        [("shard", pa.int32()), ("block", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64())]
        + [("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("lanes", pa.int32()), ("skip", pa.int64()), ("left", pa.int64())]
        + [("words", pa.binary()), ("states", pa.binary()), ("checksum", pa.int64())]
    )
    (
        coded.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), "part")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "part")
        .mapInArrow(blocks, SEGMENTS)
        .write.mode("overwrite").option("compression", "uncompressed").parquet(f"{out}/segments")
    )
    discard(spark, at)


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """Documents of a token set: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32 bit)."""
    table = np.zeros(1 << 16, np.int64)
    for row in spark.read.schema("id int, frequency int").parquet(f"{out}/table").collect():  # one row an id
        table[row.id] = row.frequency
    shared = spark.sparkContext.broadcast(table)
    segments = spark.read.schema(SEGMENTS).parquet(f"{out}/segments")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                b = {k: batch.column(k)[i].as_py() for k in batch.schema.names}
                ids = coder.decode(b["n_tokens"], *(b[k] for k in ("lanes", "skip", "left", "words", "states", "checksum")))
                n = np.array(b["doc_tokens"], np.int64)
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b["shard"]] * len(n), pa.int32()), pa.array(b["doc_ids"], pa.int64()), pa.array(b["first"] + ends - n), pa.array(n), binaries(ids, ends, np.uint32)],
                    ["shard", "doc_id", "first", "n_tokens", "ids"],
                )

    # A shard's number follows the order of its documents; one row a shard.
    sizes = segments.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    shards = segments.agg(F.coalesce(F.max("shard"), F.lit(0))).first()[0] + 1
    before = F.broadcast(before) if shards <= BROADCAST_SHARDS else before
    return (
        segments.mapInArrow(decode, "shard int, doc_id long, first long, n_tokens long, ids binary")
        .join(before, "shard")
        .select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids")
    )
