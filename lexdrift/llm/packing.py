"""Packing token ids into sequences of one length.

Documents are dealt at random into groups; each group is packed on its own by first-fit decreasing:
the longest piece goes first, each into the first sequence with room. A tournament tree over the
sequences' free room finds that one in logarithmic time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, text_bytes
from .tokens import binaries, documents_ids, slices, vocabulary_path

#: Bytes of text in a group.
GROUP_BYTES = 2 << 20
PIECES = "sequence_id long, offset long, doc_id long, start long, length long, doc_tokens long, ids binary"


class Tournament:
    """Free room of bins 0, 1, ...; each inner node holds the most room below it."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.most = [room] * (2 * self.leaves)

    def take(self, size: int) -> tuple[int, int]:
        """Takes ``size`` from the first bin that has it; the bin and its room before."""
        most, at = self.most, 1
        if most[1] < size:
            raise ValueError("no bin has room")
        while at < self.leaves:
            at *= 2
            at += most[at] < size
        bin_, room = at - self.leaves, most[at]
        most[at] -= size
        while at > 1:
            at //= 2
            most[at] = max(most[2 * at], most[2 * at + 1])
        return bin_, room


def first_fit_decreasing(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """For each size its bin and its offset there."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    if len(sizes):
        tree = Tournament(len(sizes), room)
        for i in np.argsort(-sizes, kind="stable").tolist():
            bins[i], left = tree.take(int(sizes[i]))
            offsets[i] = room - left
    return bins, offsets


def pack(docs: DataFrame, room: int = 2048, seed: int = 7, path: str | None = None, end_id: int = 1, ordinary: bool = False) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) and their places in sequences of ``room`` ids.

    A document's ids end with ``end_id``; it is cut every ``room`` ids. A row is a piece: sequence_id,
    offset in it (without gaps from 0), doc_id, start and length in the document, doc_tokens, ids
    (little-endian unsigned 32 bit). With ``ordinary`` the strings of special tokens are ordinary text. Null text is empty (one piece with ``end_id``), null ids stay
    null, equal rows are packed each, no documents give no rows, other columns are ignored.
    """
    path = path or vocabulary_path()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    groups = parts(text_bytes(docs), GROUP_BYTES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        for whole in batches:
            for batch in slices(whole):
                ids, ends = documents_ids(batch.column("text"), path, end_id, ordinary)
                n = np.diff(ends, prepend=0)
                pieces = -(-n // room)
                doc = np.repeat(np.arange(len(n)), pieces)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * room
                length = np.minimum(n[doc] - start, room)
                mixed = np.zeros(len(n), np.uint64)
                for i, h in enumerate(batch.column("h").to_pylist()):  # equal rows go to different groups
                    mixed[i] = (h + seen[h] * 0x9E3779B97F4A7C15) % (1 << 64)
                    seen[h] += 1
                mixed = (mixed[doc] + number.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
                mixed ^= mixed >> np.uint64(31)
                group = (mixed % np.uint64(groups)).astype(np.int64)
                at = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group), batch.column("doc_id").take(at), pa.array(start), pa.array(length), pa.array(n[doc]), binaries(ids, np.cumsum(length))],
                    ["group", "doc_id", "start", "length", "doc_tokens", "ids"],
                )

    def place(key: tuple, pieces: pa.Table) -> pa.Table:
        sizes = pieces.column("length").to_numpy()
        bins, offsets = first_fit_decreasing(sizes, room)
        wide = [np.frombuffer(x.as_buffer(), "<u2").astype("<u4").tobytes() for x in pieces.column("ids")]
        return pa.table(
            {"sequence_id": pa.array((key[0].as_py() << 24) + bins), "offset": pa.array(offsets)}
            | {k: pieces.column(k) for k in ("doc_id", "start", "length", "doc_tokens")}
            | {"ids": pa.array(wide, pa.binary())}
        )

    return (
        docs.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text"))
        .mapInArrow(cut, "group long, doc_id long, start long, length long, doc_tokens long, ids binary")
        .groupBy("group")
        .applyInArrow(place, PIECES)
    )
