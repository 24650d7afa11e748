"""Near-duplicates by SimHash fingerprints, found exactly in vantage-point trees.

Documents with equal fingerprints are one node from the start. Two fingerprints that differ in at most ``radius`` of 64 bits differ
in at most ``radius // 2`` bits in one of their halves. So there are two forests, each under the Hamming distance of
its half and with that smaller bound, r: the smaller it is against the spread of distances, the fewer fingerprints stand at
a border, and with r = 1 a split in two makes 1.14 fingerprints of one where bounds of 3 over 64 bits make 1.3.

A tree's node has a vantage point v and a distance m. By the triangle inequality the distances to v of two fingerprints within r
differ by r at most; so either both are within m + r of v, or both are beyond m. The near side takes those within m + r, the far side
those beyond m: what lies at the border goes to both, and no link is lost whatever v and m are.

The top of the forest is fitted on a bounded sample and routes every fingerprint to its shards; shards that hold over
``SHARD`` are split once more by trees of their own. A task then splits its shard's fingerprints in the same way down to
``LEAF``, compares all 64 bits there, and gives as few links as join what its links join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, staged
from .near import components, joined_labels

SEED, WIDTH, RADIUS = 42, 3, 3
#: Bytes of a text that are cut into words at once, and hashes whose bits are counted at once.
PIECE, BLOCK = 1 << 20, 1 << 14
#: Fingerprints that a tree is fitted on, levels of it, and how often shards are split before tasks go on by themselves.
SAMPLE, DEPTH, ROUNDS = 4096, 8, 2
#: Fingerprints of a shard beyond which it is split, and of a leaf that is compared as a whole.
SHARD, LEAF = 1 << 15, 512
#: Vantage points that are tried at a node, and the share of its fingerprints that the larger side may have.
TRIED, SHRINKS = 8, 0.9
SALTS = 16
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def word_runs(raw: bytes, width: int = WIDTH) -> Iterator[list[bytes]]:
    """The words of a lower-cased text in lists that overlap by ``width - 1`` words: pieces of about ``PIECE`` bytes, so that no list grows with the text."""
    at, held = 0, []
    while at < len(raw):
        cut = _SPACE.search(raw, at + PIECE)
        end = cut.end() if cut else len(raw)
        held += raw[at:end].split()
        at = end
        if at < len(raw) and len(held) >= width:
            yield held
            held = held[len(held) - width + 1 :] if width > 1 else []
    yield held


def fingerprint(raw: bytes, width: int = WIDTH) -> int:
    """The SimHash of a text in UTF-8: bit i is 1 if it is in over half of the shingles' hashes, each as often as it occurs."""
    total, n = np.zeros(64, np.int64), 0
    digest = xxhash.xxh64_intdigest
    for words in word_runs(raw.lower(), width):
        if len(words) >= width:
            shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
        elif n == 0 and words:
            shingles = iter([b" ".join(words)])
        else:
            continue
        h = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
        n += len(h)
        for k in range(0, len(h), BLOCK):
            part = h[k : k + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
            total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, x) of every row of ``docs`` (doc_id, text): x is the fingerprint as a signed long; a null text is empty, empty texts have 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", width) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x.view(np.int64))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, x long")


class Tree:
    """A vantage-point tree over 32-bit values: arrays of vantage points, distances and children (a leaf's number is ``~child``)."""

    def __init__(self, values: np.ndarray, r: int, depth: int, seed: int = 0):
        self.r, self.leaves = r, 0
        self.vantage: list[int] = []
        self.middle: list[int] = []
        self.near: list[int] = []
        self.far: list[int] = []
        self.root = self._node(values, depth, np.random.default_rng(seed))

    def _node(self, values: np.ndarray, depth: int, rng: np.random.Generator) -> int:
        found = vantage_of(values, self.r, rng) if depth and len(values) > 8 else None
        if found is None:
            self.leaves += 1
            return ~(self.leaves - 1)
        v, m, d = found
        at = len(self.vantage)
        for into, what in ((self.vantage, v), (self.middle, m), (self.near, 0), (self.far, 0)):
            into.append(what)
        self.near[at] = self._node(values[d <= m + self.r], depth - 1, rng)
        self.far[at] = self._node(values[d > m], depth - 1, rng)
        return at

    def route(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of a value, leaf): every leaf whose region a value is in or borders on."""
        index, leaf, open_ = [], [], [(self.root, np.arange(len(values)))]
        while open_:
            node, at = open_.pop()
            if not len(at):
                continue
            if node < 0:
                index.append(at)
                leaf.append(np.full(len(at), ~node, np.int64))
                continue
            d = np.bitwise_count(values[at] ^ np.uint32(self.vantage[node])).astype(np.int64)
            open_ += [(self.near[node], at[d <= self.middle[node] + self.r]), (self.far[node], at[d > self.middle[node]])]
        empty = [np.zeros(0, np.int64)]
        return np.concatenate(index or empty), np.concatenate(leaf or empty)


def vantage_of(values: np.ndarray, r: int, rng: np.random.Generator) -> tuple[int, int, np.ndarray] | None:
    """The vantage point, of some that are tried, and the distance with the smallest larger side; none if that is hardly smaller than all."""
    best = None
    for v in values[rng.integers(0, len(values), TRIED)]:
        d = np.bitwise_count(values ^ v).astype(np.int64)
        within = np.cumsum(np.bincount(d, minlength=33 + r))
        larger = np.maximum(within[r:], len(values) - within[: len(within) - r])
        m = int(larger.argmin())
        if best is None or larger[m] < best[0]:
            best = int(larger[m]), int(v), m, d
    return best[1:] if best and best[0] <= SHRINKS * len(values) else None


def half_of(x: np.ndarray, half: int) -> np.ndarray:
    return (x >> np.uint64(32 * half)).astype(np.uint32)


def linked_all(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions that join what links among all of ``x`` join: everything that a search has reached is left out of what is compared next."""
    a, b, rest = [], [], np.arange(len(x))
    while len(rest):
        seed, rest = rest[0], rest[1:]
        front = np.array([seed])
        while len(front) and len(rest):
            block, front = front[:64], front[64:]
            hit = np.zeros(len(rest), bool)
            for k in block:
                hit |= np.bitwise_count(x[rest] ^ x[k]) <= radius
            new, rest = rest[hit], rest[~hit]
            front = np.concatenate([front, new])
            a.append(np.full(len(new), seed))
            b.append(new)
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(a or empty), np.concatenate(b or empty)


def linked(x: np.ndarray, half: int, radius: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of distinct fingerprints ``x`` that join all those within ``radius`` that are within ``radius // 2`` in the half, and only such within ``radius`` steps."""
    r, rng = radius // 2, np.random.default_rng(seed)
    a, b, held = [], [], 0
    open_ = [np.arange(len(x))]
    while open_:
        at = open_.pop()
        if len(at) <= LEAF:
            i, j = np.nonzero(np.triu(np.bitwise_count(x[at][:, None] ^ x[at]) <= radius, 1))
            i, j = at[i], at[j]
        else:
            values = half_of(x[at], half)
            found = vantage_of(values, r, rng)
            if found is not None:
                _, m, d = found
                open_ += [at[d <= m + r], at[d > m]]
                continue
            i, j = linked_all(x[at], radius)  # close to each other in this half: searched as a whole
            i, j = at[i], at[j]
        a.append(i)
        b.append(j)
        held += len(i)
        if held > 4 * len(x):  # as few as join the same
            i, j = joined_labels(np.concatenate(a), np.concatenate(b))
            a, b, held = [i], [j], len(i)
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = joined_labels(np.concatenate(a), np.concatenate(b))
    signed = x.view(np.int64)
    return signed[i], signed[j]


def routed(members: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """``members`` (shard, half, x) with those of shards that have a tree sent on to its leaves' shards."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, half, x = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "half", "x"))
            order = np.argsort(shard, kind="stable")
            kinds, first = np.unique(shard[order], return_index=True)
            for name, at in zip(kinds.tolist(), np.split(order, first[1:]), strict=True) if len(order) else ():
                index, where = at, shard[at]
                if (tree := trees.get(name)) is not None:
                    i, leaf = tree.route(half_of(x[at].view(np.uint64), int(half[at[0]])))
                    index, where = at[i], (name << DEPTH + 1) + leaf + 2
                yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(half[index]), pa.array(x[index])], ["shard", "half", "x"])

    return members.mapInArrow(work, "shard long, half int, x long")


def fitted(members: DataFrame, sizes: DataFrame, r: int) -> dict[int, Tree]:
    """A tree for each shard of ``sizes`` (shard, n: over ``SHARD`` each), from about ``SAMPLE`` of its fingerprints, those with the smallest hashes."""

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        x = np.sort(rows.column("x").to_numpy()).view(np.uint64)
        half = rows.column("half")[0].as_py()
        return pa.table({"shard": [key[0].as_py()], "half": pa.array([half], pa.int32()), "sample": [half_of(x, half).tobytes()]})

    share = F.lit(2.0 * SAMPLE) / F.col("n") - F.lit(1.0)
    some = members.join(sizes, "shard").where(F.xxhash64("x", "shard") / F.lit(2.0**63) <= share)
    samples = some.groupBy("shard").applyInArrow(build, "shard long, half int, sample binary").collect()
    return {s.shard: Tree(np.frombuffer(s.sample, np.uint32), r, DEPTH, seed=s.shard) for s in samples}


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that join all fingerprints ``distinct`` (x: each once) that differ in at most ``radius`` bits."""

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        x = np.unique(rows.column("x").to_numpy().view(np.uint64))
        a, b = linked(x, rows.column("half")[0].as_py(), radius)
        return pa.table({"a": a, "b": b})

    halves = F.explode(F.array(F.lit(0), F.lit(1)))
    members = distinct.select("x", halves.alias("half")).select((F.col("half") + 2).cast("long").alias("shard"), "half", "x")
    for _ in range(ROUNDS):
        # At most 2 shards at first, then at most the leaves of their trees.
        sizes = staged(members.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > SHARD))
        trees = fitted(members, F.broadcast(sizes), radius // 2)
        if not trees:
            break
        members = staged(routed(members, trees))
    return members.groupBy("shard").applyInArrow(compare, "a long, b long").distinct()


def mark_similar(docs: DataFrame, radius: int = RADIUS, width: int = WIDTH) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hexadecimal digits), component_id.

    Fingerprints that differ in at most ``radius`` bits are linked; component_id is the smallest doc_id that links lead to, null if no row they lead to
    has one. Null texts are empty, and texts without words all have the fingerprint 0, which is linked like any other. Repeated rows
    give repeated rows; no documents give no rows; other columns are ignored.
    """
    if not 0 <= radius < 32:
        raise ValueError(f"a radius from 0 to 31 is needed, not {radius}")
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt")
    prints = staged(fingerprints(docs, width).select("doc_id", "x", salt))
    nodes = staged(prints.groupBy("x").agg(F.min("doc_id").alias("first"), F.count("*").alias("size")))
    at = shared_dir(docs.sparkSession)
    found = components(staged(links(nodes.select("x"), radius), at))
    joined = nodes.join(found.withColumnRenamed("id", "x"), "x", "left").where("size > 1 or component is not null")
    joined = staged(joined.withColumn("component", F.coalesce("component", "x")))
    top = joined.groupBy("component").agg(F.min("first").alias("top"))
    # A node is at every salt, so that copies are spread whatever their ids.
    named = joined.join(top, "component").select("x", F.lit(True).alias("told"), "top", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # They grow with the input and are small only as files: they aren't broadcast.
    out = prints.join(staged(named).hint("merge"), ["x", "salt"], "left")
    return out.select(
        "doc_id",
        F.lower(F.lpad(F.hex("x"), 16, "0")).alias("fingerprint"),
        F.when(F.col("told"), F.col("top")).otherwise(F.col("doc_id")).alias("component_id"),
    )
