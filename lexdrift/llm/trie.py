"""Prefix tries of conversations as level-order unary degree sequences (LOUDS), built shard by shard.

A turn is told by a digest of its role and text, a prefix by a chained digest of its turns, its name: texts are read once and
never shuffled. Conversations with equal turns are one sequence with a count, so copies cost nothing further on.

1. Heavy prefixes, those of more than ``HEAVY`` different sequences, are found by counting names a few depths at a time, each
   time as many again, and only below prefixes that were heavy. The root counts as heavy.
2. Every other sequence hangs below its deepest heavy prefix, in a light subtree of at most ``HEAVY`` sequences. Light subtrees are dealt to
   shards by the name of their top. numpy numbers a shard's nodes in level order below a root that isn't a node and writes its trie as a row: for
   each node a 1 for each child and a 0, as bits, and arrays of labels and weights in the same order.
3. Rollups read the tries: parents by rank and select on the bits, sums by ``add.at`` over the levels in reverse.
4. Heavy prefixes are merged apart: what the tops of light subtrees give is summed by parent, then over each heavy prefix's ancestors.

The ids that end at a node are sorted by range, joined in pieces where they lie, and the pieces pass one digest in order: a node of a
third of all ids is a stream of pieces for one task, never a list.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import small
from .common import parts, staged

#: Sequences below a prefix beyond which it is heavy, turns in a shard's trie, and depths that are counted at first.
HEAVY, SHARD, STEP = 4096, 1 << 16, 4
#: Ids that are joined in a piece, and heavy prefixes up to which their table is broadcast (under 100 bytes each).
PIECE, BROADCAST_HEAVY = 1 << 14, 100_000
#: Bytes of a name; the root's name.
NAME = 16
ROOT = bytes(NAME)
NO_ENDS = hashlib.sha256(b"").digest()
SEQUENCES = "name binary, names array<binary>, sizes array<bigint>"


def turns_of(rows: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, label, size) of ``rows`` (conv_id, turn, role, text) with a conv_id, ordered by turn (null first), role and label.

    Null role or text is empty. The label is 32 hexadecimal digits of a digest of role and text, the size the text's bytes.
    """
    from pyspark.sql import Window

    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    label = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * NAME)
    told = rows.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), label.alias("label"), F.octet_length(text).cast("long").alias("size")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "label")
    return told.select("conv_id", F.row_number().over(order).alias("pos"), "label", "size")


def shared_starts(turns: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """``turns`` rebuilt: of conversation c the first h turns of c - c % group, then c's own after its first h; h = crc32(decimal c) % most.

    A row for each conversation: conv_id, turns (array of pos, label, size). % is SQL's: its sign is c's.
    """
    turns = staged(turns)
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    turn = F.struct("pos", "label", "size")
    heads = turns.where((F.col("pos") < most) & (F.col("conv_id") % group == 0)).groupBy(F.col("conv_id").alias("start")).agg(F.collect_list(turn).alias("head"))
    # A conversation without turns of its own to keep is one all the same.
    own = turns.groupBy("conv_id").agg(F.collect_list(F.when(F.col("pos") > h, turn)).alias("own"))
    both = own.join(heads, own["conv_id"] - own["conv_id"] % group == heads["start"], "left")
    head = F.filter(F.coalesce("head", F.array().cast("array<struct<pos:int,label:string,size:bigint>>")), lambda t: t["pos"] <= h)
    return both.select("conv_id", F.array_sort(F.concat(head, "own")).alias("turns"))


def named(convs: DataFrame) -> DataFrame:
    """(conv_id, name, names, sizes) of ``convs`` (conv_id, turns): names of all prefixes, the root's left out, and of the whole; sizes of the turns' texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns = batch.column("turns")
            flat = turns.flatten()
            offsets = turns.offsets.to_numpy() - turns.offsets[0].as_py() if len(turns) else np.zeros(1, np.int32)
            names, whole, at = [], [], 0
            labels = flat.field("label").to_pylist()
            for end in offsets[1:].tolist():
                name = ROOT
                for label in labels[at:end]:
                    name = hashlib.blake2b(name + bytes.fromhex(label), digest_size=NAME).digest()
                    names.append(name)
                whole.append(name)
                at = end
            ends = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"),
                    pa.array(whole, pa.binary()),
                    pa.ListArray.from_arrays(ends, pa.array(names, pa.binary())),
                    pa.ListArray.from_arrays(ends, flat.field("size")),
                ],
                ["conv_id", "name", "names", "sizes"],
            )

    return convs.mapInArrow(work, f"conv_id long, {SEQUENCES}")


def ends_of(convs: DataFrame) -> DataFrame:
    """(name, ends): SHA-256 of the decimal conv_ids that end at a name, in ascending order with commas between."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, ids = batch.column("name").to_pylist(), batch.column("conv_id").to_pylist()
            new = [i for i in range(len(ids)) if i == 0 or name[i] != name[i - 1]] + [len(ids)]
            cuts = [(a, min(a + PIECE, b)) for start, b in zip(new, new[1:], strict=False) for a in range(start, b, PIECE)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name[a] for a, _ in cuts], pa.binary()), pa.array([ids[a] for a, _ in cuts], pa.int64()), pa.array([",".join(map(str, ids[a:b])) for a, b in cuts])],
                ["name", "first", "ids"],
            )

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            names, ends = [], []
            for name, ids in zip(batch.column("name").to_pylist(), batch.column("ids"), strict=True):
                if name == last:
                    state.update(b",")
                else:
                    if last is not None:
                        names.append(last)
                        ends.append(state.digest())
                    last, state = name, hashlib.sha256()
                state.update(ids.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(ends, pa.binary())], ["name", "ends"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.digest()], pa.binary())], ["name", "ends"])

    # By range of name and id, so that the ids of one name are in as many tasks as they need.
    lying = convs.select("name", "conv_id").repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id")
    joined = staged(lying.mapInArrow(pieces, "name binary, first long, ids string"))
    return joined.repartition("name").sortWithinPartitions("name", "first").mapInArrow(digests, "name binary, ends binary")


def sequences(convs: DataFrame) -> DataFrame:
    """Different sequences of :func:`named`: name, names, sizes, n (conversations), conv_id (the smallest), ends."""
    groups = convs.groupBy("name").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"))
    found = groups.join(ends_of(convs), "name")
    return found.join(convs.drop("name"), "conv_id").select("name", "names", "sizes", "n", "conv_id", "ends")


def heavy_prefixes(seqs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Heavy prefixes (name, depth, seqs, n, conv_id, size) without the root, and (sequence, depth, top) of sequences below one: the deepest's depth and name."""
    spark = seqs.sparkSession
    heavy, below = [], []
    open_, start, step = seqs, 0, STEP
    while True:
        cut = F.slice("names", start + 1, step)
        rows = open_.select(F.col("name").alias("sequence"), F.posexplode(F.arrays_zip(cut.alias("name"), F.slice("sizes", start + 1, step).alias("size"))).alias("at", "one"), "n", "conv_id")
        rows = rows.select("sequence", (F.col("at") + 1 + start).alias("depth"), "one.name", "one.size", "n", "conv_id")
        counts = rows.groupBy("name", "depth").agg(F.count("*").alias("seqs"), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.max("size").alias("size"))
        found = staged(counts.where(F.col("seqs") > HEAVY))
        if found.isEmpty():
            break
        heavy.append(found)
        known = small(found.select("name"), BROADCAST_HEAVY)
        below.append(staged(rows.join(known, "name").groupBy("sequence").agg(F.max(F.struct("depth", F.col("name").alias("top"))).alias("deepest"))))
        start += step
        step *= 2
        again = below[-1].where(F.col("deepest.depth") == start).select(F.col("sequence").alias("name"))
        open_ = staged(open_.join(again, "name"))
    empty = spark.createDataFrame([], "name binary, depth int, seqs long, n long, conv_id long, size long")
    none = spark.createDataFrame([], "sequence binary, depth int, top binary")
    for x in heavy:
        empty = empty.unionByName(x)
    for x in below:
        none = none.unionByName(x.select("sequence", "deepest.*"))
    return empty, none.groupBy("sequence").agg(F.max(F.struct("depth", "top")).alias("deepest")).select("sequence", "deepest.*")


def louds(parent: np.ndarray, n: int) -> np.ndarray:
    """The bits of a tree of nodes 0 to n - 1 in level order, of which 0 is the root: for each node a 1 for each child and a 0; ``parent`` is that of nodes 1 and on."""
    children = np.bincount(parent, minlength=n)
    bits = np.ones(2 * n - 1, bool)
    bits[np.cumsum(children + 1) - 1] = False
    return bits


def parents(bits: np.ndarray) -> np.ndarray:
    """The parent of nodes 1 and on: the number of zeros before the node's own 1."""
    return np.cumsum(~bits)[bits]


def child_counts(bits: np.ndarray) -> np.ndarray:
    """The number of children of every node."""
    ends = np.flatnonzero(~bits)
    return np.diff(ends, prepend=-1) - 1


def built(paths: list[list[bytes]], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """The trie of ``paths`` of names: its bits, the names and depths of nodes 1 and on in level order, and each path's nodes.

    ``starts`` are the depths of the paths' first names. Nodes with one parent are in order of their names.
    """
    lengths = np.array([len(p) for p in paths], np.int64)
    flat = np.array([name for p in paths for name in p], dtype=f"V{NAME}")
    names, first, which = np.unique(flat, return_index=True, return_inverse=True)
    total = len(names)
    begin = np.cumsum(lengths) - lengths
    level = np.arange(len(flat)) - np.repeat(begin, lengths)
    before = np.where(level > 0, which[np.arange(len(flat)) - 1], -1)
    up, depth = before[first], (level + np.repeat(starts, lengths))[first]
    level = level[first]
    # Level by level: nodes follow their parents' order, then that of their names, which is that of the numbers.
    place, order, last = np.full(total, -1), [], 0
    by_level = np.argsort(level, kind="stable")
    cuts = np.searchsorted(level[by_level], np.arange(int(level.max(initial=-1)) + 2))
    for a, b in zip(cuts, cuts[1:], strict=False):
        at = by_level[a:b]
        above = np.where(up[at] >= 0, place[up[at]], 0)
        at = at[np.lexsort((at, above))]
        place[at] = np.arange(last + 1, last + 1 + len(at))
        last += len(at)
        order.append(at)
    order = np.concatenate(order) if order else np.zeros(0, np.int64)
    above = np.where(up[order] >= 0, place[up[order]], 0)
    nodes = place[which]
    return louds(above, total + 1), names[order], depth[order], np.split(nodes, begin[1:]) if len(paths) else []


TRIES = "shard long, nodes long, bits binary, names binary, depths binary, sizes binary, counts binary, firsts binary, ended array<bigint>, ends array<binary>, tops array<binary>, top_ids array<bigint>"


def tries(seqs: DataFrame, shards: int) -> DataFrame:
    """A row for each shard of ``seqs`` (name, names, sizes, n, conv_id, ends, depth, top, top_id): its trie in level order.

    nodes (without the root), bits (of the LOUDS, packed), names, depths, sizes of last texts, counts of conversations that end there and
    their smallest ids (little-endian arrays); ended and ends: nodes at which some end and the ids' digests; tops and top_ids: for the root's
    children the name and id of the heavy prefix above.
    """

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        depth = rows.column("depth").to_numpy()
        names = [x[d:] for x, d in zip(rows.column("names").to_pylist(), depth.tolist(), strict=True)]
        sizes = [x[d:] for x, d in zip(rows.column("sizes").to_pylist(), depth.tolist(), strict=True)]
        bits, label, depths, nodes = built(names, depth + 1)
        total = len(label)
        size, count, first = np.zeros(total, np.int64), np.zeros(total, np.int64), np.full(total, np.iinfo(np.int64).max)
        size[np.concatenate(nodes) - 1] = np.concatenate([np.array(s, np.int64) for s in sizes])
        last = np.array([x[-1] for x in nodes]) - 1
        count[last], first[last] = rows.column("n").to_numpy(), rows.column("conv_id").to_numpy()
        tops, top_ids = [None] * int(child_counts(bits)[0]), [None] * int(child_counts(bits)[0])
        for x, top, top_id in zip(nodes, rows.column("top").to_pylist(), rows.column("top_id").to_pylist(), strict=True):
            tops[x[0] - 1], top_ids[x[0] - 1] = top, top_id
        raw = lambda a, kind: a.astype(kind).tobytes()
        return pa.table(
            {
                "shard": pa.array([key[0].as_py()], pa.int64()),
                "nodes": pa.array([total], pa.int64()),
                "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()),
                "names": pa.array([label.tobytes()], pa.binary()),
                "depths": pa.array([raw(depths, "<i4")], pa.binary()),
                "sizes": pa.array([raw(size, "<i8")], pa.binary()),
                "counts": pa.array([raw(count, "<i8")], pa.binary()),
                "firsts": pa.array([raw(first, "<i8")], pa.binary()),
                "ended": pa.array([last + 1], pa.list_(pa.int64())),
                "ends": pa.array([rows.column("ends").to_pylist()], pa.list_(pa.binary())),
                "tops": pa.array([tops], pa.list_(pa.binary())),
                "top_ids": pa.array([top_ids], pa.list_(pa.int64())),
            }
        )

    shard = F.pmod(F.xxhash64(F.element_at("names", F.col("depth") + 1)), F.lit(shards)).cast("long")
    return seqs.withColumn("shard", shard).groupBy("shard").applyInArrow(build, TRIES)


def read_bits(raw: bytes, nodes: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little", count=2 * nodes + 1).astype(bool)


def rolled(bits: np.ndarray, sizes: np.ndarray, counts: np.ndarray, firsts: np.ndarray) -> dict[str, np.ndarray]:
    """Rollups of nodes 1 and on of a trie, by its bits, in reverse level order: n_convs, conv_id, n_children, n_leaves, saved, parent."""
    up = parents(bits)
    children = child_counts(bits)[1:]
    n, first = np.append(0, counts), np.append(np.iinfo(np.int64).max, firsts)
    leaves = np.append(0, (children == 0).astype(np.int64))
    # Where levels begin: a level's children are the next level.
    begins = [1]
    while begins[-1] <= len(up):
        begins.append(int(np.searchsorted(up, begins[-1])) + 1)
    spans = list(zip(begins, begins[1:], strict=False))[::-1]
    for a, b in spans:
        at = up[a - 1 : b - 1]
        np.add.at(n, at, n[a:b])
        np.add.at(leaves, at, leaves[a:b])
        np.minimum.at(first, at, first[a:b])
    saved = np.append(0, (n[1:] - 1) * sizes)
    for a, b in spans:
        np.add.at(saved, up[a - 1 : b - 1], saved[a:b])
    return {"n_convs": n[1:], "conv_id": first[1:], "n_children": children, "n_leaves": leaves[1:], "saved": saved[1:], "parent": up}


NODES = "name binary, depth int, conv_id long, parent_conv_id long, parent binary, n_convs long, n_children long, n_leaves long, saved long, ends binary"


def rollups(shards: DataFrame) -> DataFrame:
    """A row for each node of :func:`tries`; ``parent`` is the heavy prefix above a top, null below."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.to_pylist():
                total = one["nodes"]
                array = lambda c, kind: np.frombuffer(one[c], kind)  # noqa: B023, E731
                got = rolled(read_bits(one["bits"], total), array("sizes", "<i8"), array("counts", "<i8"), array("firsts", "<i8"))
                up = got["parent"]
                tops = int((up == 0).sum())
                parent_id = np.append(0, got["conv_id"])[up]
                parent_id[:tops] = one["top_ids"]
                ends = [NO_ENDS] * total
                for at, digest in zip(one["ended"], one["ends"], strict=True):
                    ends[at - 1] = digest
                names = one["names"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([names[k : k + NAME] for k in range(0, len(names), NAME)], pa.binary()),
                        pa.array(array("depths", "<i4")),
                        pa.array(got["conv_id"]),
                        pa.array(parent_id),
                        pa.array(one["tops"] + [None] * (total - tops), pa.binary()),
                        *(pa.array(got[c]) for c in ("n_convs", "n_children", "n_leaves", "saved")),
                        pa.array(ends, pa.binary()),
                    ],
                    ["name", "depth", "conv_id", "parent_conv_id", "parent", "n_convs", "n_children", "n_leaves", "saved", "ends"],
                )

    return shards.mapInArrow(work, NODES)


def heavy_nodes(heavy: DataFrame, light: DataFrame, seqs: DataFrame) -> DataFrame:
    """Rollups of the heavy prefixes (name, depth, n, conv_id, size, the root with them), from the tops among ``light`` and the sequences that end there.

    A prefix's ancestors are those of the sequence that gave it its id.
    """
    sums = light.where("parent is not null").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("tops"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("saved"))
    prefix = heavy.join(seqs.select(F.col("conv_id").alias("id"), "names"), F.col("conv_id") == F.col("id"))
    root = F.array(F.lit(ROOT))
    prefix = prefix.select("name", "depth", "n", "conv_id", "size", F.concat(root, F.slice("names", 1, F.col("depth"))).alias("path"))
    own = prefix.join(sums, "name", "left").fillna(0, ["tops", "leaves", "saved"])
    own = staged(own.withColumn("saved", F.col("saved") + (F.col("n") - 1) * F.col("size")))
    above = own.select(F.explode("path").alias("name"), "leaves", "saved").groupBy("name").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("all_saved"))
    parent = F.when(F.col("depth") > 0, F.element_at("path", F.col("depth")))
    kids = own.select(parent.alias("name")).where("name is not null").groupBy("name").agg(F.count("*").alias("kids"))
    ids = own.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    ends = seqs.select(F.col("name").alias("whole"), F.col("ends"))
    found = own.withColumn("parent", parent).join(above, "name").join(kids, "name", "left").join(ids, "parent", "left")
    found = found.join(ends, F.col("name") == F.col("whole"), "left")
    children = F.col("tops") + F.coalesce("kids", F.lit(0))
    return found.select(
        "name",
        "depth",
        "conv_id",
        "parent_conv_id",
        "parent",
        F.col("n").alias("n_convs"),
        children.alias("n_children"),
        F.when(children == 0, 1).otherwise(F.col("n_leaves")).alias("n_leaves"),
        F.col("all_saved").alias("saved"),
        F.coalesce("ends", F.lit(NO_ENDS)).alias("ends"),
    )


def prefix_trie(convs: DataFrame) -> DataFrame:
    """A row for each different prefix of the turns of ``convs`` (conv_id once each, turns: array of pos, label, size), the empty one with them.

    name, conv_id (the smallest that starts so), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved (over the
    subtree, bytes of a node's last text times conversations but one), ends (digest of ids that are whole here). Without conversations none.
    """
    done = staged(named(convs))
    seqs = staged(sequences(done))
    heavy, below = heavy_prefixes(seqs)
    heavy, below = staged(heavy), staged(below)
    ids = small(heavy.select(F.col("name").alias("top"), F.col("conv_id").alias("top_id")), BROADCAST_HEAVY)
    least = seqs.groupBy().agg(F.count("*").alias("seqs"), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.sum(F.size("names")).alias("turns")).first()
    if not least["seqs"]:
        return seqs.select("name", F.lit(0).alias("depth"), "conv_id", F.col("conv_id").alias("parent_conv_id"), F.col("name").alias("parent"), *(F.lit(0).cast("long").alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")), "ends")
    root = seqs.sparkSession.createDataFrame([(ROOT, 0, least["n"], least["conv_id"], 0)], "name binary, depth int, n long, conv_id long, size long")
    under = seqs.join(below.join(ids, "top"), F.col("name") == F.col("sequence"), "left")
    under = under.withColumns({"depth": F.coalesce("depth", F.lit(0)), "top": F.coalesce("top", F.lit(ROOT)), "top_id": F.coalesce("top_id", F.lit(least["conv_id"]))})
    under = under.where(F.size("names") > F.col("depth")).drop("sequence")  # others end at a heavy prefix
    light = staged(rollups(staged(tries(under, parts(least["turns"], SHARD)))))
    return light.unionByName(heavy_nodes(root.unionByName(heavy.drop("seqs")), light, seqs))
