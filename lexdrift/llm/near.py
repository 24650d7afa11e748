"""Near-duplicates by bottom-k sketches of one hash function.

A document's set holds its distinct shingle hashes; the ``SKETCH`` smallest are its sketch. Documents
with equal sets are one node from the start. An inverted list holds the nodes in whose sketches two
retained values follow each other: of the union's ``RETAINED`` smallest values each is in both sets
with probability J, so two such values in a row are missed with probability under 0.44 ** 32 (4e-12) at
J = 0.85 (5e-10 at 0.8), and never in sets of fewer values.

A list first gives pairs with its smallest node only, its hub; the union of two sketches filters them (a
miss under 1e-9 at J = 0.8) and the full sets verify. What is linked becomes a component, and a
group of copies costs about as many comparisons as it has members.

What is left are nodes that share a list but no component. Nodes that share a list share its hub, so the
nodes of a hub, if they have several components, are compared with each other: first their sketches, by which most
have no candidate, then the full sets of those that have one, in blocks of bounded bytes. Nodes of hubs that are
larger than a block first go to further lists, of their rarest values, and only those that share one of these
meet; what most of a hub has in common brings no two together. Lists that are larger than a block are compared in blocks, each two of which meet
in a task. Only links leave a task, never pairs. So components are exact.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, shared_dir, staged
from .shingles import forget, shingle_hashes
from .tokens import slices

SKETCH, RETAINED = 64, 32
#: The least similarity (percent) at which a missed link is as improbable as said above.
LEAST_SIMILARITY = 80
#: Nodes in a block of sketches, shingles in a block of full sets, and values whose counts are taken at once.
BLOCK, SHINGLES, COLUMNS = 2048, 1 << 21, 2048
SALTS = 16


def least_common(similarity: int, miss: float = 1e-9, values: int = SKETCH) -> int:
    """Common values among ``values`` of a union below which a pair of the similarity is seen with probability under ``miss``."""
    p, total = similarity / 100, 0.0
    for k in range(values + 1):
        total += math.comb(values, k) * p**k * (1 - p) ** (values - k)
        if total >= miss:
            return k
    return values


def sketches(docs: DataFrame, width: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, most=2 << 20):
                hashes, count = shingle_hashes(batch.column("text"), width)
                ends = np.cumsum(count)
                n, name, sketch = [], [], []
                for a, b in zip(ends - count, ends, strict=True):
                    s = np.unique(hashes[a:b])
                    n.append(len(s))
                    name.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    sketch.append(s[:SKETCH].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("part"), pa.array(n, pa.int64()), pa.array(name, pa.binary()), pa.array(sketch, pa.binary())],
                    ["doc_id", "part", "n_shingles", "name", "sketch"],
                )
        forget()

    return docs.mapInArrow(work, "doc_id long, part long, n_shingles long, name binary, sketch binary")


def inverted(nodes: DataFrame) -> DataFrame:
    """(value, id, n): a row for each two neighbours among a node's retained values."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, lengths = [np.zeros(0, np.uint64)], []
            for raw in batch.column("sketch"):
                s = np.frombuffer(raw.as_buffer(), "<u8")[:RETAINED]
                values.append(s[:-1] * np.uint64(3) + (s[1:] ^ (s[1:] >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93))
                lengths.append(max(0, len(s) - 1))
            at = pa.array(np.repeat(np.arange(len(lengths)), lengths))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(values).view(np.int64)), batch.column("id").take(at), batch.column("n").take(at)], ["value", "id", "n"]
            )

    return nodes.select("id", "n", "sketch").mapInArrow(work, "value long, id long, n long")


def estimated(pairs: DataFrame, nodes: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) whose sketches' union doesn't rule them out."""
    share = least_common(similarity) / SKETCH

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"), strict=True)):
                both = np.concatenate([np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")])
                both.sort()
                twice = both[1:] == both[:-1]
                distinct = len(both) - int(twice.sum())
                if distinct > SKETCH:  # common values among the union's SKETCH smallest
                    new = np.concatenate([[True], ~twice])
                    twice = twice[: np.searchsorted(np.cumsum(new), SKETCH, side="right") - 1]
                good[i] = twice.sum() >= share * min(distinct, SKETCH)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    s = nodes.select("id", "sketch")
    return (
        pairs.join(s.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), "a")
        .join(s.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), "b")
        .select("a", "b", "sa", "sb")
        .mapInArrow(work, "a long, b long")
    )


def full_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(id, shingles) of ``nodes`` (id, doc_id, part), from a row of ``docs`` (doc_id, part, text) with that id and text."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = -1
        for whole in batches:
            # Equal rows come one after the other: one is enough.
            ids = whole.column("id").to_numpy()
            new = ids != np.concatenate([[last], ids[:-1]])
            last = ids[-1] if len(ids) else last
            for batch in slices(whole.filter(pa.array(new)), most=2 << 20):
                hashes, count = shingle_hashes(batch.column("text"), width)
                ends = np.cumsum(count)
                values = [np.unique(hashes[a:b]).tobytes() for a, b in zip(ends - count, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(values, pa.binary())], ["id", "shingles"])
        forget()

    # The nodes grow with the input: they aren't broadcast, however few.
    nodes = nodes.select("id", F.col("doc_id").alias("d"), F.col("part").alias("p")).hint("merge")
    found = docs.join(nodes, docs["doc_id"].eqNullSafe(nodes["d"]) & (docs["part"] == nodes["p"])).select("id", "text")
    return found.mapInArrow(sets, "id long, shingles binary")


def verified(pairs: DataFrame, full: DataFrame, similarity: int) -> DataFrame:
    """The pairs whose full sets have ``100 * intersection >= similarity * union``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("xa"), batch.column("xb"), strict=True)):
                a, b = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = np.concatenate([a, b])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                good[i] = 100 * common >= similarity * (len(a) + len(b) - common)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return staged(
        pairs.join(full.select(F.col("id").alias("b"), F.col("shingles").alias("xb")), "b")
        .join(full.select(F.col("id").alias("a"), F.col("shingles").alias("xa")), "a")
        .select("a", "b", "xa", "xb")
        .mapInArrow(compare, "a long, b long")
    )


def common_counts(first: list[np.ndarray], second: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each of the first with each of the second sets."""
    values = np.concatenate([*first, *second])
    row = np.repeat(np.arange(len(first) + len(second)), [len(x) for x in (*first, *second)])
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    several = np.flatnonzero(count[column] > 1)  # a value of one set is in no intersection
    number = np.cumsum(count > 1) - 1
    row, column = row[several], number[column[several]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(first), len(second)), np.float32)
    last = int(column[-1]) + 1 if len(column) else 0
    for a in range(0, last, COLUMNS):
        lo, hi = np.searchsorted(column, [a, a + COLUMNS])
        there = np.zeros((len(first) + len(second), min(COLUMNS, last - a)), np.float32)
        there[row[lo:hi], column[lo:hi] - a] = 1
        total += there[: len(first)] @ there[len(first) :].T
    return total


def sets_of(rows: pa.Table, column: str) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), "<u8") for v in rows.column(column)]


def known_unions(first: list[np.ndarray], second: list[np.ndarray], n_first: np.ndarray, n_second: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Sizes of the unions of each of the first with each of the second sketches, up to the value to which both are complete."""
    # A sketch is complete to its last value, or throughout if it is the whole set.
    end = lambda sets, n: np.array([s[-1] if k > SKETCH else np.iinfo(np.uint64).max for s, k in zip(sets, n, strict=True)], np.uint64)
    within = lambda sets, ends: np.array([np.searchsorted(s, ends, side="right") for s in sets], np.float32).reshape(len(sets), len(ends))
    return within(first, end(second, n_second)) + within(second, end(first, n_first)).T - common


def values_of(nodes: DataFrame) -> DataFrame:
    """(id, component, value): a row for each value of the sketches of ``nodes`` (id, component, sketch)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(raw.as_buffer(), "<i8") for raw in batch.column("sketch")]
            at = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
            values = pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("component").take(at), values], ["id", "component", "value"])

    return nodes.select("id", "component", "sketch").mapInArrow(work, "id long, component long, value long")


def rare_lists(nodes: DataFrame, similarity: int) -> DataFrame:
    """(hub, id, n, component, sketch, before): each of ``nodes`` (id, n, component, sketch) once for each of its rarest values; hub is negative.

    Candidates have at least ``least`` values of either sketch in common: a share of the smallest of the union, or, of sets so small that all
    they can be linked with are whole, the similarity's share of the set. In one order of all values, by how many nodes have
    them, then, the first ``held - least + 1`` of both have one in common. Values of a single component join no two: they come first and are in no list; a node with
    fewer than ``least`` others has no candidate. ``before`` are the node's values ahead of the list's: two nodes that share
    one of these meet in another list. Lists of one component are left out.
    """
    share = least_common(similarity) / SKETCH
    held = staged(values_of(nodes))
    spread = (F.count("*").alias("nodes"), F.min("component").alias("x"), F.max("component").alias("y"))
    several = staged(held.groupBy("value").agg(*spread).where("x < y").select("value", "nodes"))
    # The nodes' own columns come with their number; values of a node are SKETCH at most.
    ranked = held.select("id", "value").join(several, "value").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("nodes", "value")))["value"].alias("values"))
    ranked = ranked.join(nodes.select("id", "n", "component"), "id")
    common = F.when(F.col("n") * 100 <= similarity * SKETCH, F.col("n") * similarity / 100).otherwise(F.lit(share) * F.least("n", F.lit(SKETCH)))
    least = F.ceil(common - F.lit(1e-6)).cast("int")
    first = F.slice("values", F.lit(1), F.greatest(F.size("values") - least + 1, F.lit(0)))
    ranked = ranked.select("id", "n", "component", first.alias("values"))
    lists = ranked.select("id", "n", "component", "values", F.posexplode("values").alias("at", "value"))
    lists = staged(lists.select("id", "n", "component", "value", F.slice("values", F.lit(1), F.col("at")).alias("before")))
    spread = staged(lists.groupBy("value").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("value"))
    hub = F.col("value").bitwiseOR(F.lit(-(1 << 63)))
    return lists.join(spread, "value", "left_semi").join(nodes.select("id", "sketch"), "id").select(hub.alias("hub"), "id", "n", "component", "sketch", "before")


def candidates(open_: DataFrame, similarity: int) -> DataFrame:
    """(hub, x, y, side, id, n, component): the nodes of block x (side 0) and y (side 1) that have a candidate in the other.

    ``open_`` (hub, id, n, component, sketch) are the nodes of hubs. Those of hubs of over ``BLOCK`` nodes meet by rare values instead
    (:func:`rare_lists`); lists are dealt to blocks of about ``BLOCK`` nodes. Candidates are of different
    components, and neither their sizes nor their sketches rule a link out. Two sketches tell the union's smallest values, from
    ``SKETCH`` to twice as many: for each number of them there is a least number of common ones, with a miss under 1e-9 for all
    numbers together. Two whole sets tell their similarity.
    """
    # Unions of fewer values are of whole sets.
    least = np.array([0] * SKETCH + [least_common(similarity, 1e-9 / (SKETCH + 1), u) for u in range(SKETCH, 2 * SKETCH + 1)], np.float32)
    large = staged(open_.groupBy("hub").agg(F.count("*").alias("nodes")).where(F.col("nodes") > BLOCK).select("hub"))
    if not large.isEmpty():
        nodes = staged(open_.join(large, "hub", "left_semi").select("id", "n", "component", "sketch").dropDuplicates(["id"]))
        open_ = staged(open_.join(large, "hub", "left_anti").withColumn("before", F.array().cast("array<long>")).unionByName(rare_lists(nodes, similarity)))
    else:
        open_ = open_.withColumn("before", F.array().cast("array<long>"))
    blocks = staged(open_.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    dealt = open_.join(blocks, "hub").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("hub", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "id", "n", "component", "sketch", "before")

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        hub, x, y = (k.as_py() for k in key)
        ids, comp, mine, n = (rows.column(c).to_numpy() for c in ("id", "component", "mine", "n"))
        sets = sets_of(rows, "sketch")
        p, q = np.flatnonzero(mine == x), np.flatnonzero(mine == y)
        common = common_counts([sets[i] for i in p], [sets[i] for i in q])
        union = known_unions([sets[i] for i in p], [sets[i] for i in q], n[p], n[q], common)
        whole = (n[p][:, None] <= SKETCH) & (n[q] <= SKETCH)
        good = np.where(whole, 100 * common >= similarity * union, common >= least[union.astype(np.int32)])
        good &= 100 * np.minimum(n[p][:, None], n[q]) >= similarity * np.maximum(n[p][:, None], n[q])
        good &= comp[p][:, None] != comp[q]
        if hub < 0:
            earlier = [v.values.to_numpy() for v in rows.column("before")]
            good &= common_counts([earlier[i] for i in p], [earlier[i] for i in q]) == 0
        sides = [(0, p[good.any(1)]), (1, q[good.any(0)])]
        at = np.concatenate([i for _, i in sides])
        side = np.repeat([s for s, _ in sides], [len(i) for _, i in sides])
        all_of = lambda v: pa.array(np.full(len(at), v))
        return pa.table(
            {"hub": all_of(hub), "x": pa.array(np.full(len(at), x, np.int32)), "y": pa.array(np.full(len(at), y, np.int32)), "side": pa.array(side.astype(np.int32)), "id": ids[at], "n": n[at], "component": comp[at]}
        )

    return staged(dealt.groupBy("hub", "x", "y").applyInArrow(compare, "hub long, x int, y int, side int, id long, n long, component long"))


def joined_labels(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (least label, label) that join the same labels as the pairs (x, y): one for each label but the least of those joined."""
    labels, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = at[: len(x)], at[len(x) :]
    least = np.arange(len(labels))
    while len(a):
        both = np.minimum(least[a], least[b])
        before = least.copy()
        np.minimum.at(least, a, both)
        np.minimum.at(least, b, both)
        least = least[least]
        if np.array_equal(least, before):
            break
    moved = np.flatnonzero(least != np.arange(len(labels)))
    return labels[least[moved]], labels[moved]


def links_across(open_: DataFrame, full: DataFrame, similarity: int) -> DataFrame:
    """Links (a, b) between components, from ``open_`` (hub, id, n, component, sketch): a task gives as few as join what its nodes' links join."""
    found = candidates(open_, similarity)
    place = ["hub", "x", "y"]
    # Both sides in parts of about SHINGLES shingles; each two parts meet.
    parts = lambda side: F.ceil(F.sum(F.when(F.col("side") == side, F.col("n"))) / SHINGLES).cast("int")
    sizes = staged(found.groupBy(*place).agg(parts(0).alias("p"), parts(1).alias("q")))
    dealt = found.join(sizes, place)
    first = F.col("side") == 0
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("id"), F.when(first, F.col("p")).otherwise(F.col("q"))).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(first, F.col("q")).otherwise(F.col("p")) - 1)))
    dealt = dealt.select(*place, "side", F.when(first, F.col("mine")).otherwise(F.col("other")).alias("i"), F.when(first, F.col("other")).otherwise(F.col("mine")).alias("j"), "id", "component")

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        comp, side = (rows.column(c).to_numpy() for c in ("component", "side"))
        sets = sets_of(rows, "shingles")
        n = np.array([len(v) for v in sets], np.float64)
        p, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        common = common_counts([sets[i] for i in p], [sets[i] for i in q]).astype(np.float64)
        good = 100 * common >= similarity * (n[p][:, None] + n[q] - common)
        good &= comp[p][:, None] != comp[q]
        i, j = np.nonzero(good)
        a, b = joined_labels(comp[p[i]], comp[q[j]])
        return pa.table({"a": a, "b": b})

    return staged(dealt.join(full, "id").groupBy(*place, "i", "j").applyInArrow(compare, "a long, b long"))


def components(links: DataFrame) -> DataFrame:
    """(id, component) of all ids in ``links`` (a, b); component is the smallest id that can be reached.

    Each step takes the smallest component among neighbours, then that component's own: the
    number of steps grows with the logarithm of the longest path in practice.
    """
    spark = links.sparkSession
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
    before = shared_dir(spark)
    labels = staged(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), before)
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        best = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("best"))
        jump = labels.select(F.col("id").alias("best"), F.col("component").alias("next"))
        at = shared_dir(spark)
        stepped = staged(
            best.join(jump, "best").select("id", F.least("best", "next").alias("component"), (F.col("component") != F.least("best", "next")).alias("changed")), at
        )
        discard(spark, before)
        changed, before = not stepped.where("changed").isEmpty(), at
        labels = stepped.select("id", "component")
        if not changed:
            return labels


def marked(docs: DataFrame, similarity: int, width: int) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, part, text): doc_id, part, n_shingles, component_id, and whether it ``stays``.

    A node is a set of shingles and has a number of its own; doc_ids only name components in the end.
    """
    if not LEAST_SIMILARITY <= similarity <= 100:
        raise ValueError(f"a similarity from {LEAST_SIMILARITY} to 100 is needed, not {similarity}")
    spark = docs.sparkSession
    rows = staged(sketches(docs, width))
    # Equal sets are one node, told by the smallest id (null last) that has it.
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "part", F.col("n_shingles").alias("n"), "sketch")).alias("one")
    nodes = staged(
        rows.where("n_shingles > 0").groupBy("name").agg(one, F.count("*").alias("size")).select(F.monotonically_increasing_id().alias("id"), "name", "size", "one.*")
    )
    lists = inverted(nodes)
    # Written tables, so that both sides of a join are plain shuffles and Spark can split a hot value.
    hubs = staged(lists.groupBy("value").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").select("value", "hub"))
    # Which nodes share a list with which hub; most share many lists with one.
    members = staged(lists.join(hubs, "value").select("hub", "id", "n").distinct())
    sizes = nodes.select(F.col("id").alias("hub"), F.col("n").alias("m"))
    close = 100 * F.least("n", "m") >= similarity * F.greatest("n", "m")
    pairs = members.where("hub < id").join(sizes, "hub").where(close).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    at = shared_dir(spark)
    full = staged(full_sets(docs, nodes.join(members.select("id").distinct(), "id", "left_semi"), width), at)
    comp = components(verified(staged(estimated(pairs, nodes, similarity)), full, similarity))
    open_ = members.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    spread = open_.groupBy("hub").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("hub")
    open_ = staged(open_.join(staged(spread), "hub", "left_semi").join(nodes.select("id", "sketch"), "id"))
    new = links_across(open_, full, similarity)
    discard(spark, at)
    if not new.isEmpty():
        joined = components(new.distinct())
        ids = comp.union(joined.select("id", F.col("id").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
        up = joined.select(F.col("id").alias("component"), F.col("component").alias("top"))
        comp = staged(ids.join(up, "component", "left").select("id", F.coalesce("top", "component").alias("component")))
    # Back to documents: nodes with copies or links, and what their components are called.
    linked = nodes.drop("sketch").join(comp, "id", "left").where("size > 1 or component is not null").withColumn("component", F.coalesce("component", "id"))
    linked = staged(linked)
    top = linked.groupBy("component").agg(F.min(F.struct("none", "doc_id", "name", "part")).alias("top"))
    found = (
        linked.join(top, "component")
        .select("name", F.col("top.doc_id").alias("found"), F.struct("top.doc_id", "top.name", "top.part").alias("top"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    # A node is at every salt, so that any salt does for its rows: copies are spread whatever their ids.
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    out = rows.select("doc_id", "part", "n_shingles", "name", salt.alias("salt")).join(found, ["name", "salt"], "left")
    alone = F.col("top").isNull()
    return out.select(
        "doc_id",
        "part",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("found")).alias("component_id"),
        (alone | F.struct("doc_id", "name", "part").eqNullSafe(F.col("top"))).alias("stays"),
    )


def with_part(docs: DataFrame) -> DataFrame:
    """(doc_id, part, text): part tells rows of one doc_id apart by their text; null text is empty."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("part"), text.alias("text"))


def mark_near_copies(docs: DataFrame, similarity: int = 85, width: int = 5) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked if ``100 * intersection >= similarity * union`` of their shingle sets; a similarity under
    ``LEAST_SIMILARITY`` is an error. component_id is the smallest doc_id that links lead to, null if no row they lead to has one; kept is whether it
    is the row's own (null included). Texts without words (or null) have no shingles and no links. Rows with one
    doc_id and different texts are documents of their own. No documents give no rows; other columns are ignored.
    """
    component = marked(with_part(docs), similarity, width)
    return component.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, similarity: int = 85, width: int = 5) -> DataFrame:
    """``docs`` without near copies: of each component the document with the smallest id (null last, then any one text), all columns.

    Documents without words all stay. Rows that are equal in id and text are one document: they stay or go together.
    """
    gone = marked(with_part(docs), similarity, width).where(~F.col("stays")).select(F.col("doc_id").alias("__id"), F.col("part").alias("__part")).distinct()
    part = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["__id"]) & (part == gone["__part"]), "left_anti")
