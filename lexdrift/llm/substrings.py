"""Removing long strings that repeat, by suffixes that are sorted bucket by bucket with a difference cover.

A suffix counts by its first ``LENGTH`` bytes: its window. The suffixes' buckets are keyed by content: of
all strings of ``GRAM`` bytes in a window the one with the smallest hash is its anchor, and equal windows
have equal anchors. Consecutive suffixes with one anchor travel together as a segment, so a bucket gets a
few hundred bytes for about seventy suffixes.

1. Anchors that occur once can't belong to a repeated window: their segments go no further.
2. The bytes of the other segments are cut from the texts. Where that is done, segments of equal bytes become one
   string with several members, before anything is shuffled.
3. The strings of an anchor meet in its bucket. A task takes one block of whole buckets at a time and puts their
   suffixes into lexicographic order: by the first ``PERIOD`` bytes, then by the ranks of ``DEPTH`` bytes at the positions of
   a difference cover modulo ``PERIOD``, computed beforehand for the block, then by the last ``PERIOD`` bytes.
   For any two suffixes some shift under ``PERIOD`` puts both on positions of the cover. All keys are bytes or ranks of bytes:
   windows are equal if and only if they tie to the end, and a window is repeated if its ties have more than one member.
4. The bucket of an anchor with very many segments is split by a longer prefix, the whole window: suffixes whose window's
   hash occurs once go no further, the others are dealt by it to buckets of the same sort.
5. Repeated windows go back to their documents, whose bytes under them are removed.

Hashes only deal suffixes to buckets and leave out what can't repeat; equal hashes of different bytes change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, shared_dir, staged
from .shingles import _BYTE, U, mixed, powers
from .tokens import slices

LENGTH, GRAM = 200, 64
PERIOD = 40
DEPTH = LENGTH - PERIOD
#: Bytes that are looked at or sorted at once, and bytes of text whose segments are combined before they are shuffled.
BLOCK, COMBINED = 2 << 20, 8 << 20
#: Segments of an anchor beyond which its bucket is split.
LARGE_BUCKET = 16_384
_INDEX = U((1 << 24) - 1)


@lru_cache
def cover(period: int = PERIOD) -> np.ndarray:
    """A difference cover: every difference modulo ``period`` lies between two of its members. Greedy, as small as that gives."""
    members, missing = [0, 1], set(range(2, period - 1))
    while missing:
        gain = lambda x: len({d for m in members for d in ((x - m) % period, (m - x) % period)} & missing)
        best = max(range(period), key=lambda x: (gain(x), -x))
        missing -= {d for m in members for d in ((best - m) % period, (m - best) % period)}
        members.append(best)
    return np.array(sorted(members))


@lru_cache
def shifts(period: int = PERIOD) -> np.ndarray:
    """For residues i, j the smallest shift that puts both on the cover."""
    on = np.zeros(period, bool)
    on[cover(period)] = True
    out = np.zeros((period, period), np.int64)
    for i in range(period):
        for j in range(period):
            out[i, j] = next(d for d in range(period) if on[(i + d) % period] and on[(j + d) % period])
    return out


def prefix_sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    return sums, down


def segments_of(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Segments of all windows inside raw[begins[i]:ends[i]]: piece, start and number of its suffixes, anchor (hash), lead (of the first suffix to the anchor)."""
    none = np.zeros(0, np.int64)
    empty = {"piece": none, "start": none, "n": none, "lead": none, "anchor": none}
    if len(raw) < LENGTH:
        return empty
    sums, down = prefix_sums(raw)
    grams = mixed((sums[GRAM:] - sums[:-GRAM]) * down[: len(raw) - GRAM + 1])
    least = (grams & ~_INDEX) | np.arange(len(grams), dtype=np.uint64)
    width, size = LENGTH - GRAM + 1, 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if width > size:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    anchor = (least & _INDEX).astype(np.int64)  # of the window that begins here
    long = ends - begins >= LENGTH
    inside = np.zeros(len(anchor) + 1, np.int8)
    np.add.at(inside, begins[long], 1)
    np.add.at(inside, ends[long] - LENGTH + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1])
    first_of_piece = begins[long]
    opens[first_of_piece] = True
    (start,) = np.nonzero(opens)
    if not len(start):
        return empty
    piece = np.flatnonzero(long)[np.searchsorted(first_of_piece, start, side="right") - 1]
    stop = np.minimum(np.append(start[1:], len(anchor)), ends[piece] - LENGTH + 1)
    n, at = stop - start, anchor[start]
    return {"piece": piece, "start": start, "n": n, "lead": at - start, "anchor": grams[at].view(np.int64)}


def find_segments(docs: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, most=BLOCK):
                column = batch.column("text")
                _, offsets, data = column.buffers()
                ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
                raw = np.frombuffer(data, np.uint8, count=int(ends[-1] - ends[0]), offset=int(ends[0])) if data is not None else np.zeros(0, np.uint8)
                ends = ends - ends[0]
                # A text longer than two blocks is looked at in blocks that overlap by a window less one byte.
                chunks = [(raw, ends[:-1], ends[1:], np.arange(len(column)), 0)]
                if len(raw) > 2 * BLOCK:
                    chunks = [
                        (raw[a : a + BLOCK + LENGTH - 1], np.array([0]), np.array([min(BLOCK + LENGTH - 1, e - a)]), np.array([i]), a - s)
                        for i, (s, e) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
                        for a in range(s, max(s + 1, e - LENGTH + 1), BLOCK)
                        if e - a >= LENGTH
                    ]
                for part, b, e, rows, shift in chunks:
                    s = segments_of(part, b, e)
                    at = pa.array(rows[s["piece"]])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(at), batch.column("part").take(at), pa.array(s["start"] - b[s["piece"]] + shift), pa.array(s["n"].astype(np.int32)), pa.array(s["lead"].astype(np.int32)), pa.array(s["anchor"])],
                        ["doc_id", "part", "start", "n", "lead", "anchor"],
                    )

    return docs.mapInArrow(work, "doc_id long, part long, start long, n int, lead int, anchor long")


def refined(rank: np.ndarray, open_: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Settles ties: ``rank`` of the items ``open_`` (all that share a rank with another) grows by the number of smaller keys among its ties.

    Gives the items that still tie, in the order of their ranks.
    """
    if not len(open_):
        return open_
    group = rank[open_]
    if group.min() == group.max():
        order = np.argsort(key)
    else:
        dense = lambda x: np.unique(x, return_inverse=True)[1].astype(np.uint64)
        order = np.argsort(dense(group) << U(32) | dense(key))
    group, key, items = group[order], key[order], open_[order]
    at = np.arange(len(items))
    first = np.concatenate([[True], group[1:] != group[:-1]])
    new = first | np.concatenate([[True], key[1:] != key[:-1]])
    rank[items] = group + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(first, at, 0))
    return items[~(new & np.append(new[1:], True))]


def sample_ranks(words: np.ndarray) -> np.ndarray:
    """For each position of the cover the number of positions of the cover whose ``DEPTH`` bytes are smaller."""
    on = np.zeros(PERIOD, bool)
    on[cover()] = True
    (sample,) = np.nonzero(on[np.arange(len(words) - DEPTH) % PERIOD])
    rank, open_ = np.zeros(len(sample), np.int64), np.arange(len(sample))
    for d in range(0, PERIOD, 8):
        open_ = refined(rank, open_, words[sample[open_] + d])
    place, depth = np.zeros(len(words), np.int64), PERIOD
    while depth < DEPTH:
        place[sample] = rank + 1
        open_ = refined(rank, open_, place[sample[open_] + depth])
        depth *= 2
    place[sample] = rank + 1
    return place


def smaller_by_cover(group: np.ndarray, starts: np.ndarray, place: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """For each suffix how many of its group are smaller: by the ranks at the shift that puts both on the cover, then by the last bytes' rank.

    Suffixes are taken by their residue modulo ``PERIOD``: two residues share one shift.
    """
    dense = lambda x: np.unique(x, return_inverse=True)[1].astype(np.int64)
    residue = starts % PERIOD
    key = lambda at, d: dense(place[starts[at] + d] << 32 | tail[at])
    # Within a residue, of all residues at once.
    group = dense(group)
    inner = dense(group * PERIOD + residue) << 32
    keys = inner | key(np.arange(len(starts)), shifts()[residue, residue])
    order = np.sort(keys)
    less = np.searchsorted(order, keys) - np.searchsorted(order, inner)
    # Between residues, in groups that have several: those that share a group.
    has = np.zeros((int(group.max()) + 1, PERIOD), bool)
    has[group, residue] = True
    open_ = np.flatnonzero((has.sum(1) > 1)[group])
    by = {r: open_[residue[open_] == r] for r in np.unique(residue[open_]).tolist()}
    several = has[has.sum(1) > 1].astype(np.float32)
    for x, y in np.argwhere(np.triu(several.T @ several, 1)).tolist():
        a, b = by[x][has[group[by[x]], y]], by[y][has[group[by[y]], x]]
        both = np.concatenate([a, b])
        keys = group[both] << 32 | key(both, shifts()[x, y])
        ka, kb = keys[: len(a)], keys[len(a) :]
        for one, mine, others in ((a, ka, np.sort(kb)), (b, kb, np.sort(ka))):
            less[one] += np.searchsorted(others, mine) - np.searchsorted(others, group[one] << 32)
    return less


def window_ranks(t: np.ndarray, starts: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """For the window at each of ``starts`` in t the number of those in lower buckets, or smaller in its own: equal windows have equal ranks.

    ``bucket`` counts from 0. Only ties are looked at further, and only ties of ``PERIOD`` bytes need the cover sample.
    """
    n = np.bincount(bucket)
    rank = (np.cumsum(n) - n)[bucket]
    open_ = np.flatnonzero(n[bucket] > 1)
    reach = len(t) + DEPTH  # zeros follow, so that ranks exist up to the end
    padded = np.concatenate([t, np.zeros(DEPTH + 8, np.uint8)])
    words = np.zeros(reach, np.uint64)
    for b in range(8):
        words = (words << U(8)) | padded[b : b + reach]
    for d in range(0, PERIOD, 8):
        open_ = refined(rank, open_, words[starts[open_] + d])
    if len(open_):
        tail, ties = np.zeros(len(open_), np.int64), np.arange(len(open_))
        for d in range(LENGTH - PERIOD, LENGTH, 8):
            ties = refined(tail, ties, words[starts[open_[ties]] + d])
        refined(rank, open_, smaller_by_cover(rank[open_], starts[open_], sample_ranks(words), tail))
    return rank


def cut_strings(docs: DataFrame, segments: DataFrame) -> DataFrame:
    """(string, anchor, large, n, lead, bytes, members) from ``segments`` (doc_id, part, start, n, lead, anchor, large): one string for the
    segments of equal bytes that are cut together; ``members`` are their places (doc_id, part, start).

    Strings are numbered by task: the numbers hold once the result is written.
    """
    # a set: rows of one id and text have the same segments
    place = F.collect_set(F.struct("start", "n", "lead", "anchor", "large")).alias("found")
    found = segments.groupBy(F.col("doc_id").alias("d"), F.col("part").alias("p")).agg(place)
    texts = docs.join(found, docs["doc_id"].eqNullSafe(found["d"]) & (docs["part"] == found["p"])).select("doc_id", "part", "text", "found")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in slices(whole, most=COMBINED):
                column, found = batch.column("text"), batch.column("found")
                each = found.flatten()
                row = pc.list_parent_indices(found)
                start, n = (each.field(c).to_numpy() for c in ("start", "n"))
                raw = [x.as_buffer().to_pybytes() for x in column]
                cut = pa.array([raw[r][a:b] for r, a, b in zip(row.to_pylist(), start.tolist(), (start + n + (LENGTH - 1)).tolist(), strict=True)], pa.binary())
                coded = cut.dictionary_encode()
                code = coded.indices.to_numpy()
                order = np.argsort(code, kind="stable")
                ends = np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))
                one = pa.array(order[ends - 1])
                at = pa.array(row.to_numpy()[order])
                places = pa.StructArray.from_arrays([batch.column("doc_id").take(at), batch.column("part").take(at), pa.array(start[order])], ["doc_id", "part", "start"])
                members = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), places)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number + np.arange(len(ends))), *(each.field(c).take(one) for c in ("anchor", "large", "n", "lead")), coded.dictionary, members],
                    ["string", "anchor", "large", "n", "lead", "bytes", "members"],
                )
                number += len(ends)

    return texts.mapInArrow(work, "string long, anchor long, large boolean, n int, lead int, bytes binary, members array<struct<doc_id: long, part: long, start: long>>")


def window_keys(strings: DataFrame) -> DataFrame:
    """(string, at, key, members) for each window of ``strings`` (string, n, bytes, members); key is a hash of the window."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "bytes", BLOCK):
                raw = batch.column("bytes").to_pylist()
                sums, down = prefix_sums(np.frombuffer(b"".join(raw), np.uint8))
                n = batch.column("n").to_numpy().astype(np.int64)
                row = np.repeat(np.arange(len(n)), n)
                at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = np.cumsum([0, *map(len, raw)])[row] + at
                key = mixed((sums[start + LENGTH] - sums[start]) * down[start])
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("string").take(rows), pa.array(at), pa.array(key.view(np.int64)), batch.column("members").take(rows)], ["string", "at", "key", "members"]
                )

    return strings.select("string", "n", "bytes", "members").mapInArrow(work, "string long, at long, key long, members long")


def runs_of(mask: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of true values in one row."""
    edge = np.concatenate([[True], row[1:] != row[:-1], [True]])
    opens = mask & (edge[:-1] | np.concatenate([[True], ~mask[:-1]]))
    shuts = mask & (edge[1:] | np.concatenate([~mask[1:], [True]]))
    return np.flatnonzero(opens), np.flatnonzero(shuts)


def sort_buckets(strings: DataFrame) -> DataFrame:
    """Repeated windows (string, at, n) of ``strings`` (bucket, string, at, n, lead, members, bytes), which are sorted by bucket in their partitions.

    A string's suffixes are its first ``n``; ``members`` is how often it occurs.
    """

    def block(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.unify_dictionaries().combine_chunks()
        coded = rows.column("bytes").chunk(0)
        used, first, code = np.unique(coded.indices.to_numpy(), return_index=True, return_inverse=True)
        raw = coded.dictionary.take(pa.array(used)).to_pylist()
        bucket = np.unique(rows.column("bucket").to_numpy()[first], return_inverse=True)[1]
        n, lead = (rows.column(c).to_numpy()[first].astype(np.int64) for c in ("n", "lead"))
        # Strings are laid out with their anchors at one residue, so that equal windows need one shift.
        laid, begin, at = [], np.zeros(len(raw), np.int64), 0
        for i, (x, k) in enumerate(zip(raw, lead.tolist(), strict=True)):
            gap = -(at + k) % PERIOD
            laid += [bytes(gap), x]
            begin[i] = at + gap
            at += gap + len(x)
        of = np.repeat(np.arange(len(n)), n)
        starts = begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        rank = window_ranks(np.frombuffer(b"".join(laid), np.uint8), starts, bucket[of])
        members = np.bincount(code, weights=rows.column("members").to_numpy())
        repeated = np.bincount(rank, weights=members[of])[rank] > 1
        # The runs of a string are those of all rows with its bytes.
        a, b = runs_of(repeated, of)
        per = np.bincount(of[a], minlength=len(n))
        times = per[code]
        row = np.repeat(np.arange(len(code)), times)
        run = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + (np.cumsum(per) - per)[code[row]]
        start = rows.column("at").to_numpy()[row] + starts[a[run]] - begin[code[row]]
        return pa.RecordBatch.from_arrays([rows.column("string").combine_chunks().take(pa.array(row)), pa.array(start), pa.array(b[run] - a[run] + 1)], ["string", "at", "n"])

    def coded(rows: pa.Table) -> pa.Table:
        plain = rows.column("bytes").cast(pa.binary()).combine_chunks()
        return rows.set_column(rows.schema.get_field_index("bytes"), "bytes", plain.dictionary_encode())

    def pieces(rows: pa.Table) -> Iterator[pa.Table]:
        """Runs of whole buckets of about a block each."""
        buckets = rows.column("bucket").to_numpy()
        ends = np.cumsum(rows.column("n").to_numpy().astype(np.int64) + LENGTH)
        a = 0
        while a < len(buckets):
            b = int(np.searchsorted(ends, ends[a] + BLOCK, side="right"))
            if b < len(buckets):
                b = int(np.searchsorted(buckets, buckets[b])) if buckets[b] != buckets[a] else int(np.searchsorted(buckets, buckets[a], side="right"))
            b = max(b, a + 1)
            yield rows.slice(a, b - a)
            a = b

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Equal strings of a batch are held once, so a bucket with many members takes little room.
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            held.append(coded(pa.Table.from_batches([batch])))
            size += held[-1].nbytes
            if size >= BLOCK:
                rows = pa.concat_tables(held)
                buckets = rows.column("bucket").to_numpy()
                cut = int(np.searchsorted(buckets, buckets[-1]))  # the last bucket may go on
                if cut:
                    for part in pieces(rows.slice(0, cut)):
                        yield block(part)
                held = [coded(rows.slice(cut))]
                size = held[0].nbytes if cut else 0
        if held:
            for part in pieces(pa.concat_tables(held)):
                yield block(part)

    return strings.select("bucket", "string", "at", "n", "lead", "members", "bytes").mapInArrow(work, "string long, at long, n long")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """Runs (doc_id, part, start, n) of the starts of all windows of ``docs`` (doc_id, part, text) that occur again."""
    spark = docs.sparkSession
    at = shared_dir(spark)
    every = staged(find_segments(docs), at)
    again = every.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor", (F.col("c") > LARGE_BUCKET).alias("large"))
    strings = staged(cut_strings(docs, every.join(again, "anchor")))
    discard(spark, at)
    sized = strings.select("string", "anchor", "large", "n", "lead", "bytes", F.size("members").cast("long").alias("members"))
    rows = sized.where("not large").select(F.col("anchor").alias("bucket"), "string", F.lit(0).cast("long").alias("at"), "n", "lead", "members", "bytes")
    large = sized.where("large")
    if not large.isEmpty():
        keys = staged(window_keys(large))
        twice = keys.groupBy("key").agg(F.sum("members").alias("c")).where("c > 1").select("key")
        windows = keys.join(twice, "key", "left_semi").join(large.select("string", "lead", "bytes"), "string")
        rows = rows.unionByName(
            windows.select(
                F.col("key").alias("bucket"), "string", "at", F.lit(1).alias("n"), (F.col("lead") - F.col("at")).cast("int").alias("lead"), "members",
                F.expr(f"substring(bytes, cast(at + 1 as int), {LENGTH})").alias("bytes"),
            )
        )
    found = sort_buckets(rows.repartition("bucket").sortWithinPartitions("bucket"))
    members = strings.select("string", F.explode("members").alias("m"))
    return found.join(members, "string").select("m.doc_id", "m.part", (F.col("m.start") + F.col("at")).alias("start"), "n")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, n_bytes, spans (begin, end of each removed run of bytes), kept (the bytes that remain).

    A byte is removed if a string of ``LENGTH`` bytes over it also starts anywhere else in any row's text, its
    own included. Null text is empty; rows with null or equal ids are told apart by a hash of their text, and
    equal rows remove each other's bytes. No documents give no rows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("part", F.xxhash64("text"))
    found = repeated_windows(docs).groupBy(F.col("doc_id").alias("d"), F.col("part").alias("p")).agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    rows = docs.join(found, docs["doc_id"].eqNullSafe(found["d"]) & (docs["part"] == found["p"]), "left").select("doc_id", "text", "runs.start", "runs.n")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept = [], [], []
            for text, start, n in zip(batch.column("text"), batch.column("start"), batch.column("n"), strict=True):
                raw = text.as_buffer()
                sizes.append(raw.size)
                if not start.is_valid:
                    spans.append([])
                    kept.append(raw.to_pybytes())
                    continue
                a = start.values.to_numpy()
                b = a + n.values.to_numpy() + (LENGTH - 1)
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order])
                new = np.concatenate([[True], a[1:] > b[:-1]])
                begin, end = a[new], b[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(a) - 1]])]
                data = raw.to_pybytes()
                spans.append([{"begin": x, "end": y} for x, y in zip(begin.tolist(), end.tolist(), strict=True)])
                kept.append(b"".join(data[x:y] for x, y in zip([0, *end.tolist()], [*begin.tolist(), len(data)], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"]
            )

    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    return rows.mapInArrow(work, "doc_id long, n_bytes long, spans array<struct<begin: long, end: long>>, kept binary")
