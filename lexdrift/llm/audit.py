"""Filter interaction audit: what each filter of a cascade removes, in every order, from one pass over the texts.

1. A document becomes a mask: bit i is set if it fails filter i. Filters of one text are column expressions; a filter for
   copies fails every row whose text a smaller doc_id has, anywhere in the table.
2. Masks are counted by part: for f filters ``2 ** f`` counts a part, whatever the number of documents.
3. A subset-zeta transform turns the counts into survivors: documents that pass all of a set S of filters are those whose mask
   is a subset of the others, so f additions of half-arrays give the survivors of all ``2 ** f`` sets.
4. Step k of an order takes the set before it to the set with its filter: what it removes is the difference of the survivors of
   these two neighbouring sets. Documents with good or toxic labels are counted and transformed likewise.

Rows are met by id (labels) and by digest (copies). Digests are salted, rows without an id meet no label, so that no key has
more than a share of a task's rows. No text is shuffled.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

SPACE = "[\\x20\\x09-\\x0D]+"
SALTS = 16
#: Parts whose steps are made at once: 64 parts of five filters are 38,400 rows.
PARTS = 64
#: Filters up to which all orders are listed: 6 have 4,320 steps a part.
MOST_FILTERS = 6


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text that isn't null: under 200 words, under half of them distinct, over 2 % capitals, a symbol."""
    words = F.array_remove(F.split(text, SPACE), "")
    return {
        "A": F.size(words) < 200,
        "B": F.lit(100) * F.size(F.array_distinct(words)) < F.lit(50) * F.size(words),
        "C": F.lit(100) * F.regexp_count(text, F.lit("[A-Z]")) > F.lit(2) * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def masks(docs: DataFrame, labels: DataFrame, copies_bit: int | None = 4) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text, source): part, mask, good, toxic.

    Bits 0 and on are :func:`text_filters`, ``copies_bit`` is for texts that a smaller doc_id has. A null text is empty, a null source
    the empty part. A row without a doc_id is no copy, makes none, and has no label. Rows of one id and text aren't copies
    of each other. ``labels`` (doc_id, quality, toxic) may have several rows an id: any one with a 1 counts; nulls don't.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    mask = sum((failed.cast("int") * F.lit(1 << i) for i, failed in enumerate(text_filters(text).values())), F.lit(0))
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        F.coalesce(docs["source"], F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        mask.alias("mask"),
        F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(SALTS)).cast("int").alias("salt"),
    )
    rows = staged(rows)
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    no = F.lit(False)
    named = rows.where("doc_id is not null").join(staged(marks).hint("merge"), "doc_id", "left").withColumns({c: F.coalesce(c, no) for c in ("good", "toxic")})
    every = named.unionByName(rows.where("doc_id is null").withColumns({"good": no, "toxic": no}))
    if copies_bit is None:
        return every.select("part", "mask", "good", "toxic")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    firsts = staged(firsts.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    copy = F.coalesce(F.col("doc_id") > F.col("first"), no).cast("int") * F.lit(1 << copies_bit)
    return every.join(firsts.hint("merge"), ["digest", "salt"], "left").select("part", (F.col("mask") + copy).alias("mask"), "good", "toxic")


def mask_counts(rows: DataFrame) -> DataFrame:
    """(part, mask, n, n_good, n_toxic) of ``rows`` (part, mask, good, toxic)."""
    return rows.groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("n_good"), F.sum(F.col("toxic").cast("long")).alias("n_toxic")
    )


def zeta(counts: np.ndarray) -> np.ndarray:
    """Sums over subsets: along the last axis, entry M becomes the sum of all entries whose bits are among M's."""
    out = counts.copy()
    index = np.arange(out.shape[-1])
    bit = 1
    while bit < out.shape[-1]:
        over = index[index & bit > 0]
        out[..., over] += out[..., over ^ bit]
        bit *= 2
    return out


def steps(counts: np.ndarray, letters: str) -> dict[str, np.ndarray]:
    """Figures of every order's steps from ``counts`` (3 kinds: all, good, toxic; parts; masks): arrays of parts x (orders * filters)."""
    f = len(letters)
    full = (1 << f) - 1
    survivors = zeta(counts)[..., full ^ np.arange(full + 1)]  # by the set of filters that have been applied
    orders = np.array(list(itertools.permutations(range(f))))
    bits = 1 << orders
    after = np.cumsum(bits, axis=1)
    before, after, which = (after - bits).ravel(), after.ravel(), orders.ravel()
    gone = survivors[..., before] - survivors[..., after]
    alone = 1 << np.arange(f)
    fails = survivors[0][:, [0]] - survivors[0][:, alone]
    unique = survivors[0][:, full ^ alone] - survivors[0][:, [full]]
    # Over all orders a set of s other filters comes first s! (f - 1 - s)! times.
    shapley = np.zeros((counts.shape[1], f), np.int64)
    for i in range(f):
        for s in range(full + 1):
            if not s >> i & 1:
                size = s.bit_count()
                times = math.factorial(size) * math.factorial(f - 1 - size)
                shapley[:, i] += times * (survivors[0][:, s] - survivors[0][:, s | 1 << i])
    return {
        "kept": survivors[0][:, after],
        "removed": gone[0],
        "redundant": fails[:, which] - gone[0],
        "unique_fails": unique[:, which],
        "good_lost": gone[1],
        "toxic_lost": gone[2],
        "shapley": shapley[:, which],
    }


def interactions(counts: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """A row for each part, order of the filters ``letters`` (bit i of a mask is letter i) and step, from :func:`mask_counts`.

    part, filter_order, step (from 1), kept, removed, redundant (fails, but was removed earlier), unique_fails (fails this filter
    only), good_lost, toxic_lost, shapley (removed by the step's filter, summed over all orders). No counts give no rows.
    """
    f = len(letters)
    if not 0 < f <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters, not {f}")
    names = ["".join(p) for p in itertools.permutations(letters)]
    kinds = ("n", "n_good", "n_toxic")
    fields = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PARTS):
                batch = whole.slice(at, PARTS)
                table = np.zeros((len(kinds), batch.num_rows, 1 << f), np.int64)
                for p, held in enumerate(batch.column("held").to_pylist()):
                    for one in held:
                        table[:, p, one["mask"]] = [one[k] for k in kinds]
                figures = steps(table, letters)
                part = batch.column("part").take(pa.array(np.repeat(np.arange(batch.num_rows), len(names) * f)))
                order = pa.array(np.tile(np.repeat(np.arange(len(names), dtype=np.int32), f), batch.num_rows))
                step = np.tile(np.arange(1, f + 1, dtype=np.int32), batch.num_rows * len(names))
                yield pa.RecordBatch.from_arrays(
                    [part, pa.array(names).take(order), pa.array(step), *(pa.array(figures[c].ravel()) for c in fields)], ["part", "filter_order", "step", *fields]
                )

    held = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *kinds)).alias("held"))  # 2 ** f at most
    return held.mapInArrow(work, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in fields))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interactions of filters A to E over ``docs`` (doc_id, text, source) with ``labels`` (doc_id, quality, toxic).

    Nulls, repeated rows and several labels an id as in :func:`masks`; no documents give no rows; other columns are ignored.
    """
    return interactions(staged(mask_counts(masks(docs, labels))))
