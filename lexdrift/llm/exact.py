"""Exact deduplication that no large group of copies can overload.

1. Copies are combined where they are read (Spark's partial aggregation) and merged by digest, salt and full content.
2. The winners of the salts, at most ``SALTS`` for each content, are combined by digest and full content.
3. Rows find their group again by digest and salt. That is exact where all contents of a digest were found equal, which step 2
   has compared; should a digest have several contents, its rows are grouped and found by their content.

Every digest is salted, by a hash of the row and its task: no key has more rows than a task's share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, staged

#: ``[\x20\x09-\x0D]``, which the normal form leaves out.
WHITE = " \t\n\x0b\x0c\r"
SALTS = 16


def normal_form(text: str | Column = "text") -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def digest_of(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def combined(rows: DataFrame) -> DataFrame:
    """(digest, content, size, most) of ``rows`` (digest, salt, content, n): most is the largest n."""
    salted = rows.groupBy("digest", "salt", "content").agg(F.count("*").alias("size"), F.max("n").alias("most"))
    return salted.repartition("digest").groupBy("digest", "content").agg(F.sum("size").alias("size"), F.max("most").alias("most"))


def found(marks: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """``marks`` (doc_id, n, salt and ``keys``) with group_size and keep_id, from ``groups`` (``keys``, size, most) of more than one row."""
    every = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keep = marks.join(every, [*keys, "salt"]).where("n = most").groupBy(*keys).agg(F.min("doc_id").alias("keep_id"))
    told = groups.join(keep, keys).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    alone = F.col("size").isNull()
    return marks.join(staged(told.select(*keys, "salt", "keep_id", "size")), [*keys, "salt"], "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(alone, F.lit(1).cast("long")).otherwise(F.col("size")).alias("group_size"),
        "sha256",
        "n",
    )


def groups_of(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs``: doc_id, keep_id, group_size, sha256 (of its normal form), n (code points of its text)."""
    rows = docs.select("doc_id", normal_form(docs["text"]).alias("content"), F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    salt = F.pmod(F.xxhash64("doc_id", "content", F.spark_partition_id()), F.lit(SALTS)).cast("int")
    rows = rows.withColumn("digest", digest_of(F.col("content"))).withColumn("salt", salt)
    groups = staged(combined(rows).select("digest", "size", "most"))
    several = staged(groups.groupBy("digest").agg(F.count("*").alias("contents")).where("contents > 1").select("digest"))
    marks = staged(rows.select("doc_id", "n", "salt", "digest", F.unhex(F.sha2("content", 256)).alias("sha256")))
    if several.isEmpty():
        return found(marks, groups.where("size > 1"), ["digest"])
    # Unequal contents of one digest: those rows alone once more, with their contents.
    crossed = staged(rows.withColumn("sha256", F.unhex(F.sha2("content", 256))).join(several, "digest", "left_semi"))
    exact = found(crossed, staged(combined(crossed).where("size > 1")), ["digest", "content"])
    rest = found(marks.join(several, "digest", "left_anti"), groups.join(several, "digest", "left_anti").where("size > 1"), ["digest"])
    return rest.unionByName(exact)


def mark_copies(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Rows are copies if their texts are equal without white space; null counts as empty. Of copies, the
    one with the most code points, then the smallest doc_id (null last) stays. Of equal rows all
    have ``kept`` true or none; their number counts in group_size. No documents give no rows; other columns are ignored.
    """
    return groups_of(docs).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha256")).alias("text_sha256")
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without copies: all columns, one row of each group; of copies with one id any one.

    Null texts and texts without anything but white space are copies of each other. Columns may be called anything; no documents give no rows.
    """
    rows = staged(groups_of(docs).where("group_size > 1"))
    own, id_, sha = free_names(docs, "key", "id", "sha")
    key = [F.col("doc_id").alias(id_), F.col("sha256").alias(sha)]
    gone = rows.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(*key).distinct()
    named = docs.withColumn(own, F.unhex(F.sha2(normal_form(docs["text"]), 256)))
    same = lambda other: named["doc_id"].eqNullSafe(other[id_]) & (named[own] == other[sha])
    held = named.join(gone.hint("merge"), same(gone), "left_anti")
    twice = staged(rows.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy(*key).count().where("count > 1"))
    if not twice.isEmpty():  # one id several times
        single = held.join(twice.hint("merge"), held["doc_id"].eqNullSafe(twice[id_]) & (held[own] == twice[sha]), "left_semi")
        others = held.join(twice.hint("merge"), held["doc_id"].eqNullSafe(twice[id_]) & (held[own] == twice[sha]), "left_anti")
        held = others.unionByName(single.dropDuplicates(["doc_id", own]))
    return held.drop(own)
