"""A training corpus from ``documents``: language, exact and near copies, source weights, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as
the next one's docs. All but the last return the columns of ``documents``, and any others that docs have.

Null and empty texts have no letters and go in the first stage; without documents every stage gives none. Null ids
and sources stay: rows without an id, or with one id and different texts, are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexdrift.llm import exact, langid, mixing, near, packing
from lexdrift.llm.common import documents, staged


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with letters that the network doesn't take for background; all with letters if no language was learnt."""
    return langid.drop_unknown(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of copies: the one with the most code points, then the smallest id (null last)."""
    return exact.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near copies: five words a shingle, a similarity of 0.8."""
    return near.drop_near_copies(docs, similarity=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target asks for: not at all, once or twice."""
    return mixing.repeat(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 ids; a document that was taken twice is packed twice."""
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mixture", mixture),
    ("packed", packed),
]

#: The language model can't be said in SQL; tests hold each stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
