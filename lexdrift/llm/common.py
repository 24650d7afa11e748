"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import shared_dir, staged

__all__ = ["discard", "documents", "free_names", "parts", "shared_dir", "staged", "text_bytes"]


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that are no longer read."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names`` with as many underscores before them as no column of ``df`` is called so, in whatever case."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        out.append(name)
    return out


def parts(total: float, each: float) -> int:
    return max(1, math.ceil(total / each))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
