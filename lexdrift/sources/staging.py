"""Tables that are written between the parts of a job: they cut the lineage, survive lost executors, and their size is known."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names.

    Only where a session on one machine has no such setting (tests) a local folder is set; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lexdrift-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def staged(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that are no longer read."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def freed_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that are over: it does so when the driver's garbage is collected, which may else be after the disk is full, and soon after that."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``; none where it isn't there."""
    if not exists(spark, path):
        return []
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    return [x.getPath().getName() for x in found if x.isDirectory()]


class Stages:
    """Written tables of a loop's rounds: of each name the last two are kept, as the last is made from the one before."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, list[str]] = {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        path = shared_dir(self.spark)
        out = staged(df, path)
        held = self.paths.setdefault(name, [])
        held.append(path)
        if len(held) > 2:
            discard(self.spark, held.pop(0))
        return out

    def drop(self) -> None:
        """All of them: what is to stay has been written elsewhere."""
        for held in self.paths.values():
            discard(self.spark, *held)
        self.paths.clear()


def small(df: DataFrame, most: int) -> DataFrame:
    """``df``, to be broadcast if it has at most so many rows; beyond, Spark joins it by shuffle. For written tables: they are counted."""
    return F.broadcast(df) if df.count() <= most else df
