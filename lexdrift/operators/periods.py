"""Time slices: years, periods, and pairs of periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 25


def year_of(date: str | Column) -> Column:
    """From a date, a timestamp or a string that begins with the year."""
    return F.substring(F.col(date).cast("string") if isinstance(date, str) else date.cast("string"), 1, 4).cast("int")


def period_of(year: Column, width: int = WIDTH) -> Column:
    start = year - F.pmod(year, F.lit(width))
    return F.concat_ws("-", start.cast("string"), (start + (width - 1)).cast("string"))


def period_start(period: str | Column) -> Column:
    return F.split(period, "-")[0].cast("int")


def with_period(df: DataFrame, date: str, width: int = WIDTH) -> DataFrame:
    return df.withColumn("period", period_of(year_of(date), width))


def period_counts(df: DataFrame, date: str, width: int = WIDTH) -> DataFrame:
    counts = with_period(df, date, width).groupBy("period").agg(F.count("*").alias("n"))
    return counts.withColumn("period_start", period_start("period"))


def consecutive(periods: DataFrame) -> DataFrame:
    """Neighbours (source, target) among the distinct ``period`` values, by their first year; periods are few."""
    order = Window.orderBy("at", "period")
    distinct = periods.select("period", period_start("period").alias("at")).distinct()
    pairs = distinct.select(F.col("period").alias("source"), F.lead("period").over(order).alias("target"))
    return pairs.where("target is not null").withColumn("label", F.concat("source", F.lit("->"), "target"))


def from_first(periods: DataFrame) -> DataFrame:
    """The first period with each later one."""
    every = Window.partitionBy()
    distinct = periods.select("period", period_start("period").alias("at")).distinct()
    first = F.min(F.struct("at", "period")).over(every)["period"]
    pairs = distinct.select(first.alias("source"), F.col("period").alias("target")).where("source != target")
    return pairs.withColumn("label", F.concat("source", F.lit("->"), "target"))
