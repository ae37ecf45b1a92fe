"""Sequences made from a rule; nothing is stored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.order import IDX


def _positions(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", IDX)


def constant(spark: SparkSession, value, n: int, name: str = "v") -> DataFrame:
    """The same value n times."""
    return _positions(spark, n).withColumn(name, F.lit(value))


full = constant


def counting(spark: SparkSession, start: int, n: int, name: str = "v") -> DataFrame:
    """start, start + 1, ..."""
    return _positions(spark, n).withColumn(name, F.col(IDX) + F.lit(start).cast("long"))


def stride(spark: SparkSession, start: int, step: int, n: int, name: str = "v") -> DataFrame:
    """start + i * step; a number outside 64 bits raises."""
    return _positions(spark, n).withColumn(name, F.lit(start).cast("long") + F.col(IDX) * F.lit(step).cast("long"))


def generated(spark: SparkSession, n: int, rule: Callable[[Column], Column], name: str = "v") -> DataFrame:
    """rule(position) at each position, such as the random numbers of functions.pcg."""
    return _positions(spark, n).withColumn(name, rule(F.col(IDX)))


def from_values(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A sequence of driver-side rows, in their order."""
    return spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"{IDX} long, {schema}")


def to_values(df: DataFrame) -> list:
    """The rows in order, on the driver."""
    rows = [tuple(r)[1:] for r in df.select(IDX, *[c for c in df.columns if c != IDX]).orderBy(IDX).collect()]
    return [r[0] for r in rows] if rows and len(rows[0]) == 1 else rows


def length(df: DataFrame) -> DataFrame:
    """One row: the number of rows, and whether there are none."""
    return df.agg(F.count("*").alias("length"), (F.count("*") == 0).alias("is_empty"))
