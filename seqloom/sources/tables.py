"""Parquet tables as DataFrames and sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from ..plans.order import at_position, with_index


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sequence(spark: SparkSession, folder: str, name: str, *order: Column | str, position: str | None = None) -> DataFrame:
    """A table in the given total order, or by a column that already holds its positions."""
    df = table(spark, folder, name)
    return at_position(df, position) if position else with_index(df, *order)


def write(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A sequence as Parquet; its positions are a column."""
    df.write.mode(mode).parquet(path)
