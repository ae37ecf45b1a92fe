"""Selections and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.order import IDX, columns, reindex


def copy_where(df: DataFrame, stencil: Column) -> DataFrame:
    """The rows where the stencil holds, in order."""
    return reindex(df.filter(stencil))


def remove_where(df: DataFrame, stencil: Column) -> DataFrame:
    """The rows where it doesn't."""
    return reindex(df.filter(~stencil))


def partition(df: DataFrame, stencil: Column) -> DataFrame:
    """Rows that pass, then those that fail, each in order; `_boundary` is the number that pass."""
    marked = df.withColumn("__pass", stencil)
    passed, failed = reindex(marked.filter("__pass")), reindex(marked.filter("not __pass"))
    n = marked.agg(F.count_if("__pass").alias("_boundary"))
    first = passed.join(F.broadcast(n)).select(IDX, *columns(df), "_boundary")
    rest = failed.join(F.broadcast(n)).select((F.col(IDX) + F.col("_boundary")).alias(IDX), *columns(df), "_boundary")
    return first.unionByName(rest)


def count_if(df: DataFrame, predicate: Column) -> DataFrame:
    return df.agg(F.count_if(predicate).alias("count"))


def all_of(df: DataFrame, predicate: Column) -> DataFrame:
    return df.agg(F.coalesce(F.bool_and(predicate), F.lit(True)).alias("all_of"))


def any_of(df: DataFrame, predicate: Column) -> DataFrame:
    return df.agg(F.coalesce(F.bool_or(predicate), F.lit(False)).alias("any_of"))


def none_of(df: DataFrame, predicate: Column) -> DataFrame:
    return df.agg((~F.coalesce(F.bool_or(predicate), F.lit(False))).alias("none_of"))


def find_if(df: DataFrame, predicate: Column) -> DataFrame:
    """The first position that passes, or null."""
    return df.agg(F.min(F.when(predicate, F.col(IDX))).alias("index"))


def is_partitioned(df: DataFrame, predicate: Column) -> DataFrame:
    """Whether no row passes after one that fails."""
    last, first = F.max(F.when(predicate, F.col(IDX))), F.min(F.when(~predicate, F.col(IDX)))
    return df.agg(F.coalesce(last < first, F.lit(True)).alias("is_partitioned"))
