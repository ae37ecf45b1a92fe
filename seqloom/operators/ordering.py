"""Sorts and merges.  Both are stable; positions come from a range sort (plans.order.with_index)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.monoids import total_order
from ..plans.order import IDX, columns, with_index


def _rows_in(df: DataFrame, keep: list[str], *order: Column) -> DataFrame:
    return with_index(df.withColumnRenamed(IDX, "__from"), *order).select(IDX, *keep)


def sort(df: DataFrame, *order: Column) -> DataFrame:
    """Rows in the given order; equal ones as they stood."""
    return _rows_in(df, columns(df), *order, F.col("__from"))


def sort_by_key(df: DataFrame, *order: Column, keys: list[str]) -> DataFrame:
    """Rows in the order of their keys, without the keys."""
    return _rows_in(df, [c for c in columns(df) if c not in keys], *order, F.col("__from"))


def radix_sort_by_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Ascending by the keys in turn, floats in total order, without the keys."""
    kinds = dict(df.dtypes)
    order = [c for k in keys for c in total_order(k, kinds[k])]
    return sort_by_key(df, *order, keys=keys)


def merge(left: DataFrame, right: DataFrame, *order: Column) -> DataFrame:
    """Two sorted sequences as one; of equal rows the left ones come first."""
    both = left.withColumn("__side", F.lit(0)).unionByName(right.withColumn("__side", F.lit(1)))
    return _rows_in(both, columns(left), *order, F.col("__side"), F.col("__from"))


def merge_by_key(left: DataFrame, right: DataFrame, *order: Column, keys: list[str]) -> DataFrame:
    """The values of two sequences sorted by key, in the merged order of the keys."""
    return merge(left, right, *order).drop(*keys)
