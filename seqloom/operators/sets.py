"""Sorted multisets.  An occurrence counts by its rank among its equals on its own side.

Both sides are sorted, so a key's rows stand together and a row's rank is its distance from the first
of them: one row a key is looked up, and a key that holds most rows isn't brought into one task.
Orders are column names, "-name" where they fall.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.order import IDX, columns, named_order, sort_columns, with_index
from ..plans.skew import join_unique


def _kept(df: DataFrame, other: DataFrame, keys: list[str], side: int, within: bool) -> DataFrame:
    """Occurrences whose rank is within the number that the other side has of them, or beyond it."""
    first = df.groupBy(*keys).agg(F.min(IDX).alias("__first"))
    each = first.join(other.groupBy(*keys).agg(F.count("*").alias("__n")), keys, "left")
    rank, n = F.col(IDX) - F.col("__first"), F.coalesce("__n", F.lit(0))
    joined = join_unique(df, keys, each)
    return joined.filter(rank < n if within else rank >= n).select(*df.columns, F.lit(side).alias("__side"))


def _keys(df: DataFrame, order: tuple[str, ...]) -> tuple[list[str], list]:
    order = order or tuple(columns(df))
    return [c for c, _ in named_order(order)], sort_columns(order)


def _ordered(rows: DataFrame, order: list, keep: list[str]) -> DataFrame:
    return with_index(rows.withColumnRenamed(IDX, "__from"), *order, "__side", "__from").select(IDX, *keep)


def set_union(left: DataFrame, right: DataFrame, *order: str) -> DataFrame:
    """Each key as often as on the side that has it more often; left's rows come first."""
    keys, by = _keys(left, order)
    extra = _kept(right, left, keys, 1, within=False)
    return _ordered(left.withColumn("__side", F.lit(0)).unionByName(extra), by, columns(left))


def set_intersection(left: DataFrame, right: DataFrame, *order: str) -> DataFrame:
    """Each key as often as on the side that has it less often; the rows are left's."""
    keys, by = _keys(left, order)
    return _ordered(_kept(left, right, keys, 0, within=True), by, columns(left))


def set_difference(left: DataFrame, right: DataFrame, *order: str) -> DataFrame:
    """Left's occurrences beyond the number that right has."""
    keys, by = _keys(left, order)
    return _ordered(_kept(left, right, keys, 0, within=False), by, columns(left))
