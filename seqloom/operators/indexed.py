"""Movement by index.  A destination is a sequence; the new state is returned."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import OutputTooShortError
from ..functions.monoids import Monoid
from ..plans.order import IDX, columns, with_index
from .bykey import reduce_by_key_with


def gather(values: DataFrame, indices: DataFrame, index: str = "index") -> DataFrame:
    """values[index] for each index, in the order of the indices; indices outside values give no row."""
    at = values.withColumnRenamed(IDX, "__at")
    return indices.select(IDX, F.col(index).alias("__at")).join(at, "__at").select(IDX, *columns(values))


permute = gather


def gather_where(values: DataFrame, indices: DataFrame, stencil: Column, destination: DataFrame, index: str = "index", validate: bool = False) -> DataFrame:
    """gather where the stencil (on indices) holds; destination's own rows elsewhere.

    Indices that the stencil rejects aren't looked up.
    """
    if validate and indices.count() > destination.count():
        raise OutputTooShortError("the destination has fewer rows than there are indices")
    found = gather(values, indices.filter(stencil), index)
    found = found.select(IDX, F.lit(True).alias("__hit"), *[F.col(c).alias(f"__new_{c}") for c in columns(values)])
    return _overlay(destination, found, columns(values))


def _overlay(destination: DataFrame, found: DataFrame, names: list[str]) -> DataFrame:
    new = {c: F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) for c in names}
    return destination.join(found, IDX, "left").select(IDX, *[new.get(c, F.col(c)) for c in columns(destination)])


def scatter(values: DataFrame, destination: DataFrame, index: str = "index") -> DataFrame:
    """destination with each row of values at its index; of several for one place the last stays."""
    names = [c for c in columns(values) if c != index]
    last = values.groupBy(F.col(index).alias(IDX)).agg(F.max_by(F.struct(*names), F.col(IDX)).alias("__row"))
    found = last.select(IDX, F.lit(True).alias("__hit"), *[F.col("__row")[c].alias(f"__new_{c}") for c in names])
    return _overlay(destination, found, names)


def scatter_where(values: DataFrame, stencil: Column, destination: DataFrame, index: str = "index") -> DataFrame:
    """scatter of the rows where the stencil (on values) holds."""
    return scatter(values.filter(stencil), destination, index)


def scatter_reduce(values: DataFrame, destination: DataFrame, value: str, op: Monoid, index: str = "index") -> DataFrame:
    """destination's value combined with all values for its place; other places stay as they are."""
    total = values.groupBy(F.col(index).alias(IDX)).agg(op.agg(F.col(value)).alias("__t"))
    joined = destination.join(total, IDX, "left")
    new = F.when(F.col("__t").isNull(), F.col(value)).otherwise(op.both(F.col(value), F.col("__t"))).alias(value)
    return joined.select(IDX, *[new if c == value else F.col(c) for c in columns(destination)])


def scatter_reduce_with(values: DataFrame, destination: DataFrame, value: str, op: Callable[[Column, Column], Column], index: str = "index") -> DataFrame:
    """scatter_reduce with any associative operation: the destination's value, then those for its place in order."""
    placed = with_index(values.select(F.col(index).alias("__to"), F.col(IDX).alias("__from"), F.col(value).alias("__v")), "__to", "__from")
    total = reduce_by_key_with(placed, ["__to"], F.col("__v"), op, name="__t").select(F.col("__to").alias(IDX), "__t")
    new = F.when(F.col("__t").isNull(), F.col(value)).otherwise(op(F.col(value), F.col("__t"))).alias(value)
    return destination.join(total, IDX, "left").select(IDX, *[new if c == value else F.col(c) for c in columns(destination)])
