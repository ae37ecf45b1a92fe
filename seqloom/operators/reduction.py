"""Operations that end in one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.monoids import Monoid
from ..plans.order import BLOCK, IDX, columns, comes_before, named_order, with_previous

Op = Callable[[Column, Column], Column]


def reduce(df: DataFrame, value: Column, op: Monoid, init=None, name: str = "reduced") -> DataFrame:
    """init combined with all values; of an empty sequence, init."""
    total = op.agg(value)
    return df.agg(op.join(None if init is None else F.lit(init), total).alias(name))


def reduce_with(df: DataFrame, value: Column, op: Op, init: Column, name: str = "reduced", block: int = 4096) -> DataFrame:
    """The same with any associative operation on two columns, in order.

    Blocks of positions are folded apart and their results folded again, so no task holds more than
    a block's values and the blocks' results.
    """

    def fold(part: DataFrame, size: int) -> DataFrame:
        row = F.struct(F.col("__k"), F.col("__v"))
        values = F.transform(F.array_sort(F.collect_list(row)), lambda r: r["__v"])
        grouped = part.groupBy(F.floor(F.col("__k") / size).alias("__k")).agg(values.alias("__a"))
        return grouped.select("__k", F.aggregate(F.slice("__a", 2, F.greatest(F.size("__a") - 1, F.lit(0))), F.col("__a")[0], op).alias("__v"))

    part = df.select(F.col(IDX).alias("__k"), value.alias("__v"))
    for _ in range(3):  # block ** 3 rows
        part = fold(part, block)
    whole = F.transform(F.array_sort(F.collect_list(F.struct("__k", "__v"))), lambda r: r["__v"])
    return part.agg(F.aggregate(whole, init, op).alias(name))


def min_element(df: DataFrame, *keys: str) -> DataFrame:
    """Position of the first smallest row, or null."""
    return df.agg(F.min(F.struct(*keys, IDX))[IDX].alias("index"))


def max_element(df: DataFrame, *keys: str) -> DataFrame:
    """Position of the first largest row, or null."""
    return df.agg((-F.max(F.struct(*keys, (-F.col(IDX)).alias("__neg")))["__neg"]).alias("index"))


def minmax_element(df: DataFrame, *keys: str) -> DataFrame:
    """Positions of the last smallest and the first largest row."""
    row = F.struct(*keys, (-F.col(IDX)).alias("__neg"))
    return df.agg((-F.min(row)["__neg"]).alias("min_index"), (-F.max(row)["__neg"]).alias("max_index"))


def _pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    a = left.select(IDX, *[F.col(c).alias(f"__l_{i}") for i, c in enumerate(columns(left))], F.lit(True).alias("__l"))
    b = right.select(IDX, *[F.col(c).alias(f"__r_{i}") for i, c in enumerate(columns(right))], F.lit(True).alias("__r"))
    return a.join(b, IDX, "full")


def _same(left: DataFrame, eq: Op | None) -> Column:
    out = F.lit(True)
    for i in range(len(columns(left))):
        a, b = F.col(f"__l_{i}"), F.col(f"__r_{i}")
        out = out & (eq(a, b) if eq else a.eqNullSafe(b))
    return F.col("__l").isNotNull() & F.col("__r").isNotNull() & out


def equal(left: DataFrame, right: DataFrame, eq: Op | None = None) -> DataFrame:
    """Whether both have the same length and equal rows."""
    return _pairs(left, right).agg(F.coalesce(F.bool_and(_same(left, eq)), F.lit(True)).alias("equal"))


def mismatch(left: DataFrame, right: DataFrame, eq: Op | None = None) -> DataFrame:
    """First position that differs or that only one has; null if both are equal."""
    return _pairs(left, right).agg(F.min(F.when(~_same(left, eq), F.col(IDX))).alias("index"))


def lexicographical_compare(left: DataFrame, right: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Whether left comes strictly before right; a prefix comes before what it begins.

    Rows compare by all columns, or in the order given ("-name" falls); columns of the same place have the same name.
    """
    names = columns(left)
    order = order or names
    at = {c: i for i, c in enumerate(names)}
    before = comes_before(order, lambda c: F.col(f"__l_{at[c]}"), lambda c: F.col(f"__r_{at[c]}"))
    after = comes_before(order, lambda c: F.col(f"__r_{at[c]}"), lambda c: F.col(f"__l_{at[c]}"))
    less = F.when(F.col("__l").isNull(), True).when(F.col("__r").isNull(), False).when(before, True).when(after, False)
    return _pairs(left, right).agg(F.coalesce(F.min_by(less, F.when(less.isNotNull(), F.col(IDX))), F.lit(False)).alias("less"))


def _value(names: list[str]) -> Column:
    """One column as it is, several as a struct."""
    return F.col(names[0]) if len(names) == 1 else F.struct(*names)


def adjacent_find(df: DataFrame, eq: Op, *names: str, block: int = 0) -> DataFrame:
    """First position whose value and the next one's satisfy eq, or null; several columns reach eq as structs."""
    value = _value(list(names))
    prev = with_previous(df, {"__p": value}, block or BLOCK)
    return prev.agg(F.min(F.when((F.col(IDX) > 0) & eq(F.col("__p"), value), F.col(IDX) - 1)).alias("index"))


def _breaks(df: DataFrame, order, block: int) -> tuple[DataFrame, Column]:
    """df with each row's predecessor, and whether a row stands before it in the order."""
    order = list(order)
    prev = with_previous(df, {f"__p_{c}": F.col(c) for c, _ in named_order(order)}, block or BLOCK)
    return prev, (F.col(IDX) > 0) & comes_before(order, F.col, lambda c: F.col(f"__p_{c}"))


def is_sorted(df: DataFrame, *order: str, block: int = 0) -> DataFrame:
    """Whether no row stands before its predecessor in the order of the columns ("-name" falls)."""
    prev, broken = _breaks(df, order, block)
    return prev.agg((~F.coalesce(F.bool_or(broken), F.lit(False))).alias("is_sorted"))


def is_sorted_until(df: DataFrame, *order: str, block: int = 0) -> DataFrame:
    """First position that is less than the one before it, else the length."""
    prev, broken = _breaks(df, order, block)
    return prev.agg(F.coalesce(F.min(F.when(broken, F.col(IDX))), F.count("*")).alias("until"))
