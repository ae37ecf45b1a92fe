"""Row-wise operations: none of them shuffles but those that bring sequences together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgumentError, LengthMismatchError
from ..functions.monoids import add
from ..plans.order import IDX, columns, scan


def map_rows(df: DataFrame, **named: Column) -> DataFrame:
    """A sequence of new columns, each an expression of the row."""
    return df.select(IDX, *[e.alias(n) for n, e in named.items()])


def copy(df: DataFrame, destination: DataFrame) -> DataFrame:
    """destination with its first rows replaced by df's; columns go by place."""
    named = df.select(IDX, *columns(df)).toDF(IDX, *[f"__new_{c}" for c in columns(destination)])
    joined = destination.join(named.withColumn("__hit", F.lit(True)), IDX, "left")
    return joined.select(IDX, *[F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) for c in columns(destination)])


def fill(df: DataFrame, **values) -> DataFrame:
    """The columns named set to constants in every row."""
    return df.select(IDX, *[F.lit(values[c]).alias(c) if c in values else F.col(c) for c in columns(df)])


def replace_where(df: DataFrame, stencil: Column, **values) -> DataFrame:
    """Constants where the stencil holds."""
    return df.select(IDX, *[F.when(stencil, F.lit(values[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in columns(df)])


def transform_where(df: DataFrame, stencil: Column, **named: Column) -> DataFrame:
    """New values where the stencil holds; the old ones elsewhere."""
    return df.select(IDX, *[F.when(stencil, named[c]).otherwise(F.col(c)).alias(c) if c in named else F.col(c) for c in columns(df)])


def flat_map(df: DataFrame, count: Column, generate: Callable[[Column], Column], name: str = "v") -> DataFrame:
    """generate(i) for i below count, in the order of the rows and of i; rows with count 0 give nothing."""
    each = F.when(count > 0, F.transform(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1), generate))
    wide = df.select(IDX, F.posexplode(each).alias("__pos", name))
    # a row's results stay in its block of positions
    sizes = df.select(IDX, F.greatest(count.cast("long"), F.lit(0)).alias("__n"))
    ahead = scan(sizes, "__ahead", F.col("__n"), add, inclusive=False, init=0)
    return wide.join(ahead.select(IDX, "__ahead"), IDX).select((F.col("__ahead") + F.col("__pos")).alias(IDX), name)


def reverse(df: DataFrame) -> DataFrame:
    """The rows from last to first."""
    n = df.agg((F.max(IDX)).alias("__last"))
    return df.join(F.broadcast(n)).select((F.col("__last") - F.col(IDX)).alias(IDX), *columns(df))


def slice_rows(df: DataFrame, start: int, end: int) -> DataFrame:
    """Rows start to end (not included), numbered from 0; the range is a filter on positions."""
    return df.filter((F.col(IDX) >= start) & (F.col(IDX) < end)).select((F.col(IDX) - start).alias(IDX), *columns(df))


def zip_rows(*sequences: DataFrame, validate: bool = False) -> DataFrame:
    """Rows side by side in one flat row; columns must have different names."""
    if validate:
        sizes = {s.count() for s in sequences}
        if len(sizes) > 1:
            raise LengthMismatchError(f"sequences of {sorted(sizes)} rows can't be zipped")
    out = sequences[0]
    for s in sequences[1:]:
        out = out.join(s, IDX)
    return out


def with_table(df: DataFrame, shared: DataFrame, name: str, limit: int = 1 << 20) -> DataFrame:
    """Each row beside the whole of another sequence, as an array of its rows in order.

    The array goes to every task, so a table of more than `limit` rows is refused.
    """
    if (n := shared.limit(limit + 1).count()) > limit:
        raise InvalidArgumentError(f"a shared table of {n} rows or more; at most {limit} are sent to every task")
    row = F.struct(IDX, *columns(shared))
    whole = shared.agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: F.struct(*[r[c].alias(c) for c in columns(shared)])).alias(name))
    return df.join(F.broadcast(whole))

