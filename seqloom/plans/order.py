"""Sequences and what depends on their order, planned in blocks.

A sequence is a DataFrame whose column `_idx` numbers its rows 0, 1, 2, ... in order.  A window over
all of it would run in one task.  Here rows are dealt to blocks of consecutive positions; windows run
within blocks, and only one summary row a block (n / BLOCK rows) is ordered in a single task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.monoids import Monoid
from .stored import stored

IDX = "_idx"
#: Rows of a block.
BLOCK = 1 << 16

_blk, _pid, _at = "__blk", "__pid", "__at"


def columns(df: DataFrame) -> list[str]:
    """The value columns of a sequence."""
    return [c for c in df.columns if c != IDX]


def named_order(order: str | list[str] | tuple[str, ...]) -> list[tuple[str, bool]]:
    """An order by columns: names, with a leading "-" where it falls.  (name, falls) of each."""
    return [(o.lstrip("-"), o.startswith("-")) for o in ([order] if isinstance(order, str) else order)]


def sort_columns(order) -> list[Column]:
    return [F.desc(c) if falls else F.asc(c) for c, falls in named_order(order)]


def comes_before(order, a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Whether row a stands strictly before row b; a(name) and b(name) are their columns.  Nulls come first where the order rises."""
    less, tied = F.lit(False), F.lit(True)
    for c, falls in named_order(order):
        x, y = (b(c), a(c)) if falls else (a(c), b(c))
        below = F.coalesce(x < y, x.isNull() & y.isNotNull())
        less, tied = less | (tied & below), tied & x.eqNullSafe(y)
    return less


def at_position(df: DataFrame, column: str) -> DataFrame:
    """A sequence from a table one of whose columns already holds the positions 0, 1, 2, ..."""
    return df.select(F.col(column).cast("long").alias(IDX), *df.columns)


def with_index(df: DataFrame, *order: Column | str) -> DataFrame:
    """A sequence of the rows in the given (total) order: a range sort, then partition offsets.

    The sorted rows are stored once, since a range partitioning isn't the same in every run.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(_at, F.monotonically_increasing_id())
    rows = stored(placed, "indexed").withColumn(_pid, F.shiftright(_at, 33))
    # one row a partition
    counts = rows.groupBy(_pid).agg(F.count("*").alias("__n"))
    ahead = counts.select(_pid, (F.sum("__n").over(Window.orderBy(_pid)) - F.col("__n")).alias("__ahead"))
    place = F.col("__ahead") + F.col(_at).bitwiseAND((1 << 33) - 1)
    return rows.join(F.broadcast(ahead), _pid).select(place.alias(IDX), *df.columns)


def reindex(df: DataFrame, block: int = 0) -> DataFrame:
    """The same rows in the order of `_idx`, numbered without gaps."""
    block = block or BLOCK
    at = df.withColumn(_blk, F.floor(F.col(IDX) / block))
    counts = at.groupBy(_blk).agg(F.count("*").alias("__n"))
    ahead = counts.select(_blk, (F.sum("__n").over(Window.orderBy(_blk)) - F.col("__n")).alias("__ahead"))
    place = F.row_number().over(Window.partitionBy(_blk).orderBy(IDX)) - 1
    return at.withColumn("__place", place).join(ahead, _blk).select((F.col("__ahead") + F.col("__place")).alias(IDX), *columns(df))


def with_previous(df: DataFrame, named: dict[str, Column | str], block: int = 0) -> DataFrame:
    """Adds, under each name, the expression's value in the row before; null in the first row."""
    block = block or BLOCK
    exprs = {n: F.expr(e) if isinstance(e, str) else e for n, e in named.items()}
    at = df.withColumn(_blk, F.floor(F.col(IDX) / block))
    # the last row of each block, one a block
    last = df.filter(F.col(IDX) % block == block - 1).select((F.floor(F.col(IDX) / block) + 1).alias(_blk), *[e.alias(f"__edge_{n}") for n, e in exprs.items()])
    w = Window.partitionBy(_blk).orderBy(IDX)
    inner = at.select("*", *[F.lag(e).over(w).alias(f"__prev_{n}") for n, e in exprs.items()])
    first = F.col(IDX) % block == 0
    return inner.join(last, _blk, "left").select(IDX, *columns(df), *[F.when(first, F.col(f"__edge_{n}")).otherwise(F.col(f"__prev_{n}")).alias(n) for n in exprs])


def scan(df: DataFrame, out: str, value: Column, op: Monoid, inclusive: bool = True, init=None, block: int = 0) -> DataFrame:
    """Adds the running combination of `value`; exclusive scans start from init (or the identity)."""
    block = block or BLOCK
    at = df.withColumn("__v", value).withColumn(_blk, F.floor(F.col(IDX) / block))
    w = Window.partitionBy(_blk).orderBy(IDX)
    upto = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    inner = at.withColumn("__own", op.over(F.col("__v"), upto))
    totals = at.groupBy(_blk).agg(op.agg(F.col("__v")).alias("__t"))
    before = Window.orderBy(_blk).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(_blk, op.over(F.col("__t"), before).alias("__carry"))
    start = None if init is None or inclusive else F.lit(init)
    result = op.join(start, F.col("__carry"), F.col("__own"))
    return inner.join(carry, _blk).select(IDX, *columns(df), result.alias(out))


def scan_by_run(df: DataFrame, out: str, head: Column, value: Column, op: Monoid, inclusive: bool = True, init=None, block: int = 0) -> DataFrame:
    """As scan, starting anew in every row where `head` holds.

    A run may span any number of blocks, so a run as long as the table is still shared out: a block's
    rows before its first head continue with what the blocks before it carry over.
    """
    block = block or BLOCK
    at = df.withColumn("__v", value).withColumn("__h", F.when(head, 1).otherwise(0)).withColumn(_blk, F.floor(F.col(IDX) / block))
    at = at.withColumn("__run", F.sum("__h").over(Window.partitionBy(_blk).orderBy(IDX).rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy(_blk, "__run").orderBy(IDX).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    inner = at.withColumn("__own", op.over(F.col("__v"), own))
    # of each block: whether a run starts in it, and the total of its last run
    runs = at.groupBy(_blk, "__run").agg(op.agg(F.col("__v")).alias("__t"))
    tails = runs.groupBy(_blk).agg(F.max("__run").alias("__heads"), F.max_by("__t", "__run").alias("__t"))
    reset = F.sum(F.when(F.col("__heads") > 0, 1).otherwise(0)).over(Window.orderBy(_blk).rowsBetween(Window.unboundedPreceding, 0))
    grouped = tails.withColumn("__reset", reset)
    total = op.over(F.col("__t"), Window.partitionBy("__reset").orderBy(_blk).rowsBetween(Window.unboundedPreceding, 0))
    carry = grouped.withColumn("__total", total).select((F.col(_blk) + 1).alias(_blk), F.col("__total").alias("__carry"))
    carried = F.when(F.col("__run") == 0, F.col("__carry"))
    start = None if init is None or inclusive else F.lit(init)
    result = op.join(start, carried, F.col("__own"))
    return inner.join(carry, _blk, "left").select(IDX, *columns(df), result.alias(out))
