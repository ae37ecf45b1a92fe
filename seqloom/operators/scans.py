"""Running combinations and comparisons of neighbours."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.monoids import Monoid
from ..plans.order import IDX, columns, reindex, scan, with_previous


def inclusive_scan(df: DataFrame, value: Column, op: Monoid, name: str = "scan", block: int = 0) -> DataFrame:
    return scan(df, name, value, op, block=block)


def exclusive_scan(df: DataFrame, value: Column, op: Monoid, init, name: str = "scan", block: int = 0) -> DataFrame:
    """The combination of init and all values before the row."""
    return scan(df, name, value, op, inclusive=False, init=init, block=block)


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """The running results of an array's values."""
    first = F.slice(values, 1, 1)
    rest = F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))
    return F.aggregate(rest, first, lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x))))


def scan_with(df: DataFrame, value: Column, op: Callable[[Column, Column], Column], name: str = "scan", block: int = 256, levels: int = 4) -> DataFrame:
    """inclusive_scan with any associative operation on two columns.

    A block's values are folded to its running results in one array; the blocks' totals are scanned in
    the same way, level by level, and carried in.  Arrays hold `block` values, and the last level
    n / block ** levels.
    """

    def prefixes(part: DataFrame, level: int) -> DataFrame:
        """(k, v) in order of k, dense -> (k, v, r)."""
        grp = F.floor(F.col("k") / block) if level else F.lit(0).cast("long")
        values = F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda r: r["v"])
        blocks = part.groupBy(grp.alias("b")).agg(values.alias("vs")).select("b", running(F.col("vs"), op).alias("rs"))
        if not level:
            return blocks.select(F.posexplode("rs").alias("k", "r")).select(F.col("k").cast("long"), "r")
        totals = blocks.select(F.col("b").alias("k"), F.element_at("rs", -1).alias("v"))
        carry = prefixes(totals, level - 1).select((F.col("k") + 1).alias("b"), F.col("r").alias("c"))
        wide = blocks.join(carry, "b", "left").select("b", "c", F.posexplode("rs").alias("i", "r"))
        return wide.select((F.col("b") * block + F.col("i")).alias("k"), F.when(F.col("c").isNull(), F.col("r")).otherwise(op(F.col("c"), F.col("r"))).alias("r"))

    found = prefixes(df.select(F.col(IDX).alias("k"), value.alias("v")), levels)
    return df.join(found.select(F.col("k").alias(IDX), F.col("r").alias(name)), IDX)


def exclusive_scan_with(df: DataFrame, value: Column, op: Callable[[Column, Column], Column], init: Column, name: str = "scan", block: int = 256) -> DataFrame:
    """exclusive_scan with any associative operation: init, then op(init, what came before)."""
    got = with_previous(scan_with(df, value, op, "__scan", block), {"__before": F.col("__scan")})
    return got.select(IDX, *columns(df), F.when(F.col(IDX) == 0, init).otherwise(op(init, F.col("__before"))).alias(name))


def adjacent_difference(df: DataFrame, column: str | list[str], op: Callable[[Column, Column], Column], name: str = "difference", block: int = 0) -> DataFrame:
    """op(previous, current); the first row keeps its value.  Several columns reach op as structs."""
    value = F.col(column) if isinstance(column, str) else F.struct(*column)
    prev = with_previous(df, {"__p": value}, block)
    return prev.select(IDX, *columns(df), F.when(F.col(IDX) == 0, value).otherwise(op(F.col("__p"), value)).alias(name))


Same = Callable[[Column, Column], Column]


def heads(df: DataFrame, keys: list[str], name: str = "__head", block: int = 0, same: Same | None = None) -> DataFrame:
    """Marks rows whose keys differ from the row before's; `same` compares a row's keys with the one's before
    (a column, or a struct of several) in place of equality."""
    prev = with_previous(df, {f"__p_{k}": F.col(k) for k in keys}, block)
    if same is None:
        equal = F.lit(True)
        for k in keys:
            equal = equal & F.col(f"__p_{k}").eqNullSafe(F.col(k))
    else:
        before, now = (F.struct(*[F.col(p + k).alias(k) for k in keys]) if len(keys) > 1 else F.col(p + keys[0]) for p in ("__p_", ""))
        equal = F.coalesce(same(before, now), F.lit(False))
    return prev.select(IDX, *columns(df), ((F.col(IDX) == 0) | ~equal).alias(name))


def unique(df: DataFrame, *keys: str, block: int = 0, same: Same | None = None) -> DataFrame:
    """The first row of each run of equal keys (by default of equal rows)."""
    marked = heads(df, list(keys) or columns(df), block=block, same=same)
    return reindex(marked.filter("__head").select(IDX, *columns(df)), block)
