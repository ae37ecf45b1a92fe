"""Operations on runs of equal adjacent keys.  A key that comes back later starts another run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.monoids import Monoid, add
from ..plans.order import IDX, columns, scan, scan_by_run, with_previous
from .scans import Same, heads, scan_with, unique


def inclusive_scan_by_key(df: DataFrame, keys: list[str], value: Column, op: Monoid, name: str = "scan", block: int = 0) -> DataFrame:
    marked = heads(df.withColumn("__val", value), keys, block=block)
    return scan_by_run(marked, name, F.col("__head"), F.col("__val"), op, block=block).select(IDX, *columns(df), name)


def exclusive_scan_by_key(df: DataFrame, keys: list[str], value: Column, op: Monoid, init, name: str = "scan", block: int = 0) -> DataFrame:
    """Each run starts from init."""
    marked = heads(df.withColumn("__val", value), keys, block=block)
    return scan_by_run(marked, name, F.col("__head"), F.col("__val"), op, inclusive=False, init=init, block=block).select(IDX, *columns(df), name)


def scan_by_key_with(df: DataFrame, keys: list[str], value: Column, op: Callable[[Column, Column], Column], name: str = "scan", block: int = 256) -> DataFrame:
    """inclusive_scan_by_key with any associative operation: values are combined together with whether
    a run starts among them, which is associative too."""
    marked = heads(df.withColumn("__val", value), keys, block=0)
    pair = F.struct(F.col("__head").alias("h"), F.col("__val").alias("v"))

    def both(a: Column, b: Column) -> Column:
        return F.struct((a["h"] | b["h"]).alias("h"), F.when(b["h"], b["v"]).otherwise(op(a["v"], b["v"])).alias("v"))

    got = scan_with(marked, pair, both, "__scan", block)
    return got.select(IDX, *columns(df), F.col("__scan")["v"].alias(name))


def exclusive_scan_by_key_with(df: DataFrame, keys: list[str], value: Column, op: Callable[[Column, Column], Column], init: Column, name: str = "scan", block: int = 256) -> DataFrame:
    """exclusive_scan_by_key with any associative operation; each run starts from init."""
    got = scan_by_key_with(df, keys, value, op, "__scan", block)
    got = with_previous(heads(got, keys), {"__before": F.col("__scan")})
    return got.select(IDX, *columns(df), F.when(F.col("__head"), init).otherwise(op(init, F.col("__before"))).alias(name))


def run_numbers(df: DataFrame, keys: list[str], name: str = "__run", block: int = 0, same: Same | None = None) -> DataFrame:
    """The number of each row's run, from 0."""
    marked = heads(df, keys, block=block, same=same)
    return scan(marked, name, F.when(F.col("__head"), 1).otherwise(0), add, block=block).select(IDX, *columns(df), (F.col(name) - 1).alias(name))


def reduce_by_key(df: DataFrame, keys: list[str], value: Column, op: Monoid, init=None, name: str = "reduced", block: int = 0, same: Same | None = None) -> DataFrame:
    """One row a run, in order: its keys (those of its first row), and init combined with its values.

    Runs are summed up in every task before they are shuffled, however long they are.
    """
    runs = run_numbers(df.withColumn("__val", value), keys, block=block, same=same)
    first = [F.col(k).alias(k) for k in keys] if same is None else []
    total = runs.groupBy(F.col("__run").alias(IDX), *first).agg(op.agg(F.col("__val")).alias("__t"), *([] if first else [F.min(F.struct(IDX, *keys)).alias("__k")]))
    named = keys if first else [F.col("__k")[k].alias(k) for k in keys]
    return total.select(IDX, *named, op.join(None if init is None else F.lit(init), F.col("__t")).alias(name))


def reduce_by_key_with(df: DataFrame, keys: list[str], value: Column, op: Callable[[Column, Column], Column], init: Column | None = None, name: str = "reduced", block: int = 256) -> DataFrame:
    """reduce_by_key with any associative operation, in order: the last of each run's running results."""
    got = run_numbers(scan_by_key_with(df, keys, value, op, "__scan", block), keys)
    total = got.groupBy(F.col("__run").alias("__at"), *keys).agg(F.max_by("__scan", IDX).alias("__t"))
    return total.select(F.col("__at").alias(IDX), *keys, (F.col("__t") if init is None else op(init, F.col("__t"))).alias(name))


def unique_by_key(df: DataFrame, keys: list[str], block: int = 0, same: Same | None = None) -> DataFrame:
    """The values of each run's first row; the keys aren't returned."""
    return unique(df, *keys, block=block, same=same).drop(*keys)
