"""Searches in sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.monoids import add
from ..plans.order import IDX, named_order, scan, sort_columns, with_index
from ..plans.stored import stored


def _bound(source: DataFrame, queries: DataFrame, order, upper: bool, block: int) -> DataFrame:
    """Where each query's key would stand in the sorted source: a merge of both and a running count.

    Of equal keys the queries come first for the lower bound, last for the upper.
    """
    keys = [c for c, _ in named_order(order)]
    tagged = source.select(*keys, F.lit(0 if upper else 1).alias("__tag"), F.lit(None).cast("long").alias("__q"), F.lit(1).alias("__one"))
    asked = queries.select(*keys, F.lit(1 if upper else 0).alias("__tag"), F.col(IDX).alias("__q"), F.lit(0).alias("__one"))
    both = with_index(tagged.unionByName(asked), *sort_columns(order), "__tag", "__q")
    counted = scan(both, "bound", F.col("__one"), add, block=block)
    return counted.filter(F.col("__q").isNotNull()).select(F.col("__q").alias(IDX), *keys, "bound")


def lower_bound(source: DataFrame, queries: DataFrame, order: str | list[str], block: int = 0) -> DataFrame:
    """First position of the source, sorted by these columns ("-name" falls), whose key doesn't stand before the query's."""
    return _bound(source, queries, order, False, block)


def upper_bound(source: DataFrame, queries: DataFrame, order: str | list[str], block: int = 0) -> DataFrame:
    """First position whose key stands after the query's."""
    return _bound(source, queries, order, True, block)


def find_first_of(source: DataFrame, needles: DataFrame, key: str | list[str], same: Callable[[Column, Column], Column] | None = None, at_once: int = 100_000) -> DataFrame:
    """First position of source that equals any needle, or null.

    Equality is a semi join.  Another test is asked once for each two different keys, in one job: of the
    source each key's first position counts, and the different needles go in arrays of about `at_once`,
    each beside every key of the source.  Several columns reach the test as structs.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if same is None:
        hit = source.join(needles.select(*keys).distinct(), keys, "left_semi")
        return hit.agg(F.min(IDX).alias("index"))
    value = F.col(keys[0]) if len(keys) == 1 else F.struct(*keys)
    first = source.groupBy(*keys).agg(F.min(IDX).alias(IDX))
    each = stored(needles.select(*keys).distinct(), "needles")
    groups = -(-each.count() // at_once) or 1
    # dealt by hash; a group holds `at_once` needles on average
    packed = each.groupBy(F.pmod(F.xxhash64(*keys), F.lit(groups)).alias("__g")).agg(F.collect_list(F.struct(*keys)).alias("__needles"))
    test = F.exists("__needles", lambda n: same(value, n[keys[0]] if len(keys) == 1 else F.struct(*[n[k] for k in keys])))
    # not a filter: as the join's condition it would be moved to where only one side is known
    return first.crossJoin(packed).agg(F.min(F.when(test, F.col(IDX))).alias("index"))
