"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, release

EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])
EDGE_DDL = "a long, b long"


class Forest:
    """Union-find over 0..n-1 whose roots are the smallest members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a batch, as few edges as join the same nodes: each to the smallest of its tree."""
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        tree = Forest(len(names))
        for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
            tree.join(x, y)
        root = np.array([tree.find(x) for x in range(len(names))], np.int64)
        own = np.nonzero(root != np.arange(len(names)))[0]
        yield pa.RecordBatch.from_arrays([pa.array(names[own]), pa.array(names[root[own]])], schema=EDGE)


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node of edges (a, b); loops are ignored.

    Each round is written to the shared folder.  Work a round is linear in the edges; the rounds grow
    with the logarithm of the longest path, not with its length.
    """
    spark = edges.sparkSession

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))), F.lit(0))).first())

    now = Stored(edges.filter("a <> b").select("a", "b").mapInArrow(spanning, EDGE_DDL).distinct(), "components")
    before, count = None, state(now.read())
    while count != before and count[0]:
        before, e = count, now.read()
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: larger neighbours of each node move to the smallest of its neighbourhood
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: smaller neighbours and the node itself move to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))))
        then = Stored(small.filter("a <> b").distinct(), "components")
        now.drop()
        now, count = then, state(then.read())
        release(spark)
    return now.read().select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.read().select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
