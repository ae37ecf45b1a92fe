"""Frontier -> edges -> values -> a terminal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.monoids import Monoid
from ..plans.order import IDX, with_index

EDGE, SRC, DST = "edge_id", "src", "dst"


def csr(edges: DataFrame, *extra: str) -> DataFrame:
    """Edges numbered in the order of (src, dst)."""
    return with_index(edges.select(SRC, DST, *extra), SRC, DST).withColumnRenamed(IDX, EDGE)


def traverse(edges: DataFrame, frontier: DataFrame, max_edges: int | None = None) -> DataFrame:
    """All outgoing edges of a frontier (_idx, v): one row an edge and occurrence of its source.

    Columns: f_idx (place in the frontier), then those of edges.  The order is (f_idx, edge_id); with
    max_edges only the first so many in that order.
    """
    found = frontier.select(F.col(IDX).alias("f_idx"), F.col("v").alias(SRC)).join(edges, SRC).select("f_idx", *edges.columns)
    if max_edges is None:
        return found
    return with_index(found, "f_idx", EDGE).filter(F.col(IDX) < max_edges).drop(IDX)


def edge_count(edges: DataFrame, frontier: DataFrame, capacity: int | None = None) -> DataFrame:
    """One row: the edges of a whole traversal, and whether they fit the capacity."""
    n = traverse(edges, frontier).agg(F.count("*").alias("edges"))
    return n.select("edges", (F.col("edges") <= capacity if capacity is not None else F.lit(True)).alias("fits"))


def source(traversal: DataFrame, vertices: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """A column of each edge's source vertex."""
    return traversal.join(vertices.select(F.col("id").alias(SRC), F.col(column).alias(name or f"source_{column}")), SRC)


def destination(traversal: DataFrame, vertices: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """A column of each edge's destination vertex."""
    return traversal.join(vertices.select(F.col("id").alias(DST), F.col(column).alias(name or f"destination_{column}")), DST)


def edge(traversal: DataFrame, values: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """A column of a sequence whose places are edge numbers, beside each edge."""
    return traversal.join(values.select(F.col(IDX).alias(EDGE), F.col(column).alias(name or f"edge_{column}")), EDGE)


def emit(traversal: DataFrame, **named: Column) -> DataFrame:
    """One row an edge, in order."""
    return with_index(traversal.select("f_idx", EDGE, *[e.alias(n) for n, e in named.items()]), "f_idx", EDGE).select(IDX, *named)


def reduce_by_source(traversal: DataFrame, frontier: DataFrame, value: Column, op: Monoid, init, name: str = "reduced") -> DataFrame:
    """One row for each place in the frontier; without edges, init (the identity of op)."""
    found = traversal.groupBy("f_idx").agg(op.agg(value).alias("__t"))
    return frontier.join(found, frontier[IDX] == found["f_idx"], "left").select(IDX, "v", op.join(F.lit(init), F.col("__t")).alias(name))


def reduce_by_destination(traversal: DataFrame, vertices: DataFrame, value: Column, op: Monoid, init, name: str = "reduced") -> DataFrame:
    """One row a vertex; untouched ones have init (the identity of op)."""
    found = traversal.groupBy(F.col(DST).alias("id")).agg(op.agg(value).alias("__t"))
    return vertices.select("id").join(found, "id", "left").select("id", op.join(F.lit(init), F.col("__t")).alias(name))


def update_by_destination(traversal: DataFrame, vertices: DataFrame, value: Column, op: Monoid, state: str) -> DataFrame:
    """vertices with their state combined with what reaches them."""
    found = traversal.groupBy(F.col(DST).alias("id")).agg(op.agg(value).alias("__t"))
    new = F.when(F.col("__t").isNull(), F.col(state)).otherwise(op.both(F.col(state), F.col("__t"))).alias(state)
    return vertices.join(found, "id", "left").select(*[new if c == state else c for c in vertices.columns])


def relax_min_by_destination(traversal: DataFrame, vertices: DataFrame, value: Column, state: str) -> tuple[DataFrame, DataFrame]:
    """New states, the least of old and proposed; and the ids whose state fell."""
    found = traversal.groupBy(F.col(DST).alias("id")).agg(F.min(value).alias("__t"))
    joined = vertices.join(found, "id", "left").withColumn("__less", F.coalesce(F.col("__t") < F.col(state), F.lit(False)))
    new = F.when(F.col("__less"), F.col("__t")).otherwise(F.col(state)).alias(state)
    return joined.select(*[new if c == state else c for c in vertices.columns], "__less"), joined.filter("__less").select("id")


def intersect_count(edges: DataFrame, pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Common destinations of each pair of vertices (_idx, a, b)."""
    one = edges.select(F.col(SRC).alias(a), F.col(DST).alias("__d"))
    two = edges.select(F.col(SRC).alias(b), F.col(DST).alias("__d"))
    found = pairs.join(one, a).join(two, [b, "__d"]).groupBy(IDX).agg(F.count("*").alias("__n"))
    return pairs.join(found, IDX, "left").select(IDX, a, b, F.coalesce("__n", F.lit(0)).alias("common"))


def degrees(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    found = edges.groupBy(F.col(SRC).alias("id")).agg(F.count("*").alias("__n"))
    return vertices.select("id").join(found, "id", "left").select("id", F.coalesce("__n", F.lit(0)).alias("degree"))


def by_rank(df: DataFrame, *order: Column) -> Column:
    """A rank over few rows; for small results only."""
    return F.row_number().over(Window.orderBy(*order)) - 1
