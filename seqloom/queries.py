"""Registered queries: every operation over whole driver tables, with the SQL that checks it.

Sequences: events by event_id; orders, customers, parts and suppliers by their keys; lineitem in a
total order.  Money is counted in cents, so sums are exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as op
from .functions import monoids as M
from .functions import pcg
from .graph import algorithms as G
from .graph import traversal as T
from .operators import segments as S
from .plans.order import IDX, at_position, with_index
from .plans.stored import stored
from .sources import generate
from .sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- sequences

E = "e AS (SELECT event_id AS _idx, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"
ORD = "o AS (SELECT o_orderkey AS _idx, o_custkey AS cust, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)"
PART = "p AS (SELECT p_partkey AS _idx, p_brand AS brand, p_size AS size, CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM part)"
LINE_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity"


def events(spark, d):
    t = table(spark, d, "events").select("event_id", "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return at_position(t, "event_id").drop("event_id")


def orders(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("cust"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return at_position(t, "o_orderkey").drop("o_orderkey")


def parts(spark, d):
    t = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.round(F.col("p_retailprice") * 100).cast("long").alias("cents"))
    return at_position(t, "p_partkey").drop("p_partkey")


def lines(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    return with_index(t, *LINE_ORDER.split(", "), "cents")


# ---------------------------------------------------------------- maps


@query("SELECT CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def reduce_revenue(spark, d):
    """map + copy_where + reduce; a reduction needs no positions, so the sequence isn't numbered."""
    t = table(spark, d, "lineitem").filter("l_discount between 0.05 and 0.07 and l_quantity < 24")
    return op.reduce(t, F.round(F.col("l_extendedprice") * 100).cast("long") * F.round(F.col("l_discount") * 100).cast("long"), M.add, name="revenue")


@query(f"WITH {E} SELECT _idx, cents * 2 + user_id AS v FROM e")
def map_rows(spark, d):
    return op.map_rows(events(spark, d), v=F.col("cents") * 2 + F.col("user_id"))


@query(f"WITH {E}, {PART} SELECT e._idx, coalesce(p.cents, e.cents) AS cents FROM e LEFT JOIN p USING (_idx)")
def copy(spark, d):
    return op.copy(parts(spark, d).select(IDX, "cents"), events(spark, d).select(IDX, "cents"))


@query(f"WITH {E} SELECT _idx, user_id, 7::BIGINT AS cents FROM e")
def fill(spark, d):
    return op.fill(events(spark, d).select(IDX, "user_id", "cents"), cents=7).withColumn("cents", F.col("cents").cast("long"))


@query(f"WITH {E} SELECT _idx, CASE WHEN event_type = 'click' THEN -1 ELSE cents END AS cents FROM e")
def replace_where(spark, d):
    return op.replace_where(events(spark, d), F.col("event_type") == "click", cents=-1).select(IDX, "cents")


@query(f"WITH {E} SELECT _idx, CASE WHEN user_id % 3 = 0 THEN cents * cents ELSE cents END AS cents FROM e")
def transform_where(spark, d):
    return op.transform_where(events(spark, d), F.col("user_id") % 3 == 0, cents=F.col("cents") * F.col("cents")).select(IDX, "cents")


@query(f"WITH {E} SELECT (SELECT max(_idx) FROM e) - _idx AS _idx, cents FROM e")
def reverse(spark, d):
    return op.reverse(events(spark, d).select(IDX, "cents"))


@query(f"WITH {E} SELECT _idx - 100 AS _idx, cents FROM e WHERE _idx >= 100 AND _idx < 900")
def slice_rows(spark, d):
    return op.slice_rows(events(spark, d).select(IDX, "cents"), 100, 900)


@query(f"WITH {E}, {ORD} SELECT e._idx, e.cents, o.cust FROM e JOIN o USING (_idx)")
def zip_rows(spark, d):
    return op.zip_rows(events(spark, d).select(IDX, "cents"), orders(spark, d).select(IDX, "cust"))


@query(
    f"""WITH {E}, x AS (SELECT _idx, cents, unnest(range(user_id % 4)) AS i FROM e)
    SELECT row_number() OVER (ORDER BY _idx, i) - 1 AS _idx, cents * 10 + i AS v FROM x"""
)
def flat_map(spark, d):
    return op.flat_map(events(spark, d), F.col("user_id") % 4, lambda i: F.col("cents") * 10 + i)


@query(
    """SELECT n_nationkey::BIGINT AS _idx, list_transform((SELECT list(r_regionkey ORDER BY r_regionkey) FROM region),
    lambda r: r::BIGINT)[(n_regionkey % 5) + 1] AS picked, (SELECT count(*) FROM region) AS regions FROM nation"""
)
def with_table(spark, d):
    n = at_position(table(spark, d, "nation"), "n_nationkey").select(IDX, "n_regionkey")
    r = at_position(table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("r_regionkey")), "r_regionkey")
    both = op.with_table(n, r, "regions")
    return both.select(IDX, F.get("regions", (F.col("n_regionkey") % 5).cast("int"))["r_regionkey"].alias("picked"), F.size("regions").cast("long").alias("regions"))


# ---------------------------------------------------------------- sources


@query("SELECT i AS _idx, 42::BIGINT AS v FROM range(100000) t(i)")
def constant(spark, d):
    return generate.constant(spark, 42, 100_000).withColumn("v", F.col("v").cast("long"))


@query("SELECT i AS _idx, i + 1000 AS v FROM range(100000) t(i)")
def counting(spark, d):
    return generate.counting(spark, 1000, 100_000)


@query("SELECT i AS _idx, 5 + i * 3 AS v FROM range(100000) t(i)")
def stride(spark, d):
    return generate.stride(spark, 5, 3, 100_000)


def _draw_sql(seed: int, stream: int) -> str:
    """The hash of event_id, one step a subquery."""
    k = pcg.key(seed) ^ stream
    return f"""SELECT event_id, xor(word >> 22, word) AS x FROM (SELECT event_id, (xor(state >> ((state >> 28) + 4), state) * 277803737) & 4294967295 AS word
        FROM (SELECT event_id, (xor(event_id, {k}::BIGINT) * 747796405 + 2891336453) & 4294967295 AS state FROM events))"""


@query(f"SELECT event_id AS _idx, x % 100 + 10 AS v FROM ({_draw_sql(77, 0)})")
def uniform_u32(spark, d):
    return events(spark, d).select(IDX, pcg.uniform_u32(F.col(IDX), 10, 109, 77).alias("v"))


@query(
    f"""SELECT a.event_id AS _idx, ((b.x::HUGEINT * 4294967296 + a.x::HUGEINT) % 1000000007)::BIGINT AS v
    FROM ({_draw_sql(123456789012, 0)}) a JOIN ({_draw_sql(123456789012, pcg.SECOND)}) b USING (event_id)"""
)
def uniform_u64(spark, d):
    return events(spark, d).select(IDX, pcg.uniform_u64(F.col(IDX), 0, 1_000_000_006, 123456789012).cast("long").alias("v"))


@query(f"SELECT event_id AS _idx, ((x >> 8)::FLOAT * 5.9604644775390625e-8::FLOAT)::FLOAT AS v FROM ({_draw_sql(5, 0)})")
def uniform_f32(spark, d):
    return events(spark, d).select(IDX, pcg.uniform_f32(F.col(IDX), 0.0, 1.0, 5).alias("v"))


@query(
    f"""SELECT a.event_id AS _idx, -1.0::DOUBLE + (b.x * 2097152 + (a.x >> 11))::DOUBLE * 1.1102230246251565e-16::DOUBLE * 2.0::DOUBLE AS v
    FROM ({_draw_sql(6, 0)}) a JOIN ({_draw_sql(6, pcg.SECOND)}) b USING (event_id)"""
)
def uniform_f64(spark, d):
    return events(spark, d).select(IDX, pcg.uniform_f64(F.col(IDX), -1.0, 1.0, 6).alias("v"))


def _normal_sql(seed: int, result: str) -> str:
    return f"""SELECT _idx, {result} AS v FROM (SELECT a.event_id AS _idx, (sqrt(-2.0::DOUBLE * ln(((a.x >> 8)::DOUBLE + 0.5)::FLOAT::DOUBLE * 5.9604644775390625e-8::DOUBLE))::FLOAT
        * cos((6.283185307179586::FLOAT * (((b.x >> 8)::DOUBLE + 0.5)::FLOAT::DOUBLE * 5.9604644775390625e-8::DOUBLE)::FLOAT)::DOUBLE)::FLOAT)::FLOAT AS z
        FROM ({_draw_sql(seed, 0)}) a JOIN ({_draw_sql(seed, pcg.SECOND)}) b USING (event_id))"""


@query(_normal_sql(8, "(0::FLOAT + 1::FLOAT * z)::FLOAT"))
def normal_f32(spark, d):
    return events(spark, d).select(IDX, pcg.normal_f32(F.col(IDX), 0.0, 1.0, 8).alias("v"))


@query(_normal_sql(8, "10::DOUBLE + 2::DOUBLE * z::DOUBLE"))
def normal_f64(spark, d):
    return events(spark, d).select(IDX, pcg.normal_f64(F.col(IDX), 10.0, 2.0, 8).alias("v"))


# ---------------------------------------------------------------- selection


@query(f"WITH {E} SELECT row_number() OVER (ORDER BY _idx) - 1 AS _idx, cents FROM e WHERE event_type = 'click'")
def copy_where(spark, d):
    return op.copy_where(events(spark, d), F.col("event_type") == "click").select(IDX, "cents")


@query(f"WITH {E} SELECT row_number() OVER (ORDER BY _idx) - 1 AS _idx, cents FROM e WHERE NOT event_type = 'click'")
def remove_where(spark, d):
    return op.remove_where(events(spark, d), F.col("event_type") == "click").select(IDX, "cents")


@query(
    f"""WITH {E} SELECT row_number() OVER (ORDER BY CASE WHEN event_type = 'click' THEN 0 ELSE 1 END, _idx) - 1 AS _idx, cents,
    (SELECT count(*) FROM e WHERE event_type = 'click') AS _boundary FROM e"""
)
def partition(spark, d):
    return op.partition(events(spark, d), F.col("event_type") == "click").select(IDX, "cents", "_boundary")


@query(f"WITH {E} SELECT count(*) AS count FROM e WHERE cents > 5000")
def count_if(spark, d):
    return op.count_if(events(spark, d), F.col("cents") > 5000)


@query(f"WITH {E} SELECT bool_and(cents > -1) AS all_of FROM e")
def all_of(spark, d):
    return op.all_of(events(spark, d), F.col("cents") > -1)


@query(f"WITH {E} SELECT bool_or(cents > 100000000) AS any_of FROM e")
def any_of(spark, d):
    return op.any_of(events(spark, d), F.col("cents") > 100_000_000)


@query(f"WITH {E} SELECT NOT bool_or(cents < 0) AS none_of FROM e")
def none_of(spark, d):
    return op.none_of(events(spark, d), F.col("cents") < 0)


@query(f"WITH {E} SELECT min(_idx) AS index FROM e WHERE cents > 9000")
def find_if(spark, d):
    return op.find_if(events(spark, d), F.col("cents") > 9000)


@query(f"WITH {E} SELECT coalesce(max(_idx) FILTER (cents > 50) < min(_idx) FILTER (NOT cents > 50), true) AS is_partitioned FROM e")
def is_partitioned(spark, d):
    return op.is_partitioned(events(spark, d), F.col("cents") > 50)


# ---------------------------------------------------------------- reductions


@query(f"WITH {E} SELECT (100 + sum(cents))::BIGINT AS reduced FROM e")
def reduce(spark, d):
    return op.reduce(events(spark, d), F.col("cents"), M.add, init=100)


@query(f"WITH {E} SELECT (1 + sum(cents))::BIGINT AS reduced FROM e")
def reduce_with(spark, d):
    return op.reduce_with(events(spark, d), F.col("cents"), lambda a, b: a + b, F.lit(1).cast("long"))


@query(f"WITH {E} SELECT min(_idx) AS index FROM e WHERE cents = (SELECT min(cents) FROM e)")
def min_element(spark, d):
    return op.min_element(events(spark, d), "cents")


@query(f"WITH {E} SELECT min(_idx) AS index FROM e WHERE cents = (SELECT max(cents) FROM e)")
def max_element(spark, d):
    return op.max_element(events(spark, d), "cents")


@query(
    f"""WITH {E} SELECT (SELECT max(_idx) FROM e WHERE cents = (SELECT min(cents) FROM e)) AS min_index,
    (SELECT min(_idx) FROM e WHERE cents = (SELECT max(cents) FROM e)) AS max_index"""
)
def minmax_element(spark, d):
    return op.minmax_element(events(spark, d), "cents")


def _changed(spark, d):
    e = events(spark, d).select(IDX, "cents")
    return e, op.replace_where(e, F.col(IDX) == 700, cents=-5)


@query("SELECT false AS equal")
def equal(spark, d):
    return op.equal(*_changed(spark, d))


@query("SELECT 700::BIGINT AS index")
def mismatch(spark, d):
    return op.mismatch(*_changed(spark, d))


@query("SELECT false AS less")
def lexicographical_compare(spark, d):
    return op.lexicographical_compare(*_changed(spark, d))


@query(f"WITH {E}, x AS (SELECT _idx, user_id, lead(user_id) OVER (ORDER BY _idx) AS n FROM e) SELECT min(_idx) AS index FROM x WHERE user_id = n")
def adjacent_find(spark, d):
    return op.adjacent_find(events(spark, d), lambda a, b: a == b, "user_id")


@query(f"WITH {E}, x AS (SELECT cents, lag(cents) OVER (ORDER BY _idx) AS p FROM e) SELECT NOT coalesce(bool_or(cents < p), false) AS is_sorted FROM x")
def is_sorted(spark, d):
    return op.is_sorted(events(spark, d), "cents")


@query(f"WITH {E}, x AS (SELECT _idx, cents, lag(cents) OVER (ORDER BY _idx) AS p FROM e) SELECT coalesce(min(_idx) FILTER (cents < p), count(*)) AS until FROM x")
def is_sorted_until(spark, d):
    return op.is_sorted_until(events(spark, d), "cents")


# ---------------------------------------------------------------- scans and runs


@query(f"WITH {E} SELECT _idx, sum(cents) OVER (ORDER BY _idx)::BIGINT AS scan FROM e")
def inclusive_scan(spark, d):
    return op.inclusive_scan(events(spark, d), F.col("cents"), M.add).select(IDX, "scan")


@query(f"WITH {E} SELECT _idx, (1000 + coalesce(sum(cents) OVER (ORDER BY _idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS scan FROM e")
def exclusive_scan(spark, d):
    return op.exclusive_scan(events(spark, d), F.col("cents"), M.add, 1000).select(IDX, "scan")


@query(f"WITH {E} SELECT _idx, coalesce(cents - lag(cents) OVER (ORDER BY _idx), cents) AS difference FROM e")
def adjacent_difference(spark, d):
    return op.adjacent_difference(events(spark, d), "cents", lambda p, c: c - p).select(IDX, "difference")


RUNS = (
    f"{E}, h AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (ORDER BY _idx) THEN 0 ELSE 1 END AS h FROM e), "
    "r AS (SELECT *, sum(h) OVER (ORDER BY _idx)::BIGINT - 1 AS run FROM h)"
)


@query(f"WITH {RUNS} SELECT _idx, sum(cents) OVER (PARTITION BY run ORDER BY _idx)::BIGINT AS scan FROM r")
def inclusive_scan_by_key(spark, d):
    return op.inclusive_scan_by_key(events(spark, d), ["event_type"], F.col("cents"), M.add).select(IDX, "scan")


@query(f"WITH {RUNS} SELECT _idx, (5 + coalesce(sum(cents) OVER (PARTITION BY run ORDER BY _idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS scan FROM r")
def exclusive_scan_by_key(spark, d):
    return op.exclusive_scan_by_key(events(spark, d), ["event_type"], F.col("cents"), M.add, 5).select(IDX, "scan")


@query(f"WITH {RUNS} SELECT run AS _idx, any_value(event_type) AS event_type, (3 + sum(cents))::BIGINT AS reduced FROM r GROUP BY run")
def reduce_by_key(spark, d):
    return op.reduce_by_key(events(spark, d), ["event_type"], F.col("cents"), M.add, init=3)


@query(f"WITH {RUNS} SELECT run AS _idx, event_type FROM r WHERE h = 1")
def unique(spark, d):
    return op.unique(events(spark, d).select(IDX, "event_type"))


@query(f"WITH {RUNS} SELECT run AS _idx, cents FROM r WHERE h = 1")
def unique_by_key(spark, d):
    return op.unique_by_key(events(spark, d).select(IDX, "event_type", "cents"), ["event_type"])


@query(f"WITH {E} SELECT _idx, max(cents) OVER (ORDER BY _idx) AS scan FROM e")
def scan_with(spark, d):
    return op.scan_with(events(spark, d), F.col("cents"), lambda a, b: F.greatest(a, b)).select(IDX, "scan")


@query(f"WITH {RUNS} SELECT _idx, min(cents) OVER (PARTITION BY run ORDER BY _idx) AS scan FROM r")
def scan_by_key_with(spark, d):
    return op.scan_by_key_with(events(spark, d), ["event_type"], F.col("cents"), lambda a, b: F.least(a, b)).select(IDX, "scan")


BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


@query(f"WITH {E} SELECT _idx, greatest(900, max(cents) OVER (ORDER BY _idx {BEFORE})) AS scan FROM e")
def exclusive_scan_with(spark, d):
    return op.exclusive_scan_with(events(spark, d), F.col("cents"), lambda a, b: F.greatest(a, b), F.lit(900).cast("long")).select(IDX, "scan")


@query(f"WITH {RUNS} SELECT _idx, least(70000, min(cents) OVER (PARTITION BY run ORDER BY _idx {BEFORE})) AS scan FROM r")
def exclusive_scan_by_key_with(spark, d):
    return op.exclusive_scan_by_key_with(events(spark, d), ["event_type"], F.col("cents"), lambda a, b: F.least(a, b), F.lit(70_000).cast("long")).select(IDX, "scan")


@query(f"WITH {RUNS} SELECT run AS _idx, any_value(event_type) AS event_type, arg_max(cents, _idx) AS reduced FROM r GROUP BY run")
def reduce_by_key_with(spark, d):
    """The later of two is associative, but not commutative: each run's last value."""
    return op.reduce_by_key_with(events(spark, d), ["event_type"], F.col("cents"), lambda a, b: b)


NEAR = f"{E}, h AS (SELECT *, coalesce(abs(user_id - lag(user_id) OVER (ORDER BY _idx)) > 10, true) AS h FROM e), r AS (SELECT *, sum(h::INT) OVER (ORDER BY _idx)::BIGINT - 1 AS run FROM h)"


@query(f"WITH {NEAR} SELECT run AS _idx, arg_min(user_id, _idx) AS user_id, sum(cents)::BIGINT AS reduced FROM r GROUP BY run")
def reduce_by_key_same(spark, d):
    """Neighbours whose users are 10 apart or less count as one key."""
    return op.reduce_by_key(events(spark, d), ["user_id"], F.col("cents"), M.add, same=lambda a, b: F.abs(b - a) <= 10)


@query(f"WITH {NEAR} SELECT run AS _idx, user_id, cents FROM r WHERE h")
def unique_same(spark, d):
    return op.unique(events(spark, d).select(IDX, "user_id", "cents"), "user_id", same=lambda a, b: F.abs(b - a) <= 10)


@query(
    f"""WITH {E}, x AS (SELECT _idx, _idx > 0 AND (user_id, -cents) < (lag(user_id) OVER (ORDER BY _idx), -lag(cents) OVER (ORDER BY _idx)) AS b FROM e)
    SELECT NOT coalesce(bool_or(b), false) AS is_sorted, coalesce(min(_idx) FILTER (b), count(*)) AS until FROM x"""
)
def is_sorted_many(spark, d):
    e = events(spark, d)
    return op.is_sorted(e, "user_id", "-cents").join(op.is_sorted_until(e, "user_id", "-cents"))


@query(
    f"""WITH {E}, x AS (SELECT _idx, user_id, cents, lag(user_id) OVER w AS u, lag(cents) OVER w AS c FROM e WINDOW w AS (ORDER BY _idx))
    SELECT _idx, CASE WHEN u IS NULL THEN user_id ELSE user_id - u END AS user_step, CASE WHEN u IS NULL THEN cents ELSE cents - c END AS cents_step FROM x"""
)
def adjacent_difference_many(spark, d):
    def step(a, b):
        return F.struct((b["user_id"] - a["user_id"]).alias("user_id"), (b["cents"] - a["cents"]).alias("cents"))

    got = op.adjacent_difference(events(spark, d), ["user_id", "cents"], step)
    return got.select(IDX, F.col("difference")["user_id"].alias("user_step"), F.col("difference")["cents"].alias("cents_step"))


@query(f"WITH {E} SELECT count(*) AS length, count(*) = 0 AS is_empty FROM e")
def length(spark, d):
    return generate.length(events(spark, d))


# ---------------------------------------------------------------- order


@query(f"WITH {PART} SELECT row_number() OVER (ORDER BY size DESC, _idx) - 1 AS _idx, brand, size FROM p")
def sort(spark, d):
    return op.sort(parts(spark, d).select(IDX, "brand", "size"), F.desc("size"))


@query(f"WITH {PART} SELECT row_number() OVER (ORDER BY brand, size, _idx) - 1 AS _idx, cents FROM p")
def sort_by_key(spark, d):
    return op.sort_by_key(parts(spark, d), F.asc("brand"), F.asc("size"), keys=["brand", "size"])


@query("SELECT row_number() OVER (ORDER BY l_discount, l_tax, " + LINE_ORDER + ", cents) - 1 AS _idx, cents FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem)")
def radix_sort_by_key(spark, d):
    t = table(spark, d, "lineitem").select("l_discount", "l_tax", *LINE_ORDER.split(", "), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    rows = with_index(t, *LINE_ORDER.split(", "), "cents").select(IDX, "l_discount", "l_tax", "cents")
    return op.radix_sort_by_key(rows, ["l_discount", "l_tax"])


WIDE = "l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax"


@query(f"SELECT row_number() OVER (ORDER BY l_discount, l_quantity DESC, l_suppkey, {LINE_ORDER}, l_extendedprice) - 1 AS _idx, {WIDE} FROM lineitem")
def sort_wide(spark, d):
    """Three keys, one of them falling, and seven value columns."""
    t = table(spark, d, "lineitem").select("l_orderkey", *WIDE.split(", "))
    rows = with_index(t, *LINE_ORDER.split(", "), "l_extendedprice")
    return op.sort(rows, F.asc("l_discount"), F.desc("l_quantity"), F.asc("l_suppkey")).select(IDX, *WIDE.split(", "))


def _halves(spark, d):
    p = parts(spark, d).select(IDX, "size", "cents")
    left, right = op.copy_where(p, F.col("size") % 2 == 0), op.remove_where(p, F.col("size") % 2 == 0)
    return op.sort(left, F.asc("cents")), op.sort(right, F.asc("cents"))


MERGED = f"WITH {PART} SELECT row_number() OVER (ORDER BY cents, size % 2, _idx) - 1 AS _idx, size"


@query(MERGED + ", cents FROM p")
def merge(spark, d):
    return op.merge(*_halves(spark, d), F.asc("cents"))


@query(MERGED + " FROM p")
def merge_by_key(spark, d):
    return op.merge_by_key(*_halves(spark, d), F.asc("cents"), keys=["cents"])


def _bands(spark, d):
    t = table(spark, d, "lineitem").select("l_quantity", F.col("l_suppkey").cast("long").alias("k"))
    return (with_index(t.filter(c).select("k"), "k") for c in ("l_quantity < 25", "l_quantity >= 25"))


def _sets_sql(how: str) -> str:
    a, b = ("SELECT l_suppkey::BIGINT AS k FROM lineitem WHERE l_quantity " + x for x in ("< 25", ">= 25"))
    body = {"union": f"({a}) UNION ALL (({b}) EXCEPT ALL ({a}))", "intersect": f"({a}) INTERSECT ALL ({b})", "except": f"({a}) EXCEPT ALL ({b})"}[how]
    return f"SELECT row_number() OVER (ORDER BY k) - 1 AS _idx, k FROM ({body})"


@query(_sets_sql("union"))
def set_union(spark, d):
    return op.set_union(*_bands(spark, d))


@query(_sets_sql("intersect"))
def set_intersection(spark, d):
    return op.set_intersection(*_bands(spark, d))


@query(_sets_sql("except"))
def set_difference(spark, d):
    return op.set_difference(*_bands(spark, d))


# ---------------------------------------------------------------- search and movement


def _bound_args(spark, d):
    source = op.sort(orders(spark, d).select(IDX, F.col("cents").alias("key")), F.asc("key"))
    return source, parts(spark, d).select(IDX, (F.col("cents") * 100).alias("key"))


def _bound_sql(less: str) -> str:
    return f"""WITH {ORD}, {PART}, q AS (SELECT _idx, cents * 100 AS key FROM p), c AS (SELECT cents, count(*) AS n FROM o GROUP BY cents)
    SELECT q._idx, q.key, coalesce((SELECT sum(n) FROM c WHERE c.cents {less} q.key), 0)::BIGINT AS bound FROM q"""


@query(_bound_sql("<"))
def lower_bound(spark, d):
    return op.lower_bound(*_bound_args(spark, d), "key")


@query(_bound_sql("<="))
def upper_bound(spark, d):
    return op.upper_bound(*_bound_args(spark, d), "key")


@query(
    f"""WITH {PART}, q AS (SELECT _idx, brand, 51 - size AS size FROM p), c AS (SELECT brand, size, count(*) AS n FROM p GROUP BY ALL)
    SELECT _idx, brand, size, coalesce((SELECT sum(n) FROM c WHERE c.brand < q.brand OR c.brand = q.brand AND c.size > q.size), 0)::BIGINT AS bound FROM q"""
)
def lower_bound_many(spark, d):
    """By brand, then falling size."""
    p = parts(spark, d).select(IDX, "brand", "size")
    source = op.sort(p, F.asc("brand"), F.desc("size"))
    return op.lower_bound(source, p.select(IDX, "brand", (51 - F.col("size")).alias("size")), ["brand", "-size"])


@query(f"WITH {E}, {PART} SELECT min(e._idx) AS index FROM e WHERE EXISTS (SELECT 1 FROM p WHERE abs(e.cents - p.size * 100) < 3)")
def find_first_of_same(spark, d):
    needles = parts(spark, d).select(IDX, (F.col("size") * 100).cast("long").alias("cents"))
    return op.find_first_of(events(spark, d), needles, "cents", lambda a, b: F.abs(a - b) < 3, at_once=64)


@query(f"WITH {E}, {PART} SELECT min(e._idx) AS index FROM e WHERE cents IN (SELECT size * 100 + 7 FROM p)")
def find_first_of(spark, d):
    return op.find_first_of(events(spark, d), parts(spark, d).select(IDX, (F.col("size") * 100 + 7).cast("long").alias("cents")), "cents")


CUST = "c AS (SELECT c_custkey AS _idx, c_nationkey AS nation, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer)"


def customers(spark, d):
    t = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.round(F.col("c_acctbal") * 100).cast("long").alias("cents"))
    return at_position(t, "c_custkey").drop("c_custkey")


@query(f"WITH {ORD}, {CUST} SELECT o._idx, c.nation, c.cents FROM o JOIN c ON o.cust = c._idx")
def gather(spark, d):
    return op.gather(customers(spark, d), orders(spark, d), "cust")


@query(f"WITH {ORD}, {CUST} SELECT o._idx, CASE WHEN o.cust % 2 = 0 THEN c.cents ELSE o.cents END AS cents FROM o JOIN c ON o.cust = c._idx")
def gather_where(spark, d):
    o = orders(spark, d)
    return op.gather_where(customers(spark, d).select(IDX, "cents"), o.select(IDX, F.col("cust").alias("index")), F.col("index") % 2 == 0, o.select(IDX, "cents"))


@query(f"WITH {ORD}, {CUST}, s AS (SELECT cust, arg_max(cents, _idx) AS v FROM o GROUP BY cust) SELECT c._idx, coalesce(s.v, c.cents) AS cents FROM c LEFT JOIN s ON c._idx = s.cust")
def scatter(spark, d):
    return op.scatter(orders(spark, d).withColumnRenamed("cust", "index"), customers(spark, d).select(IDX, "cents"))


@query(
    f"""WITH {ORD}, {CUST}, s AS (SELECT cust, arg_max(cents, _idx) AS v FROM o WHERE cents % 2 = 0 GROUP BY cust)
    SELECT c._idx, coalesce(s.v, c.cents) AS cents FROM c LEFT JOIN s ON c._idx = s.cust"""
)
def scatter_where(spark, d):
    return op.scatter_where(orders(spark, d).withColumnRenamed("cust", "index"), F.col("cents") % 2 == 0, customers(spark, d).select(IDX, "cents"))


@query(f"WITH {ORD}, {CUST}, s AS (SELECT cust, sum(cents) AS v FROM o GROUP BY cust) SELECT c._idx, (c.cents + coalesce(s.v, 0))::BIGINT AS cents FROM c LEFT JOIN s ON c._idx = s.cust")
def scatter_reduce(spark, d):
    return op.scatter_reduce(orders(spark, d).withColumnRenamed("cust", "index"), customers(spark, d).select(IDX, "cents"), "cents", M.add)


@query(f"WITH {ORD}, {CUST}, s AS (SELECT cust, arg_max(cents, _idx) AS v FROM o GROUP BY cust) SELECT c._idx, coalesce(s.v, c.cents) AS cents FROM c LEFT JOIN s ON c._idx = s.cust")
def scatter_reduce_with(spark, d):
    """The later of two: what comes last stays."""
    return op.scatter_reduce_with(orders(spark, d).withColumnRenamed("cust", "index"), customers(spark, d).select(IDX, "cents"), "cents", lambda a, b: b)


# ---------------------------------------------------------------- segments: lineitems of each order

SEGL = """n AS (SELECT o_orderkey AS seg, count(l_orderkey) AS length FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
    s AS (SELECT seg, coalesce(sum(length) OVER (ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, length FROM n),
    x AS (SELECT l_orderkey AS seg, row_number() OVER w - 1 AS pos, l_suppkey AS supp, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents
        FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, CAST(round(l_extendedprice * 100) AS BIGINT)))"""


def _lengths(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias(IDX))
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias(IDX)).agg(F.count("*").alias("n"))
    return o.join(n, IDX, "left").select(IDX, F.coalesce("n", F.lit(0)).alias("length"))


def _segments(spark, d):
    cut = S.Segmentation.from_lengths(_lengths(spark, d))
    cut = S.Segmentation(stored(cut.rows, "segments"))
    values = lines(spark, d).select(IDX, F.col("l_suppkey").alias("supp"), "cents")
    return cut, cut.attach(values)


@query(f"WITH {SEGL} SELECT seg, start, length FROM s")
def segmentation_from_lengths(spark, d):
    return S.Segmentation.from_lengths(_lengths(spark, d)).rows


@query(f"WITH {SEGL} SELECT seg AS _idx, start AS offset FROM s UNION ALL SELECT count(*), sum(length)::BIGINT FROM s")
def segmentation_offsets(spark, d):
    cut = S.Segmentation.from_lengths(_lengths(spark, d))
    return S.Segmentation.from_offsets(stored(cut.offsets().withColumn("offset", F.col("offset").cast("long")), "offsets")).offsets()


@query(f"WITH {SEGL} SELECT seg AS _idx, length FROM s")
def segmentation_from_segment_ids(spark, d):
    ids = lines(spark, d).select(IDX, F.col("l_orderkey").alias("seg"))
    return S.Segmentation.from_segment_ids(ids, table(spark, d, "orders").count()).lengths().withColumn("length", F.col("length").cast("long"))


@query(f"WITH {SEGL} SELECT row_number() OVER (ORDER BY seg, pos) - 1 AS _idx, seg FROM x")
def segmentation_ids(spark, d):
    return S.Segmentation.from_lengths(_lengths(spark, d)).segment_ids()


@query(f"WITH {SEGL} SELECT seg, pos, cents * 2 AS v FROM x")
def seg_map(spark, d):
    _, x = _segments(spark, d)
    return S.seg_map(x, v=F.col("cents") * 2)


@query(f"WITH {SEGL}, y AS (SELECT seg, pos, cents, unnest(range(supp % 3)) AS i FROM x) SELECT seg, row_number() OVER (PARTITION BY seg ORDER BY pos, i) - 1 AS pos, cents + i AS v FROM y")
def seg_flat_map(spark, d):
    _, x = _segments(spark, d)
    return S.seg_flat_map(x, F.col("supp") % 3, lambda i: F.col("cents") + i)


@query(f"WITH {SEGL} SELECT seg, row_number() OVER (PARTITION BY seg ORDER BY supp, pos) - 1 AS pos, supp, cents FROM x")
def seg_sort(spark, d):
    _, x = _segments(spark, d)
    return S.seg_sort(x, F.asc("supp"))


@query(f"WITH {SEGL} SELECT seg, length - 1 - pos AS pos, supp, cents FROM x JOIN s USING (seg)")
def seg_reverse(spark, d):
    cut, x = _segments(spark, d)
    return S.seg_reverse(x, cut)


@query(f"WITH {SEGL} SELECT seg, pos, sum(cents) OVER (PARTITION BY seg ORDER BY pos)::BIGINT AS scan FROM x")
def seg_inclusive_scan(spark, d):
    _, x = _segments(spark, d)
    return S.seg_inclusive_scan(x, F.col("cents"), M.add).select("seg", "pos", "scan")


@query(f"WITH {SEGL} SELECT seg, pos, (9 + coalesce(sum(cents) OVER (PARTITION BY seg ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS scan FROM x")
def seg_exclusive_scan(spark, d):
    _, x = _segments(spark, d)
    return S.seg_exclusive_scan(x, F.col("cents"), M.add, 9).select("seg", "pos", "scan")


@query(f"WITH {SEGL} SELECT seg, pos, coalesce(cents - lag(cents) OVER (PARTITION BY seg ORDER BY pos), cents) AS difference FROM x")
def seg_adjacent_difference(spark, d):
    _, x = _segments(spark, d)
    return S.seg_adjacent_difference(x, "cents", lambda p, c: c - p).select("seg", "pos", "difference")


@query(
    f"""WITH {SEGL}, y AS (SELECT *, lag(supp % 5) OVER (PARTITION BY seg ORDER BY pos) AS p FROM x)
    SELECT seg, row_number() OVER (PARTITION BY seg ORDER BY pos) - 1 AS pos, supp % 5 AS k FROM y WHERE p IS NULL OR p <> supp % 5"""
)
def seg_unique(spark, d):
    _, x = _segments(spark, d)
    return S.seg_unique(x.select("seg", "pos", (F.col("supp") % 5).alias("k")), "k")


@query(f"WITH {SEGL} SELECT seg, row_number() OVER (PARTITION BY seg ORDER BY pos) - 1 AS pos, supp, cents FROM x WHERE cents > 3000000")
def seg_filter(spark, d):
    _, x = _segments(spark, d)
    return S.seg_filter(x, F.col("cents") > 3_000_000)


@query(f"WITH {SEGL} SELECT seg, pos, max(cents) OVER (PARTITION BY seg ORDER BY pos) AS scan FROM x")
def seg_inclusive_scan_with(spark, d):
    _, x = _segments(spark, d)
    return S.seg_inclusive_scan_with(x, F.col("cents"), lambda a, b: F.greatest(a, b)).select("seg", "pos", "scan")


@query(f"WITH {SEGL} SELECT seg, pos, coalesce(lag(cents) OVER (PARTITION BY seg ORDER BY pos), 5) AS scan FROM x")
def seg_exclusive_scan_with(spark, d):
    """The later of two."""
    _, x = _segments(spark, d)
    return S.seg_exclusive_scan_with(x, F.col("cents"), lambda a, b: b, F.lit(5).cast("long")).select("seg", "pos", "scan")


def _per_segment(sql: str, empty: str, name: str) -> str:
    return f"WITH {SEGL}, r AS (SELECT seg, {sql} AS v FROM x GROUP BY seg) SELECT s.seg, coalesce(r.v, {empty}) AS {name} FROM s LEFT JOIN r USING (seg)"


@query(_per_segment("(4 + sum(cents))::BIGINT", "4", "reduced"))
def seg_reduce(spark, d):
    cut, x = _segments(spark, d)
    return S.seg_reduce(x, cut, F.col("cents"), M.add, 4)


@query(_per_segment("arg_max(cents, pos)", "5", "reduced"))
def seg_reduce_with(spark, d):
    cut, x = _segments(spark, d)
    return S.seg_reduce_with(x, cut, F.col("cents"), lambda a, b: b, F.lit(5).cast("long"))


@query(_per_segment("count(*) FILTER (cents > 3000000)", "0", "count"))
def seg_count_if(spark, d):
    cut, x = _segments(spark, d)
    return S.seg_count_if(x, cut, F.col("cents") > 3_000_000)


@query(_per_segment("bool_and(cents > 3000000)", "true", "all_of"))
def seg_all_of(spark, d):
    cut, x = _segments(spark, d)
    return S.seg_all_of(x, cut, F.col("cents") > 3_000_000)


@query(_per_segment("bool_or(cents > 3000000)", "false", "any_of"))
def seg_any_of(spark, d):
    cut, x = _segments(spark, d)
    return S.seg_any_of(x, cut, F.col("cents") > 3_000_000)


@query(_per_segment("NOT bool_or(cents > 3000000)", "true", "none_of"))
def seg_none_of(spark, d):
    cut, x = _segments(spark, d)
    return S.seg_none_of(x, cut, F.col("cents") > 3_000_000)


@query(f"WITH {SEGL} SELECT x.seg, pos, x.cents + CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM x JOIN orders ON o_orderkey = x.seg")
def seg_context(spark, d):
    """Each lineitem beside its order's price."""
    _, x = _segments(spark, d)
    both = S.seg_context(x, orders(spark, d).select(IDX, F.col("cents").alias("price")), "price")
    return S.seg_map(both, v=F.col("cents") + F.col("price"))


@query(f"WITH {SEGL}, r AS (SELECT seg, sum(cents) AS v FROM x GROUP BY seg) SELECT s.seg, (coalesce(r.v, 0) - CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS reduced FROM s JOIN orders ON o_orderkey = s.seg LEFT JOIN r ON r.seg = s.seg")
def seg_reduce_context(spark, d):
    """What an order's lineitems amount to, less its price; orders without lineitems too."""
    cut, x = _segments(spark, d)
    return S.seg_reduce_context(x, cut, orders(spark, d).select(IDX, F.col("cents").alias("price")), F.col("cents"), M.add, lambda r, c: r - c["price"], 0)


BROKEN = f"{SEGL}, b AS (SELECT seg, pos, coalesce(supp < lag(supp) OVER (PARTITION BY seg ORDER BY pos), false) AS b FROM x)"


@query(f"WITH {BROKEN}, r AS (SELECT seg, NOT bool_or(b) AS v FROM b GROUP BY seg) SELECT s.seg, coalesce(r.v, true) AS is_sorted FROM s LEFT JOIN r USING (seg)")
def seg_is_sorted(spark, d):
    cut, x = _segments(spark, d)
    return S.seg_is_sorted(x, cut, "supp")


@query(f"WITH {BROKEN}, r AS (SELECT seg, coalesce(min(pos) FILTER (b), count(*)) AS v FROM b GROUP BY seg) SELECT s.seg, coalesce(r.v, 0) AS until FROM s LEFT JOIN r USING (seg)")
def seg_is_sorted_until(spark, d):
    cut, x = _segments(spark, d)
    return S.seg_is_sorted_until(x, cut, "supp")


# ---------------------------------------------------------------- graphs

#: customers (even) and suppliers (odd) that met in an order, both ways; weight: how often
CS = """m AS (SELECT o_custkey * 2 AS a, l_suppkey * 2 + 1 AS b, count(*) AS w FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
    g AS (SELECT a AS src, b AS dst, w FROM m UNION ALL SELECT b, a, w FROM m),
    ed AS (SELECT row_number() OVER (ORDER BY src, dst) - 1 AS edge_id, * FROM g),
    v AS (SELECT c_custkey * 2 AS id, CAST(round(c_acctbal * 100) AS BIGINT) AS val FROM customer UNION ALL SELECT s_suppkey * 2 + 1, CAST(round(s_acctbal * 100) AS BIGINT) FROM supplier),
    dg AS (SELECT v.id, count(ed.src) AS n FROM v LEFT JOIN ed ON ed.src = v.id GROUP BY v.id)"""


def _met(spark, d):
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    met = o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).groupBy((F.col("o_custkey") * 2).alias("a"), (F.col("l_suppkey") * 2 + 1).alias("b")).agg(F.count("*").alias("w"))
    met = stored(met, "met")
    both = met.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").unionByName(met.select(F.col("b").alias("src"), F.col("a").alias("dst"), "w"))
    c = table(spark, d, "customer").select((F.col("c_custkey") * 2).alias("id"), F.round(F.col("c_acctbal") * 100).cast("long").alias("val"))
    s = table(spark, d, "supplier").select((F.col("s_suppkey") * 2 + 1).alias("id"), F.round(F.col("s_acctbal") * 100).cast("long").alias("val"))
    return T.csr(both, "w"), c.unionByName(s)


def _frontier(vertices):
    """Every vertex in order; multiples of 10 twice."""
    twice = vertices.select("id", F.explode(F.when(F.col("id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("k"))
    return with_index(twice, "id", "k").select(IDX, F.col("id").alias("v"))


CSF = CS + """, f AS (SELECT row_number() OVER (ORDER BY id, k) - 1 AS _idx, id AS v FROM (SELECT id, unnest(CASE WHEN id % 10 = 0 THEN [0, 1] ELSE [0] END) AS k FROM v)),
    t AS (SELECT f._idx AS f_idx, ed.* FROM f JOIN ed ON f.v = ed.src)"""


@query(f"WITH {CSF} SELECT row_number() OVER (ORDER BY f_idx, edge_id) - 1 AS _idx, src, dst, w FROM t")
def graph_emit(spark, d):
    edges, vertices = _met(spark, d)
    return T.emit(T.traverse(edges, _frontier(vertices)), src=F.col("src"), dst=F.col("dst"), w=F.col("w"))


@query(f"WITH {CSF} SELECT row_number() OVER (ORDER BY f_idx, edge_id) - 1 AS _idx, dst, w * 3 + edge_id AS v FROM t")
def graph_edge_values(spark, d):
    """Values that aren't on the edges but in a sequence by edge number."""
    edges, vertices = _met(spark, d)
    values = edges.select(F.col("edge_id").alias(IDX), (F.col("w") * 3 + F.col("edge_id")).alias("x"))
    return T.emit(T.edge(T.traverse(edges, _frontier(vertices)), values, "x"), dst=F.col("dst"), v=F.col("edge_x"))


@query(f"WITH {CSF} SELECT count(*) AS edges, count(*) <= 1000 AS fits FROM t")
def graph_edge_count(spark, d):
    edges, vertices = _met(spark, d)
    return T.edge_count(edges, _frontier(vertices), 1000)


@query(f"WITH {CSF} SELECT f_idx, edge_id, src, dst FROM t QUALIFY row_number() OVER (ORDER BY f_idx, edge_id) <= 500")
def graph_traverse_capacity(spark, d):
    edges, vertices = _met(spark, d)
    return T.traverse(edges, _frontier(vertices), max_edges=500).select("f_idx", "edge_id", "src", "dst")


@query(f"WITH {CSF}, r AS (SELECT f_idx, sum(w + val) AS x FROM t JOIN v ON v.id = t.dst GROUP BY f_idx) SELECT f._idx, f.v, coalesce(r.x, 0)::BIGINT AS reduced FROM f LEFT JOIN r ON f._idx = r.f_idx")
def graph_reduce_by_source(spark, d):
    edges, vertices = _met(spark, d)
    f = _frontier(vertices)
    return T.reduce_by_source(T.destination(T.traverse(edges, f), vertices, "val"), f, F.col("w") + F.col("destination_val"), M.add, 0)


@query(f"WITH {CSF}, r AS (SELECT dst, sum(w * v.val) AS x FROM t JOIN v ON v.id = t.src GROUP BY dst) SELECT v.id, coalesce(r.x, 0)::BIGINT AS reduced FROM v LEFT JOIN r ON v.id = r.dst")
def graph_reduce_by_destination(spark, d):
    edges, vertices = _met(spark, d)
    t = T.source(T.traverse(edges, _frontier(vertices)), vertices, "val")
    return T.reduce_by_destination(t, vertices, F.col("w") * F.col("source_val"), M.add, 0)


@query(f"WITH {CSF}, r AS (SELECT dst, max(w) AS x FROM t GROUP BY dst) SELECT v.id, greatest(v.val, coalesce(r.x, v.val)) AS val FROM v LEFT JOIN r ON v.id = r.dst")
def graph_update_by_destination(spark, d):
    edges, vertices = _met(spark, d)
    return T.update_by_destination(T.traverse(edges, _frontier(vertices)), vertices, F.col("w"), M.maximum, "val")


@query(f"WITH {CSF}, r AS (SELECT dst, min(edge_id) AS x FROM t GROUP BY dst) SELECT v.id, least(v.val, coalesce(r.x, v.val)) AS val, coalesce(r.x < v.val, false) AS lowered FROM v LEFT JOIN r ON v.id = r.dst")
def graph_relax_min(spark, d):
    edges, vertices = _met(spark, d)
    new, _ = T.relax_min_by_destination(T.traverse(edges, _frontier(vertices)), vertices, F.col("edge_id"), "val")
    return new.withColumnRenamed("__less", "lowered")


@query(
    f"""WITH {CS}, q AS (SELECT s_suppkey AS _idx, s_suppkey * 2 + 1 AS a, ((s_suppkey + 1) % (SELECT count(*) FROM supplier)) * 2 + 1 AS b FROM supplier),
    r AS (SELECT q._idx, count(*) AS n FROM q JOIN ed x ON x.src = q.a JOIN ed y ON y.src = q.b AND y.dst = x.dst GROUP BY q._idx)
    SELECT q._idx, q.a, q.b, coalesce(r.n, 0) AS common FROM q LEFT JOIN r USING (_idx)"""
)
def graph_intersect_count(spark, d):
    edges, _ = _met(spark, d)
    s = table(spark, d, "supplier")
    n = s.count()
    pairs = s.select(F.col("s_suppkey").alias(IDX), (F.col("s_suppkey") * 2 + 1).alias("a"), (((F.col("s_suppkey") + 1) % n) * 2 + 1).alias("b"))
    return T.intersect_count(edges, pairs)


@query(f"WITH {CS}, y AS (SELECT src, sum(w * val) AS y FROM ed JOIN v ON v.id = ed.dst GROUP BY src) SELECT v.id, coalesce(y.y, 0)::BIGINT AS y FROM v LEFT JOIN y ON y.src = v.id")
def spmv(spark, d):
    return G.spmv(*_met(spark, d), "w", "val")


@query(f"WITH {CS}, g2 AS (SELECT src, count(*) AS n FROM ed GROUP BY src) SELECT edge_id, ed.src, dst, 4 - x.n - y.n AS curvature FROM ed JOIN g2 x ON x.src = ed.src JOIN g2 y ON y.src = ed.dst")
def forman_ricci(spark, d):
    return G.forman_ricci(*_met(spark, d))


#: suppliers that share orders, both ways; weight: how many
SS = """k AS (SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS w FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL),
    g AS (SELECT a AS src, b AS dst, w FROM k UNION ALL SELECT b, a, w FROM k),
    ed AS (SELECT row_number() OVER (ORDER BY src, dst) - 1 AS edge_id, * FROM g),
    v AS (SELECT s_suppkey AS id, s_acctbal AS bal FROM supplier),
    dg AS (SELECT v.id, count(ed.src) AS n FROM v LEFT JOIN ed ON ed.src = v.id GROUP BY v.id)"""


def _shared(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("a"))
    pairs = l.join(l.withColumnRenamed("a", "b"), "l_orderkey").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("w"))
    pairs = stored(pairs, "shared")
    both = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"), "w"))
    return stored(T.csr(both, "w"), "shared"), table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"))


@query(
    f"""WITH RECURSIVE {CS}, r(id, level) AS (SELECT 0::BIGINT, 0 UNION SELECT ed.dst, level + 1 FROM r JOIN ed ON ed.src = r.id WHERE level < 12)
    SELECT v.id, coalesce(min(level), 4294967295)::BIGINT AS level FROM v LEFT JOIN r USING (id) GROUP BY v.id"""
)
def bfs(spark, d):
    return G.bfs(*_met(spark, d), 0)


def _unrolled_sql(graph: str, first: str, step: str, rounds: int, result: str) -> str:
    """b0, b1, ...: {b} in step is the state before."""
    parts = [f"b0 AS ({first})"] + [f"b{k + 1} AS MATERIALIZED ({step.format(b=f'b{k}')})" for k in range(rounds)]
    return f"WITH {graph}, {', '.join(parts)} {result.format(b=f'b{rounds}')}"


@query(
    _unrolled_sql(
        CS, "SELECT id, CASE WHEN id = 0 THEN 0 ELSE 1000000000 END::BIGINT AS distance FROM v",
        "SELECT b.id, least(b.distance, coalesce(p.p, b.distance)) AS distance FROM {b} b LEFT JOIN "
        "(SELECT ed.dst, min(least(x.distance + w, 1000000000)) AS p FROM ed JOIN {b} x ON x.id = ed.src GROUP BY ed.dst) p ON p.dst = b.id",
        20, "SELECT id, distance::BIGINT AS distance FROM {b}",
    )
)
def sssp(spark, d):
    return G.sssp(*_met(spark, d), 0)


@query(
    _unrolled_sql(
        CS, "SELECT id, id AS component FROM v",
        "SELECT b.id, least(b.component, coalesce(p.p, b.component)) AS component FROM {b} b LEFT JOIN (SELECT ed.dst, min(x.component) AS p FROM ed JOIN {b} x ON x.id = ed.src GROUP BY ed.dst) p ON p.dst = b.id",
        12, "SELECT id, component FROM {b}",
    )
)
def cc(spark, d):
    return G.cc(*_met(spark, d)).select("id", "component")


def _rank_steps(rounds: int, jump: str) -> str:
    steps = ["b0 AS (SELECT id, n, 1.0::DOUBLE / (SELECT count(*) FROM v) AS rank FROM dg)"]
    for k in range(rounds):
        steps.append(
            f"b{k + 1} AS MATERIALIZED (SELECT b.id, b.n, coalesce(p.p, 0) * 0.85::DOUBLE + 0.85::DOUBLE * (SELECT coalesce(sum(rank), 0) FROM b{k} WHERE n = 0) / (SELECT count(*) FROM v) + {jump} AS rank "
            f"FROM b{k} b LEFT JOIN (SELECT ed.dst, sum(x.rank / x.n) AS p FROM ed JOIN b{k} x ON x.id = ed.src GROUP BY ed.dst) p ON p.dst = b.id)"
        )
    return ", ".join(steps)


def _rank_sql(rounds: int, jump: str) -> str:
    return f"WITH {CS}, {_rank_steps(rounds, jump)} SELECT id, round(rank, 9) AS rank FROM b{rounds}"


TO_ROOT = "CASE WHEN b.id = 0 THEN 1 - 0.85::DOUBLE ELSE 0 END"


@query(_rank_sql(4, "(1 - 0.85::DOUBLE) / (SELECT count(*) FROM v)"))
def pagerank(spark, d):
    return G.pagerank(*_met(spark, d), iterations=4).select("id", F.round("rank", 9).alias("rank"))


@query(_rank_sql(4, TO_ROOT))
def personalised_pagerank(spark, d):
    return G.personalised_pagerank(*_met(spark, d), 0, iterations=4).select("id", F.round("rank", 9).alias("rank"))


@query(
    f"""WITH {CS}, {_rank_steps(8, TO_ROOT)}, o AS (SELECT id, n, row_number() OVER (ORDER BY CASE WHEN n = 0 THEN -1 ELSE round(rank / n, 10) END DESC, id) - 1 AS _idx FROM b8),
    x AS (SELECT a._idx, count(*) AS e FROM ed JOIN o a ON a.id = ed.src JOIN o b ON b.id = ed.dst WHERE b._idx < a._idx GROUP BY a._idx),
    s AS (SELECT o._idx, sum(n - 2 * coalesce(e, 0)) OVER w AS cut, sum(n) OVER w AS vol, sum(n) OVER () AS whole FROM o LEFT JOIN x USING (_idx) WINDOW w AS (ORDER BY o._idx)),
    c AS (SELECT _idx, CASE WHEN least(vol, whole - vol) > 0 THEN cut::DOUBLE / least(vol, whole - vol)::DOUBLE ELSE 3.4028234663852886e38 END AS c FROM s),
    p AS (SELECT _idx AS last_ FROM c ORDER BY c, _idx LIMIT 1)
    SELECT o._idx, o.id FROM o, p WHERE o._idx <= p.last_"""
)
def pr_nibble(spark, d):
    return G.pr_nibble(*_met(spark, d), 0, iterations=8)


def _hits_sql(rounds: int) -> str:
    steps = ["h0 AS (SELECT id, 1.0::DOUBLE AS hub FROM v)"]
    for k in range(rounds):
        for new, old, a, b in ((f"a{k + 1}", f"h{k}", "src", "dst"), (f"h{k + 1}", f"a{k + 1}", "dst", "src")):
            x, y = ("authority", "hub") if new[0] == "a" else ("hub", "authority")
            steps.append(f"r{new} AS MATERIALIZED (SELECT v.id, coalesce(sum(o.{y}), 0)::DOUBLE AS x FROM v LEFT JOIN ed ON ed.{b} = v.id LEFT JOIN {old} o ON o.id = ed.{a} GROUP BY v.id)")
            steps.append(f"{new} AS MATERIALIZED (SELECT id, x / CASE WHEN s = 0 THEN 1 ELSE s END AS {x} FROM r{new}, (SELECT sqrt(sum(x * x)) AS s FROM r{new}))")
    return f"WITH {CS}, {', '.join(steps)} SELECT id, round(hub, 8) AS hub, round(authority, 8) AS authority FROM h{rounds} JOIN a{rounds} USING (id)"


@query(_hits_sql(3))
def hits(spark, d):
    return G.hits(*_met(spark, d), iterations=3).select("id", F.round("hub", 8).alias("hub"), F.round("authority", 8).alias("authority"))


@query(f"WITH {SS} SELECT count(*) AS triangles FROM ed x JOIN ed y ON x.dst = y.src JOIN ed z ON z.src = x.src AND z.dst = y.dst WHERE x.src < x.dst AND y.src < y.dst")
def triangle_count(spark, d):
    return G.triangle_count(_shared(spark, d)[0])


@query(f'WITH {SS} SELECT DISTINCT x.src AS "row", y.dst AS "column" FROM ed x JOIN ed y ON x.dst = y.src')
def spgemm(spark, d):
    edges, _ = _shared(spark, d)
    return G.spgemm(edges, edges)


@query(
    _unrolled_sql(
        CS, "SELECT id, (id % 17)::DOUBLE AS x, (id % 23)::DOUBLE AS y FROM v",
        "SELECT b.id, CASE WHEN b.id % 3 = 0 OR p.x IS NULL THEN b.x ELSE p.x END AS x, CASE WHEN b.id % 3 = 0 OR p.x IS NULL THEN b.y ELSE p.y END AS y "
        "FROM {b} b LEFT JOIN (SELECT ed.src, avg(o.x) AS x, avg(o.y) AS y FROM ed JOIN {b} o ON o.id = ed.dst GROUP BY ed.src) p ON p.src = b.id",
        3, "SELECT id, round(x, 9) AS x, round(y, 9) AS y FROM {b}",
    )
)
def geolocation(spark, d):
    """A third of the vertices is known; that is the feature's input."""
    edges, vertices = _met(spark, d)
    placed = vertices.select("id", (F.col("id") % 17).alias("x"), (F.col("id") % 23).alias("y"), (F.col("id") % 3 == 0).alias("known"))
    return G.geolocation(edges, placed, iterations=3).select("id", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


def _walk_sql(length: int, seed: int) -> str:
    """Walks by one CTE a step; the words by the hash of the position."""
    key, parts = pcg.key(seed), ["n AS (SELECT count(*) AS n FROM v)", "rws AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY edge_id) - 1 AS at FROM ed)",
                                 "w0 AS (SELECT walker, walker % n AS id FROM n, range((SELECT n FROM n)) t(walker))"]
    for k in range(1, length):
        parts.append(f"s{k} AS (SELECT walker, id, (xor(walker * {length - 1} + {k - 1}, {key}::BIGINT) * 747796405 + 2891336453) & 4294967295 AS st FROM w{k - 1})")
        parts.append(f"d{k} AS (SELECT walker, id, (xor(st >> ((st >> 28) + 4), st) * 277803737) & 4294967295 AS wd FROM s{k})")
        parts.append(
            f"w{k} AS MATERIALIZED (SELECT x.walker, coalesce(r.dst, 4294967295) AS id FROM d{k} x LEFT JOIN dg ON dg.id = x.id "
            f"LEFT JOIN rws r ON r.src = x.id AND dg.n > 0 AND r.at = xor(wd >> 22, wd) % CASE WHEN dg.n > 0 THEN dg.n ELSE 1 END)"
        )
    out = " UNION ALL ".join(f"SELECT walker::BIGINT AS walker, {k} AS step, id::BIGINT AS id FROM w{k}" for k in range(length))
    return f"WITH {SS}, {', '.join(parts)} {out}"


@query(_walk_sql(4, 11))
def random_walks(spark, d):
    return G.random_walks(*_shared(spark, d), length=4, per_vertex=1, seed=11)


@query(f"WITH {SS} SELECT x.src AS q0, x.dst AS q1, y.dst AS q2 FROM ed x JOIN ed y ON x.dst = y.src JOIN ed z ON z.src = y.dst AND z.dst = x.src WHERE x.src <> x.dst AND y.src <> y.dst AND x.src <> y.dst")
def subgraph_matching(spark, d):
    return G.subgraph_matching(*_shared(spark, d), [(0, 1), (1, 2), (2, 0)])


@query(
    _unrolled_sql(
        CS, "SELECT id, n AS core FROM dg",
        "SELECT b.id, coalesce(p.h, 0) AS core FROM {b} b LEFT JOIN (SELECT src, max(least(c, r)) AS h FROM (SELECT ed.src, x.core AS c, row_number() OVER (PARTITION BY ed.src ORDER BY x.core DESC) AS r FROM ed JOIN {b} x ON x.id = ed.dst) GROUP BY src) p ON p.src = b.id",
        40, "SELECT id, core::BIGINT AS core FROM {b}",
    )
)
def k_core(spark, d):
    return G.k_core(*_met(spark, d))


@query(
    f"""WITH RECURSIVE {SS}, r(t, s, v, d, p) AS (SELECT 0, id, id, 0, 1.0::DOUBLE FROM v UNION ALL
        SELECT t + 1, s, v, min(d), coalesce(max(p) FILTER (d <= t), sum(p)) FROM
        (SELECT t, s, v, d, p FROM r WHERE t < 12 UNION ALL SELECT t, s, ed.dst, t + 1, p FROM r JOIN ed ON ed.src = r.v WHERE t < 12 AND d = t) GROUP BY t, s, v),
    q AS MATERIALIZED (SELECT s, v, d, p FROM r WHERE t = 12),
    c AS (SELECT a.v AS id, sum(a.p * b.p / w.p) AS x FROM q a JOIN q b ON a.v = b.s JOIN q w ON w.s = a.s AND w.v = b.v AND w.d = a.d + b.d WHERE a.v <> a.s AND a.v <> b.v GROUP BY a.v)
    SELECT v.id, round(coalesce(x, 0), 6) AS betweenness FROM v LEFT JOIN c USING (id)"""
)
def betweenness(spark, d):
    return G.betweenness(*_shared(spark, d)).select("id", F.round("betweenness", 6).alias("betweenness"))


@query(
    f"""WITH RECURSIVE {SS}, u AS MATERIALIZED (SELECT least(src, dst) AS a, greatest(src, dst) AS b, min({{'w': w, 'edge_id': edge_id, 'src': src, 'dst': dst}}) AS e FROM ed GROUP BY ALL),
    n AS (SELECT count(*) AS n, list(id ORDER BY id) AS ids FROM v),
    r(t, seen, e) AS (SELECT 1, [ids[1]], NULL::STRUCT(w BIGINT, edge_id BIGINT, src BIGINT, dst BIGINT) FROM n UNION ALL
        SELECT t + 1, list_append(seen, CASE WHEN x IS NULL THEN list_min(list_filter(ids, lambda i: NOT list_contains(seen, i))) WHEN list_contains(seen, x.src) THEN x.dst ELSE x.src END), x
        FROM (SELECT r.t, r.seen, n.ids, (SELECT min(u.e) FROM u WHERE list_contains(r.seen, u.a) <> list_contains(r.seen, u.b)) AS x FROM r, n WHERE r.t < n.n))
    SELECT e.edge_id AS edge_id, e.src AS src, e.dst AS dst, e.w AS w FROM r WHERE e IS NOT NULL"""
)
def minimum_spanning_forest(spark, d):
    return G.minimum_spanning_forest(*_shared(spark, d))


@query(
    f"""WITH RECURSIVE {CS}, o AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY n DESC, id) AS k FROM dg),
    nb AS MATERIALIZED (SELECT a.k, list(b.k) AS before FROM ed JOIN o a ON a.id = ed.src JOIN o b ON b.id = ed.dst WHERE b.k < a.k GROUP BY a.k),
    r(k, cols) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT k, list_append(cols, list_min(list_filter(range(len(used) + 1), lambda c: NOT list_contains(used, c)))) FROM
        (SELECT o.k, r.cols, coalesce(list_distinct(list_transform(nb.before, lambda j: r.cols[j])), []) AS used FROM r JOIN o ON o.k = r.k + 1 LEFT JOIN nb ON nb.k = o.k))
    SELECT o.id, z.cols[o.k] AS color FROM o, (SELECT cols FROM r WHERE k = (SELECT count(*) FROM o)) z"""
)
def coloring(spark, d):
    return G.coloring(*_met(spark, d))


@query()
def louvain(spark, d):
    return G.louvain(*_shared(spark, d))
