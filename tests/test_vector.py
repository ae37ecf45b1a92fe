"""Sequence operations against plain Python, at lengths around block edges and with small blocks."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from seqloom import operators as op
from seqloom.errors import InvalidArgumentError, LengthMismatchError, OutputTooShortError
from seqloom.functions import monoids as M
from seqloom.functions import pcg
from seqloom.plans.order import IDX, reindex, with_index
from seqloom.sources.generate import constant, counting, from_values, stride, to_values

BLOCK = 8
LENGTHS = [0, 1, 2, 7, 8, 9, 31, 33]


def numbers(n, seed=0, top=10):
    r = random.Random(seed * 1000 + n)
    return [r.randrange(top) for _ in range(n)]


def seq(spark, xs, schema="v long"):
    return from_values(spark, xs, schema)


def one(df):
    return df.first()[0]


@pytest.mark.parametrize("n", LENGTHS)
def test_scans(spark, n):
    xs = numbers(n)
    s = seq(spark, xs)
    got = to_values(op.inclusive_scan(s, F.col("v"), M.add, block=BLOCK).select(IDX, "scan"))
    assert got == list(itertools.accumulate(xs))
    got = to_values(op.exclusive_scan(s, F.col("v"), M.add, 5, block=BLOCK).select(IDX, "scan"))
    assert got == list(itertools.accumulate(xs, initial=5))[:n]
    got = to_values(op.inclusive_scan(s, F.col("v"), M.maximum, block=BLOCK).select(IDX, "scan"))
    assert got == list(itertools.accumulate(xs, max))
    got = to_values(op.adjacent_difference(s, "v", lambda p, c: p * 3 - c, block=BLOCK).select(IDX, "difference"))
    assert got == xs[:1] + [a * 3 - b for a, b in zip(xs, xs[1:])]


@pytest.mark.parametrize("n,top", [(n, t) for n in LENGTHS for t in (1, 2)] + [(100, 2), (64, 1)])
def test_runs(spark, n, top):
    ks, xs = numbers(n, 1, top), numbers(n, 2)
    s = seq(spark, list(zip(ks, xs)), "k long, v long")
    runs = [[x for _, x in g] for _, g in itertools.groupby(zip(ks, xs), key=lambda p: p[0])]
    keys = [k for k, _ in itertools.groupby(ks)]
    got = to_values(op.reduce_by_key(s, ["k"], F.col("v"), M.add, init=2, block=BLOCK))
    assert got == [(k, 2 + sum(r)) for k, r in zip(keys, runs)]
    got = to_values(op.inclusive_scan_by_key(s, ["k"], F.col("v"), M.add, block=BLOCK).select(IDX, "scan"))
    assert got == [x for r in runs for x in itertools.accumulate(r)]
    got = to_values(op.exclusive_scan_by_key(s, ["k"], F.col("v"), M.add, 7, block=BLOCK).select(IDX, "scan"))
    assert got == [x for r in runs for x in list(itertools.accumulate(r, initial=7))[:-1]]
    assert to_values(op.unique(s.select(IDX, "k"), block=BLOCK)) == keys
    assert to_values(op.unique_by_key(s, ["k"], block=BLOCK)) == [r[0] for r in runs]


@pytest.mark.parametrize("n", [0, 1, 5, 40])
def test_any_operation(spark, n):
    xs, ks = numbers(n, 9), numbers(n, 10, 2)
    # composing x -> a * x + b, which is associative but not commutative
    pair = F.struct((F.col("v") % 3 + 1).alias("a"), F.col("v").alias("b"))
    both = lambda f, g: F.struct((f["a"] * g["a"] % 97).alias("a"), ((f["b"] * g["a"] + g["b"]) % 97).alias("b"))

    def compose(rows):
        out = []
        for x in rows:
            a, b = x % 3 + 1, x
            if out:
                p, q = out[-1]
                a, b = p * a % 97, (q * a + b) % 97
            out.append((a, b))
        return out

    s = seq(spark, list(zip(ks, xs)), "k long, v long")
    got = to_values(op.scan_with(s, pair, both, block=3, levels=2).select(IDX, "scan.a", "scan.b"))
    assert got == compose(xs)
    got = to_values(op.scan_by_key_with(s, ["k"], pair, both, block=3).select(IDX, "scan.a", "scan.b"))
    assert got == [y for _, g in itertools.groupby(zip(ks, xs), key=lambda p: p[0]) for y in compose([x for _, x in g])]


@pytest.mark.parametrize("n", [0, 1, 9, 33])
def test_selection(spark, n):
    xs = numbers(n, 3)
    s, odd = seq(spark, xs), F.col("v") % 2 == 1
    yes, no = [x for x in xs if x % 2], [x for x in xs if not x % 2]
    assert to_values(op.copy_where(s, odd)) == yes
    assert to_values(op.remove_where(s, odd)) == no
    got = to_values(op.partition(s, odd))
    assert [v for v, _ in got] == yes + no and all(b == len(yes) for _, b in got)
    assert one(op.count_if(s, odd)) == len(yes)
    assert one(op.all_of(s, odd)) == all(x % 2 for x in xs)
    assert one(op.any_of(s, odd)) == any(x % 2 for x in xs)
    assert one(op.none_of(s, odd)) == (not yes)
    assert one(op.find_if(s, odd)) == next((i for i, x in enumerate(xs) if x % 2), None)
    flags = [bool(x % 2) for x in xs]
    assert one(op.is_partitioned(s, odd)) == (flags == sorted(flags, reverse=True))
    sparse = s.filter(odd)
    assert to_values(reindex(sparse, 4)) == yes


@pytest.mark.parametrize("n", [0, 1, 2, 33])
def test_reductions(spark, n):
    xs, ys = numbers(n, 4), numbers(max(0, n - 1), 4)
    s = seq(spark, xs)
    assert one(op.reduce(s, F.col("v"), M.add, init=3)) == 3 + sum(xs)
    assert one(op.reduce_with(s, F.col("v"), lambda a, b: a + b, F.lit(3).cast("long"), block=4)) == 3 + sum(xs)
    assert one(op.min_element(s, "v")) == (xs.index(min(xs)) if xs else None)
    assert one(op.max_element(s, "v")) == (xs.index(max(xs)) if xs else None)
    both = op.minmax_element(s, "v").first()
    assert tuple(both) == ((n - 1 - xs[::-1].index(min(xs)), xs.index(max(xs))) if xs else (None, None))
    t = seq(spark, ys)
    assert one(op.equal(s, t)) == (xs == ys)
    diff = next((i for i, (a, b) in enumerate(zip(xs, ys)) if a != b), None if len(xs) == len(ys) else min(len(xs), len(ys)))
    assert one(op.mismatch(s, t)) == diff
    assert one(op.lexicographical_compare(s, t)) == (xs < ys)
    assert one(op.lexicographical_compare(t, s)) == (ys < xs)
    assert one(op.adjacent_find(s, lambda a, b: a == b, "v", block=BLOCK)) == next((i for i in range(n - 1) if xs[i] == xs[i + 1]), None)
    assert one(op.is_sorted(s, "v", block=BLOCK)) == (xs == sorted(xs))
    assert one(op.is_sorted_until(s, "v", block=BLOCK)) == next((i for i in range(1, n) if xs[i] < xs[i - 1]), n)


def test_order(spark):
    xs, ys = sorted(numbers(40, 5)), sorted(numbers(31, 6))
    pairs = list(enumerate(numbers(40, 7)))
    got = to_values(op.sort(seq(spark, [(k, i) for i, k in pairs], "k long, i long"), F.desc("k")))
    assert got == [(k, i) for i, k in sorted(pairs, key=lambda p: -p[1])]
    assert to_values(op.sort_by_key(seq(spark, [(k, i) for i, k in pairs], "k long, i long"), F.asc("k"), keys=["k"])) == [i for i, k in sorted(pairs, key=lambda p: p[1])]
    a, b = seq(spark, [(x, 0) for x in xs], "k long, s int"), seq(spark, [(y, 1) for y in ys], "k long, s int")
    assert to_values(op.merge(a, b, F.asc("k"))) == sorted([(x, 0) for x in xs] + [(y, 1) for y in ys])
    assert to_values(op.merge_by_key(a, b, F.asc("k"), keys=["k"])) == [s for _, s in sorted([(x, 0) for x in xs] + [(y, 1) for y in ys])]
    left, right = seq(spark, xs, "k long"), seq(spark, ys, "k long")
    count = lambda zs, k: sum(z == k for z in zs)
    for f, rule in ((op.set_union, max), (op.set_intersection, min), (op.set_difference, lambda m, n: max(m - n, 0))):
        assert to_values(f(left, right)) == [k for k in range(10) for _ in range(rule(count(xs, k), count(ys, k)))]
    probe = seq(spark, numbers(20, 8, 12), "k long")
    import bisect

    want = numbers(20, 8, 12)
    assert [b for _, b in to_values(op.lower_bound(left, probe, "k", block=BLOCK))] == [bisect.bisect_left(xs, q) for q in want]
    assert [b for _, b in to_values(op.upper_bound(left, probe, "k", block=BLOCK))] == [bisect.bisect_right(xs, q) for q in want]


def test_float_order(spark):
    nan, inf = float("nan"), float("inf")
    xs = [0.0, -0.0, nan, -inf, 1.5, inf, -1.5]
    got = to_values(op.radix_sort_by_key(seq(spark, [(x, i) for i, x in enumerate(xs)], "k double, i long"), ["k"]))
    assert got == [3, 6, 1, 0, 4, 5, 2]


def test_set_payload(spark):
    a = seq(spark, [(1, "a"), (1, "b"), (2, "c")], "k long, p string")
    b = seq(spark, [(1, "x"), (2, "y"), (2, "z")], "k long, p string")
    assert to_values(op.set_union(a, b, "k")) == [(1, "a"), (1, "b"), (2, "c"), (2, "z")]
    assert to_values(op.set_intersection(a, b, "k")) == [(1, "a"), (2, "c")]
    assert to_values(op.set_difference(a, b, "k")) == [(1, "b")]


def test_movement(spark):
    vals = seq(spark, [10, 11, 12, 13], "v long")
    idx = seq(spark, [3, 0, 0, 2], "index long")
    assert to_values(op.gather(vals, idx)) == [13, 10, 10, 12]
    dest = seq(spark, [1, 2, 3, 4, 5], "v long")
    assert to_values(op.gather_where(vals, idx, F.col("index") > 0, dest)) == [13, 2, 3, 12, 5]
    with pytest.raises(OutputTooShortError):
        op.gather_where(vals, idx, F.lit(True), seq(spark, [1], "v long"), validate=True)
    moves = seq(spark, [(7, 1), (8, 3), (9, 1)], "v long, index long")
    assert to_values(op.scatter(moves, dest)) == [1, 9, 3, 8, 5]
    assert to_values(op.scatter_where(moves, F.col("v") < 9, dest)) == [1, 7, 3, 8, 5]
    assert to_values(op.scatter_reduce(moves, dest, "v", M.add)) == [1, 18, 3, 12, 5]
    # a permutation scattered and gathered back
    perm = seq(spark, [(10, 2), (11, 0), (12, 3), (13, 1)], "v long, index long")
    there = op.scatter(perm, seq(spark, [0] * 4, "v long"))
    assert to_values(op.gather(there, perm.select(IDX, "index"))) == [10, 11, 12, 13]
    assert one(op.find_first_of(vals, seq(spark, [12, 13], "v long"), "v")) == 2
    assert one(op.find_first_of(vals, seq(spark, [50], "v long"), "v")) is None
    assert one(op.find_first_of(vals, seq(spark, [5], "v long"), "v", lambda a, b: a % b == 1)) == 1


def test_maps(spark):
    s = seq(spark, [2, 0, 1, 3], "v long")
    assert to_values(op.map_rows(s, w=F.col("v") + 1)) == [3, 1, 2, 4]
    assert to_values(op.flat_map(s, F.col("v"), lambda i: F.col("v") * 10 + i)) == [20, 21, 10, 30, 31, 32]
    assert to_values(op.reverse(s)) == [3, 1, 0, 2]
    assert to_values(op.slice_rows(s, 1, 3)) == [0, 1]
    assert to_values(op.fill(s, v=9)) == [9] * 4
    assert to_values(op.replace_where(s, F.col("v") > 1, v=-1)) == [-1, 0, 1, -1]
    assert to_values(op.transform_where(s, F.col("v") > 1, v=F.col("v") * 2)) == [4, 0, 1, 6]
    assert to_values(op.copy(seq(spark, [8, 9], "x long"), s)) == [8, 9, 1, 3]
    assert to_values(op.zip_rows(s, seq(spark, [5, 6, 7, 8], "w long"))) == [(2, 5), (0, 6), (1, 7), (3, 8)]
    with pytest.raises(LengthMismatchError):
        op.zip_rows(s, seq(spark, [1], "w long"), validate=True)
    wide = op.with_table(s, seq(spark, [100, 200, 300, 400], "t long"), "ts").select(IDX, F.expr("ts[int(v)].t").alias("x"))
    assert to_values(wide) == [300, 100, 200, 400]
    with pytest.raises(InvalidArgumentError):
        op.with_table(s, s, "ts", limit=3)


def test_sources(spark):
    assert to_values(constant(spark, 4, 3)) == [4] * 3
    assert to_values(counting(spark, 5, 3)) == [5, 6, 7]
    assert to_values(stride(spark, 5, -2, 3)) == [5, 3, 1]
    assert to_values(with_index(spark.createDataFrame([(3,), (1,), (2,)], "v long"), "v")) == [1, 2, 3]
    assert to_values(with_index(spark.createDataFrame([], "v long"), "v")) == []


def test_random_numbers(spark):
    n, seed = 300, 0x1234567890ABCDEF
    rows = spark.range(n)
    low, high = ([pcg.pcg_int((i ^ pcg.key(seed) ^ s) & pcg.MASK) for i in range(n)] for s in (0, pcg.SECOND))
    take = lambda c: [r[0] for r in rows.orderBy("id").select(c).collect()]
    assert take(pcg.uniform_u32(F.col("id"), 5, 14, seed)) == [5 + x % 10 for x in low]
    assert take(pcg.uniform_u32(F.col("id"), 0, pcg.MASK, seed)) == low
    assert [int(x) for x in take(pcg.uniform_u64(F.col("id"), 0, (1 << 64) - 1, seed))] == [a | b << 32 for a, b in zip(low, high)]
    assert [int(x) for x in take(pcg.uniform_u64(F.col("id"), 7, 10**18, seed))] == [7 + (a | b << 32) % (10**18 - 6) for a, b in zip(low, high)]
    assert take(pcg.uniform_f32(F.col("id"), 0.0, 1.0, seed)) == [(a >> 8) * 2.0**-24 for a in low]
    assert take(pcg.uniform_f64(F.col("id"), 0.0, 1.0, seed)) == [((a | b << 32) >> 11) * 2.0**-53 for a, b in zip(low, high)]
    big = spark.range(20_000).agg(F.avg(pcg.normal_f64(F.col("id"), 3.0, 2.0, 9)).alias("m"), F.stddev(pcg.normal_f64(F.col("id"), 3.0, 2.0, 9)).alias("s")).first()
    assert abs(big.m - 3) < 0.06 and abs(big.s - 2) < 0.06
    with pytest.raises(InvalidArgumentError):
        pcg.uniform_u32(F.col("id"), 3, 2, seed)


def test_find_first_of_same_asks_each_key_once(spark):
    """Repeated keys don't add jobs or tests, and nulls reach the test."""
    vals = seq(spark, [None, 7, 8, 7, 9], "v long")
    spark.sparkContext.setJobGroup("find-first", "")
    got = one(op.find_first_of(vals, seq(spark, [10, 12, 10, 12, 6] * 40, "v long"), "v", lambda a, b: F.abs(a - b) < 2, at_once=1))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("find-first"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == 1 and jobs < 30
    assert one(op.find_first_of(vals, seq(spark, [None], "v long"), "v", lambda a, b: a.eqNullSafe(b))) == 0
    assert one(op.find_first_of(vals, seq(spark, [], "v long"), "v", lambda a, b: a == b)) is None
