"""The n-gram Jaccard join against brute force over all pairs."""

import random
import re
import tracemalloc
from itertools import combinations

import numpy as np
import pytest

from seqloom.llm import common, components, jaccard
from seqloom.llm.shingles import shingle_sets


def shingles(text):
    lower = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(data):
    sets = {d: shingles(t) for d, t in data}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            if x != y:
                up[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def near_copies(seed=3, groups=5, each=40):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.choice([6, 8, 9, 12, 20, 60, 200]))]
        for _ in range(each):
            t = base[:]
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                t[r.randrange(len(t))] = r.choice(vocabulary)
            out.append(" ".join(t + [r.choice(vocabulary) for _ in range(r.choice([0, 0, 1, 3]))]))
    return list(enumerate(out + ["", "a b", "A  b", "one two three four five"]))


def test_shingles(rows):
    texts = [(t or "") for _, t in rows] + ["", " ", "a", "A b\tc\nd e", "a b c d e f a b c d e f", "é É ß"]
    got = shingle_sets([t.encode() for t in texts])
    assert [len(s) for s in got] == [len(shingles(t)) for t in texts]
    assert (shingle_sets([b"A b c d E"])[0] == shingle_sets([b" a  b c\nd e "])[0]).all()


def test_keys_meet():
    """Any two sets that meet the threshold share a key, whatever the boundary."""
    r = np.random.default_rng(0)
    for boundary in (0, 8, 30):
        for _ in range(300):
            n = int(r.integers(4, 60))
            a = np.unique(r.integers(0, 1 << 62, n, dtype=np.uint64) & ~np.uint64(1))
            keep = a[r.random(len(a)) > 0.1]
            b = np.unique(np.concatenate([keep, r.integers(0, 1 << 62, int(r.integers(0, 4)), dtype=np.uint64) & ~np.uint64(1)]))
            both = len(np.intersect1d(a, b))
            if both * 100 >= 80 * (len(a) + len(b) - both) and len(a) != both or len(b) != both:
                if both * 100 < 80 * (len(a) + len(b) - both):
                    continue
                counts = lambda s: (s % np.uint64(7)).astype(np.int64)
                assert len(np.intersect1d(jaccard.set_keys(a, counts(a), boundary), jaccard.set_keys(b, counts(b), boundary)))


def test_bits_never_lose():
    r = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(r.integers(0, 1 << 62, int(r.integers(1, 300)), dtype=np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) > r.random() * 0.3], r.integers(0, 1 << 62, int(r.integers(0, 40)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if both * 100 >= 80 * (len(a) + len(b) - both):
            assert jaccard.may_link(jaccard.parity_bits(a), len(a), jaccard.parity_bits(b), len(b))


def test_boundary_follows_cost():
    sizes = {n: 10 for n in range(4, 200)}
    assert jaccard.choose_boundary(sizes, 1.0) <= jaccard.choose_boundary(sizes, 5.0) <= jaccard.choose_boundary(sizes, 50.0)


def test_levels_keep_the_order_and_cost():
    counts = np.sort(np.random.default_rng(2).zipf(1.4, 100_000).clip(0, (1 << 32) - 1) - 1)
    levels = jaccard.count_levels(counts)
    assert (np.diff(levels.astype(int)) >= 0).all() and len(np.unique(jaccard.count_levels(np.arange(14)))) == 14
    small = np.minimum(counts, 13)
    rare = small[: np.searchsorted(np.cumsum(small), 0.2 * small.sum())]
    want = np.maximum(rare - np.median(small), 0).mean()
    assert jaccard.list_length(np.bincount(jaccard.count_levels(small), minlength=256), 0.2) == pytest.approx(want, rel=0.1, abs=0.05)
    assert jaccard.list_length(np.eye(256, dtype=np.int64)[0] * 9, 0.2) == 0


def test_driver_holds_little(spark):
    """The sketch reaches the driver as a byte a counter, and the filter not as rows."""
    docs = spark.createDataFrame([(2 * i + j, " ".join(f"w{i}x{k}" for k in range(30 + j))) for i in range(3000) for j in (0, 1)], "doc_id long, text string").repartition(4)
    tracemalloc.start()
    try:
        found = jaccard.similar_groups(docs)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 20 << 20
    assert found.filter("component_id = doc_id").count() == 3000


def test_release_gives_memory_back(spark):
    assert "rim" in common._trim_jvm(spark)
    common.release(spark)


@pytest.mark.parametrize("short,task", [(32, 4_000_000), (2, 500)])
def test_groups(spark, monkeypatch, short, task):
    monkeypatch.setattr(jaccard, "SHORT_LIST", short)
    monkeypatch.setattr(jaccard, "TASK_SHINGLES", task)
    data = near_copies()
    got = jaccard.similar_groups(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(data)


@pytest.mark.parametrize("task", [4_000_000, 500])
def test_every_link_counts(spark, monkeypatch, task):
    monkeypatch.setattr(jaccard, "TASK_SHINGLES", task)
    data = near_copies()
    sets = {d: set(shingles(t)) for d, t in data}
    want = {d: sum(e != d and len(s) > 0 and len(s & u) * 100 >= 80 * len(s | u) for e, u in sets.items()) for d, s in sets.items()}
    assert max(want.values()) > 2
    got = jaccard.similar_groups(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_links for r in got} == want


def test_whole_table(documents, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(documents).collect()}
    assert got == brute(rows)


def test_odd(odd, nothing):
    df, data = odd
    got = jaccard.similar_groups(df).collect()
    assert sorted((r.doc_id or -1, r.n_shingles) for r in got) == sorted((d or -1, len(shingles(t))) for d, t in data)
    assert {r.component_id for r in got if r.doc_id in (6, 7) and r.n_shingles} <= {6, 7}
    assert jaccard.similar_groups(nothing).count() == 0


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(r.randrange(100, 400), r.randrange(100, 400)) for _ in range(250)] + [(5, 5)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
