"""Traversals and graph algorithms against sequential versions and fixed results."""

import random
from collections import deque
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from seqloom.functions import monoids as M
from seqloom.functions import pcg
from seqloom.graph import algorithms as G
from seqloom.graph import traversal as T
from seqloom.plans.order import IDX
from seqloom.plans.skew import join_unique
from seqloom.sources.generate import from_values, to_values


def graph(spark, offsets, neighbours, weights=None):
    rows, w = [], weights or [1] * len(neighbours)
    for s, (a, b) in enumerate(zip(offsets, offsets[1:])):
        rows += [(e, s, neighbours[e], w[e]) for e in range(a, b)]
    return spark.createDataFrame(rows, "edge_id long, src long, dst long, w long"), spark.range(len(offsets) - 1)


def both_ways(pairs, n, weight=lambda a, b: 1):
    """offsets, neighbours and weights of an undirected graph."""
    near = {v: sorted([b for a, b in pairs if a == v] + [a for a, b in pairs if b == v]) for v in range(n)}
    offsets = [0]
    for v in range(n):
        offsets.append(offsets[-1] + len(near[v]))
    flat = [(v, b) for v in range(n) for b in near[v]]
    return offsets, [b for _, b in flat], [weight(min(x), max(x)) for x in flat]


#: a ring of five with a tail of two; two cliques of four joined by an edge
RING = [(0, 1), (1, 2), (2, 3), (3, 4), (0, 4), (4, 5), (5, 6)]
CLIQUES = [(a, b) for k in (0, 4) for a in range(k, k + 4) for b in range(a + 1, k + 4)] + [(3, 4)]


def column(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


def test_traversal(spark):
    edges, vertices = graph(spark, [0, 2, 3, 5], [1, 2, 2, 0, 1], [10, 20, 30, 40, 50])
    f = from_values(spark, [2, 0], "v long")
    t = T.traverse(edges, f)
    assert to_values(T.emit(t, d=F.col("dst"))) == [0, 1, 1, 2]
    assert [r[2] for r in T.reduce_by_source(t, f, F.col("w"), M.add, 0).orderBy(IDX).collect()] == [90, 30]
    values = vertices.withColumn("val", (F.col("id") + 1) * 100)
    near = T.source(t, values, "val")
    got = column(T.reduce_by_destination(near, vertices, F.col("source_val"), M.add, 0), "reduced")
    assert got == [300, 400, 100]
    # duplicates and vertices without edges keep their places
    f = from_values(spark, [1, 1, 0], "v long")
    t = T.traverse(edges, f)
    assert [r[2] for r in T.reduce_by_source(t, f, F.lit(1).cast("long"), M.add, 0).orderBy(IDX).collect()] == [1, 1, 2]
    assert to_values(T.emit(T.traverse(edges, f, max_edges=3), d=F.col("dst"))) == [2, 2, 1]
    state = vertices.withColumn("s", F.lit(15).cast("long"))
    assert column(T.update_by_destination(t, state, F.col("w"), M.add, "s"), "s") == [15, 25, 95]
    new, lowered = T.relax_min_by_destination(t, state, F.col("w"), "s")
    assert column(new, "s") == [15, 10, 15] and column(lowered, "id") == [1]
    empty = T.traverse(edges, from_values(spark, [], "v long"))
    assert empty.count() == 0
    pairs = from_values(spark, [(0, 1), (0, 0), (1, 2)], "a long, b long")
    assert [r.common for r in T.intersect_count(edges, pairs).orderBy(IDX).collect()] == [1, 2, 0]


def test_small_graphs(spark):
    ring = graph(spark, *both_ways(RING, 7, lambda a, b: a + b))
    cliques = graph(spark, *both_ways(CLIQUES, 8))
    assert column(G.bfs(*ring, 0), "level") == [0, 1, 2, 2, 1, 2, 3]
    assert column(G.sssp(*ring, 0), "distance") == [0, 1, 4, 9, 4, 13, 24]
    apart = graph(spark, *both_ways([(0, 2), (1, 4)], 6))
    assert column(G.cc(*apart), "component") == [0, 1, 0, 3, 1, 5]
    assert G.triangle_count(cliques[0]).first()[0] == 8 and G.triangle_count(ring[0]).first()[0] == 0
    x = ring[1].withColumn("x", F.col("id") * 10)
    assert column(G.spmv(ring[0], x, "w", "x"), "y") == [4 * 40 + 10, 3 * 20, 3 * 10 + 5 * 30, 5 * 20 + 7 * 40, 7 * 30 + 9 * 50, 9 * 40 + 11 * 60, 11 * 50]
    assert column(G.k_core(*ring), "core") == [2, 2, 2, 2, 2, 1, 1] and column(G.k_core(*cliques), "core") == [3] * 8
    curved = G.forman_ricci(*cliques)
    assert sorted(r.curvature for r in curved.collect()) == [-4] * 2 + [-3] * 12 + [-2] * 12
    ends = {(a, b) for a, b in RING} | {(b, a) for a, b in RING}
    assert sorted(map(tuple, G.spgemm(ring[0], ring[0]).collect())) == sorted({(a, d) for a, b in ends for c, d in ends if b == c})
    words = spark.range(14).select(F.col("id").alias("position"), F.lit(1).cast("long").alias("word"))
    walks = G.random_walks(*ring, length=3, per_vertex=1, seed=0, words=words).orderBy("walker", "step").collect()
    second = [sorted(b for a, b in ends if a == v) for v in range(7)]
    step = [near[1 % len(near)] for near in second]
    assert [r.id for r in walks] == [x for v in range(7) for x in (v, step[v], step[step[v]])]
    assert G.subgraph_matching(*cliques, [(0, 1), (1, 2), (2, 0)]).count() == 6 * 8
    assert column(G.louvain(*cliques), "community") == [0] * 4 + [1] * 4
    assert sorted(to_values(G.pr_nibble(*cliques, 0, 0.85, 30))) == [0, 1, 2, 3]
    forest = G.minimum_spanning_forest(*ring).collect()
    assert len(forest) == 6 and sum(r.w for r in forest) == sum(a + b for a, b in RING) - 7
    assert abs(sum(column(G.personalised_pagerank(*ring, 0), "rank")) - 1) < 1e-9


def modularity(rows, community):
    twice = sum(1 for _ in rows)
    out = 0.0
    for c in set(community):
        inner = sum(community[a] == c == community[b] for _, a, b, _ in rows)
        total = sum(community[a] == c for _, a, _, _ in rows)
        out += inner / twice - (total / twice) ** 2
    return out


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_louvain_leaves_no_gain(spark, seed):
    """No vertex gains by moving alone, no two communities gain by joining, and modularity is that of a sequential run or nearly so."""
    n, rows = random_graph(seed, n=14, p=0.25)
    edges, vertices = spark.createDataFrame(rows, "edge_id long, src long, dst long, w long"), spark.range(n)
    got = column(G.louvain(edges, vertices), "community")
    assert sorted(set(got)) == list(range(len(set(got))))
    here = modularity(rows, got)
    for a in set(got):
        for b in set(got) - {a}:
            assert modularity(rows, [b if c == a else c for c in got]) <= here + 1e-9
    best = list(range(n))
    while True:  # one vertex at a time, from the start
        moves = [(modularity(rows, [*best[:v], c, *best[v + 1 :]]), v, c) for v in range(n) for c in set(best)]
        top = max(moves)
        if top[0] <= modularity(rows, best) + 1e-9:
            break
        best[top[1]] = top[2]
    assert here >= modularity(rows, best) - 0.05


def test_hubs(spark):
    """A hub with the smallest id, and one whose rows are looked up by broadcast."""
    n = 400
    pairs = [(0, b) for b in range(1, n)] + [(b, b + 1) for b in range(1, n - 1, 2)]
    edges, vertices = graph(spark, *both_ways(pairs, n))
    assert G.triangle_count(edges).first()[0] == (n - 1) // 2
    assert column(G.cc(edges, vertices), "component") == [0] * n
    rows = spark.range(300_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    table = spark.range(100_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        a, b = join_unique(rows, "k", table, how, share=10), rows.join(table, "k", how)
        assert a.exceptAll(b).isEmpty() and a.count() == b.count()


def random_graph(seed, n=9, p=0.3):
    r = random.Random(seed)
    und = {(a, b): r.randrange(1, 9) for a in range(n) for b in range(a + 1, n) if r.random() < p}
    rows = sorted([(a, b, w) for (a, b), w in und.items()] + [(b, a, w) for (a, b), w in und.items()])
    return n, [(i, a, b, w) for i, (a, b, w) in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    n, rows = random_graph(seed)
    edges, vertices = spark.createDataFrame(rows, "edge_id long, src long, dst long, w long"), spark.range(n)
    out = {v: [(b, w) for _, a, b, w in rows if a == v] for v in range(n)}
    adj = {v: [b for b, _ in out[v]] for v in out}

    level = {0: 0}
    queue = deque([0])
    while queue:
        v = queue.popleft()
        for b in adj[v]:
            if b not in level:
                level[b] = level[v] + 1
                queue.append(b)
    assert column(G.bfs(edges, vertices, 0), "level") == [level.get(v, G.UNREACHED) for v in range(n)]

    dist = {v: G.INFINITE for v in range(n)} | {0: 0}
    for _ in range(n):
        for _, a, b, w in rows:
            dist[b] = min(dist[b], dist[a] + w, G.INFINITE)
    assert column(G.sssp(edges, vertices, 0), "distance") == [dist[v] for v in range(n)]

    core, left, k = {}, set(range(n)), 0
    while left:
        v = min(left, key=lambda x: (sum(b in left for b in adj[x]), x))
        k = max(k, sum(b in left for b in adj[v]))
        core[v] = k
        left.remove(v)
    assert column(G.k_core(edges, vertices), "core") == [core[v] for v in range(n)]

    color = {}
    for v in sorted(range(n), key=lambda x: (-len(adj[x]), x)):
        color[v] = next(c for c in range(n) if all(color.get(b) != c for b in adj[v]))
    assert column(G.coloring(edges, vertices), "color") == [color[v] for v in range(n)]

    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    tree = []
    for e, a, b, w in sorted(rows, key=lambda r: (r[3], r[0])):
        if find(a) != find(b):
            up[find(a)] = find(b)
            tree.append((e, a, b, w))
    assert sorted(map(tuple, G.minimum_spanning_forest(edges, vertices).collect())) == sorted(tree)

    between = [0.0] * n
    for s in range(n):
        order, depth, paths, preds, queue = [], {s: 0}, {s: 1}, {v: [] for v in range(n)}, deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for b in adj[v]:
                if b not in depth:
                    depth[b], paths[b] = depth[v] + 1, 0
                    queue.append(b)
                if depth[b] == depth[v] + 1:
                    paths[b] += paths[v]
                    preds[b].append(v)
        share = dict.fromkeys(range(n), 0.0)
        for b in reversed(order):
            for v in preds[b]:
                share[v] += paths[v] / paths[b] * (1 + share[b])
            if b != s:
                between[b] += share[b]
    for pairs in (50_000_000, 4 * n):
        assert column(G.betweenness(edges, vertices, pairs), "betweenness") == pytest.approx(between)
    triples = sum((a, b) in {(x, y) for _, x, y, _ in rows} and (b, c) in {(x, y) for _, x, y, _ in rows} and (a, c) in {(x, y) for _, x, y, _ in rows} for a in range(n) for b in range(a) for c in range(b))
    assert G.triangle_count(edges).first()[0] == triples

    rank, deg = [1 / n] * n, [len(adj[v]) for v in range(n)]
    for _ in range(5):
        lost = sum(x for x, d in zip(rank, deg) if not d)
        rank = [0.15 / n + 0.85 * lost / n + 0.85 * sum(rank[a] / deg[a] for a in adj[v]) for v in range(n)]
    assert column(G.pagerank(edges, vertices, 0.85, 5), "rank") == pytest.approx(rank)

    links = {(a, b) for _, a, b, _ in rows}
    want = sorted(p for p in permutations(range(n), 4) if (p[0], p[1]) in links and (p[1], p[2]) in links and (p[1], p[3]) in links)
    assert sorted(map(tuple, G.subgraph_matching(edges, vertices, [(0, 1), (1, 2), (1, 3)]).collect())) == want

    walks = {(r.walker, r.step): r.id for r in G.random_walks(edges, vertices, length=4, per_vertex=2, seed=9).collect()}
    for w in range(2 * n):
        v = w % n
        for step in range(4):
            assert walks[w, step] == v
            word = pcg.pcg_int(((w * 3 + step) ^ pcg.key(9)) & pcg.MASK)
            v = adj[v][word % len(adj[v])] if v != G.UNREACHED and adj[v] else G.UNREACHED


def test_no_edges(spark):
    edges, vertices = spark.createDataFrame([], "edge_id long, src long, dst long, w long"), spark.range(3)
    assert column(G.cc(edges, vertices), "component") == [0, 1, 2]
    assert column(G.k_core(edges, vertices), "core") == [0, 0, 0]
    assert column(G.coloring(edges, vertices), "color") == [0, 0, 0]
    assert column(G.betweenness(edges, vertices), "betweenness") == [0, 0, 0]
    assert G.minimum_spanning_forest(edges, vertices).count() == 0
    assert column(G.pagerank(edges, vertices), "rank") == pytest.approx([1 / 3] * 3)
    assert column(G.louvain(edges, vertices), "community") == [0, 1, 2]
    assert [r.id for r in G.pr_nibble(edges, vertices, 1).collect()] == [1]
    assert column(G.hits(edges, vertices, 2), "hub") == [0, 0, 0]
    geo = vertices.select("id", F.col("id").alias("x"), F.col("id").alias("y"), F.lit(False).alias("known"))
    assert column(G.geolocation(edges, geo, 2), "x") == [0, 1, 2]
