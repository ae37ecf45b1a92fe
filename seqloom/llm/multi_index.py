"""Embedding near-dedup with an inverted multi-index.

Two codebooks, one for each half of the vectors, form a grid of cells.  Every vector stands in its
nearest cell and visits the cells nearest to it, in the order of a multi-sequence traversal, until the
share of neighbours at the threshold that it would meet reaches the target; each pair that meets is
verified by its cosine in double precision.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, release, unique_ids
from .components import EDGE_DDL, Forest, connected_components

#: Rows the codebooks are fitted on at most, and neighbours that the number of visits is set by.
SAMPLE, PROBES = 20_000, 2_000
#: Vectors a cell holds on average, codewords of a half at most, and rows that stand in, or visit, one block of a cell.
CELL_ROWS, MOST_WORDS, BLOCK_ROWS, VISIT_ROWS = 64, 4096, 4096, 16_384
TARGET = 0.97


def fit_codebook(half: np.ndarray, words: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """k-means by Lloyd's rounds; a word without vectors keeps its place."""
    rng = np.random.default_rng(seed)
    book = half[rng.choice(len(half), min(words, len(half)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(half, book).argmin(1)
        sums = np.zeros_like(book)
        np.add.at(sums, near, half)
        counts = np.bincount(near, minlength=len(book))
        book[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return book


def nearest(half: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances to the words, less the vectors' own squares."""
    return (book * book).sum(1) - 2 * half @ book.T


def traverse(d1: np.ndarray, d2: np.ndarray, visits: int) -> np.ndarray:
    """The `visits` cells nearest to each row, nearest first: a multi-sequence traversal.

    Of the two sorted sequences of distances, places a and b can be among the first `visits` sums only
    if (a + 1) * (b + 1) <= visits, so only those pairs are formed.
    """
    k1, k2 = d1.shape[1], d2.shape[1]
    visits = min(visits, k1 * k2)
    o1, o2 = np.argsort(d1, 1, kind="stable")[:, :visits], np.argsort(d2, 1, kind="stable")[:, :visits]
    s1, s2 = np.take_along_axis(d1, o1, 1), np.take_along_axis(d2, o2, 1)
    pairs = [(a, b) for a in range(min(visits, k1)) for b in range(min(visits // (a + 1), k2))]
    a, b = np.array([x for x, _ in pairs]), np.array([x for _, x in pairs])
    first = np.argsort(s1[:, a] + s2[:, b], 1, kind="stable")[:, :visits]
    return np.take_along_axis(o1[:, a] * k2 + o2[:, b], first, 1).astype(np.int32)


def visits_needed(sample: np.ndarray, books: tuple[np.ndarray, np.ndarray], threshold: float, target: float, seed: int = 1) -> int:
    """Fewest visits at which the target share of neighbours meets, of neighbours just at the threshold.

    The neighbours are sample vectors turned by the threshold's angle in random directions: no true
    pair is farther apart, so a true pair's chance is higher.  A pair meets if either visits the other.
    """
    rng = np.random.default_rng(seed)
    x = sample[rng.choice(len(sample), min(PROBES, len(sample)), replace=False)]
    turn = rng.standard_normal(x.shape)
    turn -= (turn * x).sum(1)[:, None] * x
    turn /= np.maximum(np.linalg.norm(turn, axis=1), 1e-12)[:, None]
    y = threshold * x + np.sqrt(1 - threshold**2) * turn
    h = x.shape[1] // 2
    rank = []
    for p, q in ((x, y), (y, x)):
        d1, d2 = nearest(p[:, :h], books[0]), nearest(p[:, h:], books[1])
        c1, c2 = nearest(q[:, :h], books[0]).argmin(1), nearest(q[:, h:], books[1]).argmin(1)
        mine = d1[np.arange(len(p)), c1] + d2[np.arange(len(p)), c2]
        d2.sort(1)
        rank.append(np.array([np.searchsorted(d2[i], mine[i] - d1[i]).sum() for i in range(len(p))]))
    return int(np.quantile(np.minimum(*rank), target, method="higher")) + 1


READY = pa.schema([("doc_id", pa.int64()), ("dim", pa.int32()), ("key", pa.binary()), ("vec", pa.binary())])


def _ready(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors as bytes; nothing for vectors that link with nothing."""
    for batch in batches:
        ids, dims, keys, vecs = batch.column(0), [], [], []
        for x in batch.column(1):
            v = None if not x.is_valid or x.values.null_count else x.values.to_numpy(zero_copy_only=False).astype(np.float64)
            norm = 0.0
            if v is not None and len(v) and np.isfinite(v).all():
                top = np.abs(v).max()
                norm = np.linalg.norm(v / top) if top else 0.0
            if norm:
                unit = v / top / norm
                dims.append(len(v))
                vecs.append((unit + 0.0).tobytes())
                keys.append(hashlib.md5(vecs[-1]).digest())
            else:
                dims.append(None)
                vecs.append(None)
                keys.append(None)
        yield pa.RecordBatch.from_arrays([ids, pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], schema=READY)


SENT_DDL = "cell int, block int, part int, id long, copies long, home int, stands boolean, asks boolean, vec binary, visits binary"
SENT = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in SENT_DDL.split(", "))])


def _matrix(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)


def _cells(x: np.ndarray, books, visits: int) -> np.ndarray:
    h = x.shape[1] // 2
    return traverse(nearest(x[:, :h], books[0]), nearest(x[:, h:], books[1]), visits)


def _visit(books, visits: int, split: dict[int, tuple[int, int]]):
    """A row for each cell that a vector visits.

    A cell that many stand in or visit is split into blocks of what stands there and parts of what
    visits it, and every part meets every block: a vector asks in its own part, in all blocks, and
    stands in its own block, in all parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                blobs = piece.column(2).to_pylist()
                cells = _cells(_matrix(blobs), books, visits)
                out = [[] for _ in SENT]
                for i, copies, blob, own in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), blobs, cells):
                    home, by = int(own[0]), i * 2654435761 % 4294967296
                    for cell in own.tolist():
                        blocks, parts = split.get(cell, (1, 1))
                        mine, turn = by % blocks, by // blocks % parts
                        places = {(block, turn) for block in range(blocks)}
                        if cell == home:
                            places |= {(mine, part) for part in range(parts)}
                        for block, part in places:
                            stands = cell == home and block == mine
                            for col, x in zip(out, (cell, block, part, i, copies, home, stands, part == turn, blob, own.tobytes() if stands else None)):
                                col.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, SENT)], schema=SENT)

    return run


FOUND = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
FOUND_DDL = "id long, links long, a long, b long"


def _meet(threshold: float):
    """Verify one part of a cell's visitors against one block: each vector's links, and edges that join the linked ones.

    A visitor counts what it finds.  What it finds counts the visitor too, unless it visits the
    visitor's own cell and so counts it there.
    """

    def run(table: pa.Table) -> pa.Table:
        stands = table["stands"].to_numpy()
        here = np.nonzero(stands)[0]
        if not len(here):
            return FOUND.empty_table()
        blobs, ids = table["vec"].to_pylist(), table["id"].to_numpy()
        copies, home = table["copies"].to_numpy(), table["home"].to_numpy()
        cell, visited = table["cell"][0].as_py(), table["visits"].to_pylist()
        base = _matrix([blobs[i] for i in here])
        routes = np.stack([np.frombuffer(visited[i], np.int32) for i in here])
        links, tree, edges = np.zeros(len(ids), np.int64), Forest(len(ids)), []
        asking = np.nonzero(table["asks"].to_numpy())[0]
        for s in range(0, len(asking), 1024):
            mine = asking[s : s + 1024]
            p, r = np.nonzero(_matrix([blobs[i] for i in mine]) @ base.T >= threshold)
            p, q = mine[p], here[r]
            other = ids[p] != ids[q]
            p, q, r = p[other], q[other], r[other]
            np.add.at(links, p, copies[q])
            away = home[p] != cell
            pa_, qa, ra = p[away], q[away], r[away]
            unseen = ~(routes[ra] == home[pa_][:, None]).any(1)
            np.add.at(links, qa[unseen], copies[pa_[unseen]])
            for x, y in zip(p.tolist(), q.tolist()):
                if tree.up[x] != tree.up[y] and tree.join(x, y):
                    edges.append((ids[x], ids[y]))
        some = np.nonzero(links)[0]
        nothing, none = pa.nulls(len(some), pa.int64()), pa.nulls(len(edges), pa.int64())
        return pa.table(
            [
                pa.chunked_array([pa.array(ids[some]), none]), pa.chunked_array([pa.array(links[some]), none]),
                pa.chunked_array([nothing, pa.array([a for a, _ in edges], pa.int64())]), pa.chunked_array([nothing, pa.array([b for _, b in edges], pa.int64())]),
            ],
            schema=FOUND,
        )

    return run


def _search(nodes: DataFrame, n: int, dim: int, threshold: float, target: float) -> Stored:
    """Links and joining edges of n distinct vectors of one length."""
    words = int(min(MOST_WORDS, max(2, round((n / CELL_ROWS) ** 0.5))))
    few = nodes.select("vec").orderBy(F.xxhash64("rep")).limit(SAMPLE).collect()  # SAMPLE rows at most
    sample = _matrix([bytes(r.vec) for r in few])
    h = dim // 2
    books = (fit_codebook(sample[:, :h], words), fit_codebook(sample[:, h:], words))
    visits = visits_needed(sample, books, threshold, target)

    def crowd(batches):
        """Of every cell: how many vectors of a batch stand in it, and how many visit it."""
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                cells = _cells(_matrix(batch.column(0).slice(at, 2000).to_pylist()), books, visits)
                seen, n = np.unique(cells, return_counts=True)
                home = np.bincount(np.searchsorted(seen, cells[:, 0]), minlength=len(seen))
                yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(home), pa.array(n)], names=["cell", "stand", "visit"])

    crowds = nodes.select("vec").mapInArrow(crowd, "cell int, stand long, visit long").groupBy("cell").agg(F.sum("stand").alias("stand"), F.sum("visit").alias("visit"))
    full = crowds.filter((F.col("stand") > BLOCK_ROWS) | (F.col("visit") > VISIT_ROWS)).collect()  # at most words ** 2 cells
    split = {r.cell: (max(1, -(-r.stand // BLOCK_ROWS)), -(-r.visit // VISIT_ROWS)) for r in full}
    sent = nodes.select("rep", "copies", "vec").mapInArrow(_visit(books, visits, split), SENT_DDL)
    found = Stored(sent.groupBy("cell", "block", "part").applyInArrow(_meet(threshold), FOUND_DDL), "vectors-found")
    release(nodes.sparkSession)
    return found


def near_groups_sql(threshold: float = 0.9) -> str:
    """The same by comparing all pairs, for vectors of one length with unique ids."""
    return f"""WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    ok AS (SELECT * FROM e WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
    l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= {threshold}),
    r(id, c) AS (SELECT vec_id, vec_id FROM e UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id WHERE r.c < l.b),
    n AS (SELECT a, count(*) AS n FROM l GROUP BY a), m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
    SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, c = vec_id AS kept FROM e JOIN m ON m.id = vec_id LEFT JOIN n ON n.a = vec_id"""


def near_groups(vectors: DataFrame, threshold: float = 0.9, target: float = TARGET, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Links of each vector at cosine >= threshold and the class they join it to.

    Returns vec_id, n_links, component_id (the smallest vec_id reachable), kept.  Vectors that are
    null, empty or zero, or that hold null or non-finite components, link with nothing; vectors link
    with those of their own length, and each length has its own codebooks and search.  Equal vectors are one node that counts
    its copies.  Rows that repeat a vec_id, or lack one, are told apart while linking and have the
    smallest vec_id of their class; an empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows, back = unique_ids(vectors.select(F.col(id_col).cast("long").alias("doc_id"), F.col(vec_col).alias("embedding")), ["embedding"])
    ready = Stored(rows.mapInArrow(_ready, "doc_id long, dim int, key binary, vec binary"), "vectors-ready")
    fit = F.col("dim").isNotNull()
    classes = ready.read().filter(fit).groupBy("dim", "key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    nodes = Stored(classes, "vectors-nodes")
    sizes = nodes.read().groupBy("dim").agg(F.count("*").alias("n")).filter("n > 1 and dim > 1").orderBy("dim").collect()  # one row a length
    found = None
    for r in sizes:
        some = _search(nodes.read().filter(F.col("dim") == r.dim), r.n, r.dim, threshold, target).read()
        found = some if found is None else found.unionByName(some)
    counts, near = "id long, links long", None
    if found is not None:
        near = connected_components(found.filter("a is not null").select("a", "b"))
    linked = (found.filter("id is not null").select("id", "links") if found is not None else spark.createDataFrame([], counts)).groupBy("id").agg(F.sum("links").alias("links"))
    near = near if near is not None else spark.createDataFrame([], "node long, component long")
    named = (
        nodes.read().select("key", "rep", "copies")
        .join(linked.withColumnRenamed("id", "rep"), "rep", "left").join(near.withColumnRenamed("node", "rep"), "rep", "left")
        .select("key", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    out = (
        ready.read().select("doc_id", F.when(fit, F.col("key")).alias("key")).join(named, "key", "left")
        .select("doc_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))
    )
    if back is not None:
        least = out.join(back, "doc_id").groupBy("component_id").agg(F.min("old_id").alias("least"))
        out = out.join(back, "doc_id").join(least, "component_id").select(F.col("old_id").alias("doc_id"), "n_links", F.col("least").alias("component_id"), "kept")
    return out.withColumnRenamed("doc_id", id_col)
