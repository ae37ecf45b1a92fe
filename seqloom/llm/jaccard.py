"""N-gram Jaccard join: a size-aware heavy-light join on sets of word shingles.

Two sets that meet the threshold share most of their rarest shingles.  For a set of n shingles, o(n) =
ceil(n * threshold) shingles at least are common, so the n - o(n) + k rarest of either side have k in
common, in any order that is the same for all sets; here rare shingles come first by a fixed-size
count sketch.  Small (light) sets are matched by every 2-subset of those (k = 2), large (heavy) ones
by scanning the inverted lists of single shingles (k = 1); the boundary is the size at which the two
cost the least in all.  Small sets within reach of a large one's size stand in the lists as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, as_text, release, tune, unique_ids
from .components import EDGE, EDGE_DDL, connected_components
from .shingles import mix, shingle_sets

U = np.uint64
#: Counters of the sketch that orders shingles: 8 MB in a task that counts, 2 MB once added up, whatever the input size.
SKETCH = 1 << 21
#: Levels of a doubled count; a counter leaves the tasks as its level, in a byte.
LEVELS = 7
#: Lists up to this length give all their pairs of fitting size; longer ones a chain in size order.
SHORT_LIST = 32
#: Shingles of the sets that one verifying task holds, and of those whose keys share the buckets (a fifth are keys).
TASK_SHINGLES, BUCKET_SHINGLES = 4_000_000, 1_500_000
NUM, DEN = 80, 100


def least_common(n, num: int = NUM, den: int = DEN):
    """o(n): a partner of a set of n shingles shares at least so many."""
    return -(-n * num // den)


def count_levels(counts: np.ndarray) -> np.ndarray:
    """Counts below 2**32 as levels in the same order; counts up to 13 have each their own, larger ones share one with those 10 % off."""
    return np.round(LEVELS * np.log2(counts + 1.0)).astype(np.uint8)


def list_length(cells: np.ndarray, share: float) -> float:
    """How far the counters of the rarest `share` of all shingles lie above the median counter, on average.

    cells: the number of counters at each level.
    """
    worth = np.exp2(np.arange(len(cells)) / LEVELS) - 1
    mass = cells * worth
    left = share * mass.sum() - (np.cumsum(mass) - mass)
    taken = np.clip(np.divide(left, worth, out=cells.astype(float), where=worth > 0), 0, cells)
    median = worth[np.searchsorted(np.cumsum(cells), cells.sum() / 2)]
    return float((taken * np.maximum(worth - median, 0)).sum() / max(1, taken.sum()))


def choose_boundary(sizes: dict[int, int], list_cost: float, largest: int = 400, num: int = NUM, den: int = DEN) -> int:
    """Largest size of a light set: the one that makes keys and list scans cheapest in all.

    A light set costs a key for each 2-subset; a heavy one `list_cost` for each list it stands in.
    """
    best = cost = sum(c * (n - least_common(n, num, den) + 1) * list_cost for n, c in sizes.items())
    boundary = 0
    for n in range(1, largest + 1):
        if n not in sizes:
            continue
        prefix = n - least_common(n, num, den)
        cost += sizes[n] * ((prefix + 2) * (prefix + 1) / 2 - (prefix + 1) * list_cost)
        if cost <= best:
            best, boundary = cost, n
    return boundary


def set_keys(s: np.ndarray, counts: np.ndarray, boundary: int, num: int = NUM, den: int = DEN) -> np.ndarray:
    """The keys of one set: hashes of 2-subsets if light, of single shingles if heavy or nearly so."""
    n = len(s)
    rare = n - least_common(n, num, den)
    if n * den < num * (n + 1) and not rare:  # only an identical set can meet the threshold
        return np.zeros(0, np.uint64)
    take = min(n, rare + 2)
    order = np.lexsort((s, counts))[:take]
    keys = []
    if n <= boundary and take >= 2:
        i, j = np.triu_indices(take, 1)
        a, b = s[order[i]], s[order[j]]
        keys.append(mix(np.minimum(a, b) * U(0x9E3779B97F4A7C15) + np.maximum(a, b)) | U(1))
    if n > boundary or n * den >= num * (boundary + 1):
        keys.append(s[order[: rare + 1]] & ~U(1))
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def set_print(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, in two numbers."""
    return tuple(int(mix(s ^ x).sum(dtype=np.uint64).astype(np.int64)) for x in (U(0), U(0xA5A5A5A5A5A5A5A5)))


def parity_bits(s: np.ndarray) -> bytes:
    """A bit for each of about len(s) cells: whether an odd number of shingles falls into it.

    Two sets' bits differ in at most as many places as there are shingles that only one has.
    """
    cells = 1 << max(6, (len(s) - 1).bit_length() if len(s) else 0)
    odd = np.bincount((mix(s ^ U(0x5851F42D4C957F2D)) & U(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def may_link(a: bytes, n: int, b: bytes, m: int, num: int = NUM, den: int = DEN) -> bool:
    """False only if sets of n and m shingles with these bits can't meet the threshold."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    k = min(len(x), len(y))
    x, y = np.bitwise_xor.reduce(x.reshape(-1, k), 0), np.bitwise_xor.reduce(y.reshape(-1, k), 0)
    return int(np.bitwise_count(x ^ y).sum()) * (num + den) <= (den - num) * (n + m)


SIZES = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("bits", pa.binary()), ("chunk", pa.int32()), ("counts", pa.binary())])
SIZES_DDL = "doc_id long, n long, fp1 long, fp2 long, bits binary, chunk int, counts binary"
CHUNKS = 16


def _texts(batch: pa.RecordBatch, col: int = 1) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in batch.column(col).to_pylist()]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set size and 128-bit set fingerprint of each text, and the task's shingle counts."""
    total = np.zeros(SKETCH, np.uint32)
    for batch in batches:
        sets = shingle_sets(_texts(batch))
        for s in sets:
            np.add.at(total, (s & U(SKETCH - 1)).astype(np.int64), 1)
        fp = [set_print(s) for s in sets]
        k = len(sets)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in fp], pa.int64()), pa.array([b for _, b in fp], pa.int64()), pa.array([parity_bits(s) for s in sets], pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())],
            schema=SIZES,
        )
    if total.any():
        parts = [x.astype("<u4").tobytes() for x in np.split(total, CHUNKS)]
        nothing = pa.nulls(CHUNKS, pa.int64())
        yield pa.RecordBatch.from_arrays([nothing] * 4 + [pa.nulls(CHUNKS, pa.binary()), pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], schema=SIZES)


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Levels of the sums by chunk of the rows of one task."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = np.frombuffer(blob, "<u4").astype(np.int64)
            total[c] = total[c] + x if c in total else x
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([count_levels(np.minimum(x, (1 << 32) - 1)).tobytes() for x in total.values()], pa.binary())], names=["chunk", "levels"]
    )


POSTS = pa.schema([("bucket", pa.int32()), ("m", pa.int32()), ("keys", pa.binary()), ("nodes", pa.binary()), ("sizes", pa.binary()), ("long", pa.binary()), ("a", pa.int64()), ("b", pa.int64())])
POSTS_DDL = "bucket int, m int, keys binary, nodes binary, sizes binary, long binary, a long, b long"


def _in_order(key: np.ndarray, node: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries by (key, size, node), each once: copies of a set are one node."""
    order = np.lexsort((node, size, key))
    key, node, size = key[order], node[order], size[order]
    once = np.ones(len(key), bool)
    once[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    return key[once], node[once], size[once]


def _chain(key: np.ndarray, size: np.ndarray, node: np.ndarray, num: int, den: int) -> np.ndarray:
    """Of entries in order of (key, size, node): which one reaches the next of its list by size."""
    return (key[1:] == key[:-1]) & (node[1:] != node[:-1]) & (size[:-1] * den >= size[1:] * num)


def spread_names(spark, buckets: int) -> np.ndarray:
    """Names of so many buckets that a shuffle to as many partitions deals to one each."""
    names, tried, size = np.full(buckets, -1, np.int32), 0, 16 * buckets
    while (names < 0).any():
        ids = spark.range(tried, tried + size).select(F.col("id").cast("int").alias("id"))
        part = F.pmod(F.hash("id"), F.lit(buckets))
        for r in ids.groupBy(part.alias("part")).agg(F.min("id").alias("id")).collect():  # one row a bucket
            if names[r.part] < 0:
                names[r.part] = r.id
        tried += size
    return names


def _post(sketch, boundary: int, names: np.ndarray, num: int, den: int, flush: int = 500_000):
    """Keys of every set, by bucket.  A list that is long within a task leaves as its chain and one entry."""
    buckets = len(names)

    def out(keys, nodes, sizes):
        key, node, size = _in_order(np.concatenate(keys), np.concatenate(nodes), np.concatenate(sizes))
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.nonzero(new)[0]
        m = np.diff(np.append(first, len(key)))
        long = np.repeat(m > SHORT_LIST, m)
        step = _chain(key, size, node, num, den) & long[1:]
        a, b = node[:-1][step], node[1:][step]
        # of a stretch of a long list its ends stay, and one entry for every twentieth more of size:
        # whatever reaches a member by size reaches one that stays, or stands between two that do
        start = new.copy()
        start[1:] |= ~step
        last = np.append(start[1:], True)
        grade = np.floor(np.log(size) / np.log(1.05))
        keep = ~long | start | last
        keep[1:] |= grade[1:] != grade[:-1]
        key, node, size, long = key[keep], node[keep], size[keep], long[keep]
        bucket = ((key >> U(1)) % U(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        rows = [[] for _ in POSTS]
        for k, own in enumerate(np.split(by, np.cumsum(np.bincount(bucket, minlength=buckets))[:-1])):
            if len(own):
                for col, x in zip(rows, (names[k], len(own), key[own].tobytes(), node[own].tobytes(), size[own].astype("<i4").tobytes(), np.packbits(long[own]).tobytes(), None, None)):
                    col.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, POSTS)], schema=POSTS)
        if len(a):
            where = names[a % buckets]
            nothing = pa.nulls(len(a), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(where), pa.nulls(len(a), pa.int32()), *[nothing] * 4, pa.array(a), pa.array(b)], schema=POSTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, sizes, held = [], [], [], 0
        for batch in batches:
            counts = sketch.value
            for s in shingle_sets(_texts(batch, 0)):
                k = set_keys(s, counts[(s & U(SKETCH - 1)).astype(np.int64)], boundary, num, den)
                keys.append(k)
                nodes.append(np.full(len(k), set_print(s)[0], np.int64))
                sizes.append(np.full(len(k), len(s), np.int64))
                held += len(k)
            if held >= flush:
                yield from out(keys, nodes, sizes)
                keys, nodes, sizes, held = [], [], [], 0
        if held:
            yield from out(keys, nodes, sizes)

    return run


def _candidates(num: int, den: int):
    """Of one bucket of lists: pairs of fitting size from short lists, chains from long ones."""

    def run(table: pa.Table) -> pa.Table:
        passed = table.filter(table["m"].is_null())
        table = table.filter(table["m"].is_valid())
        chains = [np.stack([passed["a"].to_numpy(), passed["b"].to_numpy()], 1)] if passed.num_rows else []
        found = []
        if table.num_rows:
            key = np.frombuffer(b"".join(table["keys"].to_pylist()), np.uint64)
            node = np.frombuffer(b"".join(table["nodes"].to_pylist()), np.int64)
            size = np.frombuffer(b"".join(table["sizes"].to_pylist()), "<i4").astype(np.int64)
            long = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8))[:m] for x, m in zip(table["long"].to_pylist(), table["m"].to_pylist())]).astype(bool)
            marked = np.unique(key[long])
            key, node, size = _in_order(key, node, size)
            at = np.searchsorted(marked, key)
            long = at < len(marked)
            long[long] = marked[at[long]] == key[long]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            first = np.nonzero(new)[0]
            m = np.diff(np.append(first, len(key)))
            long = np.repeat((m > SHORT_LIST) | np.logical_or.reduceat(long, first), m)
            step = _chain(key, size, node, num, den) & long[1:]
            chains.append(np.stack([node[:-1][step], node[1:][step]], 1))
            # short lists: entries d apart
            short = np.nonzero(~long & np.repeat(m > 1, m))[0]
            key, node, size = key[short], node[short], size[short]
            for d in range(1, SHORT_LIST):
                if d >= len(key):
                    break
                ok = (key[d:] == key[:-d]) & (size[:-d] * den >= size[d:] * num)
                if not ok.any():
                    break
                found.append(np.stack([node[:-d][ok], node[d:][ok]], 1))
        parts = []
        for kind, some in ((True, chains), (False, found)):
            pairs = np.concatenate(some) if some else np.zeros((0, 2), np.int64)
            pairs = np.unique(np.sort(pairs, axis=1), axis=0) if len(pairs) else pairs
            parts.append(pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(np.full(len(pairs), kind))], schema=PAIR))
        return pa.concat_tables(parts)

    return run


PAIR = EDGE.append(pa.field("chain", pa.bool_()))


def _plausible(num: int, den: int):
    """Of pairs with both sets' sizes and bits: those that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a print that two sets share has no bits, and its pairs go on
            kept = [None in x or may_link(*x, num, den) for x in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)))]
            few = batch.filter(pa.array(kept, pa.bool_()))
            yield pa.RecordBatch.from_arrays([few.column(0), few.column(1)], names=["a", "b"])

    return run


def link_sets(sets: list[np.ndarray], copies: np.ndarray, block: np.ndarray | None = None, num: int = NUM, den: int = DEN) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that join the same sets as all links of the threshold do, and each set's number of links.

    Every set is compared with all others through the inverted lists; a partner counts with its copies.
    Where blocks are given, only sets of different blocks are partners.
    """
    k = len(sets)
    n = np.array([len(s) for s in sets])
    group, links, partners = np.arange(k), [], np.zeros(k, np.int64)
    token = np.concatenate(sets)
    order = np.argsort(token, kind="stable")
    ranked = token[order]
    lists = np.repeat(np.arange(k), n)[order]
    for x in range(k):
        low, high = np.searchsorted(ranked, sets[x], "left"), np.searchsorted(ranked, sets[x], "right")
        m = high - low
        at = np.repeat(low - (np.cumsum(m) - m), m) + np.arange(m.sum())
        both = np.bincount(lists[at], minlength=k)
        meets = both * den >= num * (n[x] + n - both)
        meets[x] = False
        if block is not None:
            meets &= block != block[x]
        near = np.nonzero(meets)[0]
        partners[x] = copies[near].sum()
        for c, first in zip(*np.unique(group[near], return_index=True)):
            if c != group[x]:
                links.append((x, int(near[first])))
                group[group == c] = group[x]
    return links, partners


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("id", pa.int64()), ("links", pa.int64())])
LINKS_DDL = "a long, b long, id long, links long"


def _verify(num: int, den: int):
    """Edges that join the linked sets (a, b), and the links of each set (id, links)."""

    def run(table: pa.Table) -> pa.Table:
        clusters = table["task"].to_pylist()
        nodes, blobs = table["doc_id"].to_numpy(), table["shingles"].to_pylist()
        copies, block = table["copies"].to_numpy(), table["own"].to_numpy()
        by: dict = {}
        for i, c in enumerate(clusters):
            by.setdefault(c, []).append(i)
        out = [[], [], [], []]
        for own in by.values():
            # a task of two blocks compares them with each other; each with itself is another task
            apart = block[own] if len(set(block[own].tolist())) > 1 else None
            if len(own) > 1 and (apart is not None or table["inner"][own[0]].as_py()):
                links, partners = link_sets([np.frombuffer(blobs[i], np.uint64) for i in own], copies[own], apart, num, den)
                for x, y in links:
                    out[0].append(nodes[own[x]])
                    out[1].append(nodes[own[y]])
                for x in np.nonzero(partners)[0].tolist():
                    out[2].append(nodes[own[x]])
                    out[3].append(partners[x])
        edges, counted = pa.nulls(len(out[0]), pa.int64()), pa.nulls(len(out[2]), pa.int64())
        a, b, ids, links = (pa.array(c, pa.int64()) for c in out)
        return pa.table([pa.chunked_array(c) for c in ([a, counted], [b, counted], [edges, ids], [edges, links])], schema=LINKS)

    return run


#: Bits of the filter that spares texts without candidates: 4 MB, whatever the input size.  When it is
#: too small it lets more texts through, and the join that follows drops them.
FILTER_BITS = 1 << 25


def _bits(ids: np.ndarray) -> np.ndarray:
    return np.stack([mix(ids.astype(np.uint64) * U(0x9E3779B97F4A7C15) + U(k << 60)) & U(FILTER_BITS - 1) for k in (1, 2, 3)])


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = np.zeros(FILTER_BITS // 64, np.uint64)
    for batch in batches:
        at = _bits(batch.column(0).to_numpy()).ravel()
        np.bitwise_or.at(words, (at >> U(6)).astype(np.int64), U(1) << (at & U(63)))
    some = np.nonzero(words)[0]
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(words[some].view(np.int64))], names=["at", "word"])


def _ship(marks):
    """The sets of documents that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = marks.value.view(np.uint64)
        for batch in batches:
            at = _bits(batch.column(0).to_numpy())
            near = (words[(at >> U(6)).astype(np.int64)] >> (at & U(63)) & U(1)).all(0)
            batch = batch.filter(pa.array(near, pa.bool_()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(_texts(batch))], pa.binary())], names=["doc_id", "shingles"])

    return run


def similar_groups(docs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """Class of every document under the links  den * |A & B| >= num * |A | B|  of shingle sets.

    Returns doc_id, n_shingles, n_links (other rows that meet the threshold), component_id (the
    smallest doc_id reachable by links, itself included).  A null or empty text has no shingles and no links; rows that repeat a doc_id, or lack
    one, are told apart by a row number while joining and have the smallest doc_id of their class; an
    empty table gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    base, back = unique_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_text().alias("text")), ["text"])
    seen = Stored(base.mapInArrow(_measure, SIZES_DDL), "jaccard-sizes")
    rows = seen.read().filter("doc_id is not null").select("doc_id", "n", "fp1", "fp2", "bits")
    # the counts of tasks are added in two steps, in parallel by chunk; the driver gets a byte a counter
    added = seen.read().filter("chunk is not null").select("chunk", "counts").repartition(CHUNKS, "chunk").mapInArrow(_add_counts, "chunk int, levels binary").toArrow()
    levels, cells, size = np.zeros(SKETCH, np.uint8), np.zeros(256, np.int64), SKETCH // CHUNKS
    for c, blob in zip(added["chunk"].to_pylist(), added["levels"]):
        levels[c * size : (c + 1) * size] = np.frombuffer(blob.as_buffer(), np.uint8)
    for k in range(0, SKETCH, size):
        cells += np.bincount(levels[k : k + size], minlength=256)
    # sets by size: only sizes that can be light count one by one
    hist = rows.filter("n > 0").groupBy(F.least("n", F.lit(401)).alias("n")).agg(F.count("*").alias("c"), F.sum("n").alias("t")).collect()
    list_cost = 1 + list_length(cells, 1 - num / den)
    boundary = choose_boundary({r.n: r.c for r in hist}, list_cost, num=num, den=den)
    total = sum(r.t for r in hist)

    # identical sets are one node, named by their print while candidates are sought
    first = Stored(rows.filter("n > 0").groupBy("fp1", "fp2", "n").agg(F.min("doc_id").alias("rep"), F.any_value("bits").alias("bits"), F.count("*").alias("copies")), "jaccard-reps")
    buckets = max(32, -(-total // BUCKET_SHINGLES))
    names = spread_names(spark, buckets)
    sketch = spark.sparkContext.broadcast(levels)
    posts = base.select("text").mapInArrow(_post(sketch, boundary, names, num, den), POSTS_DDL)
    pairs = Stored(posts.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_candidates(num, den), EDGE_DDL + ", chain boolean"), "jaccard-pairs")
    sketch.destroy()
    release(spark)
    # of pairs from short lists only those go on whose bits leave a link possible
    side = first.read().groupBy("fp1").agg(F.min("n").alias("n"), F.any_value("bits").alias("bits"), F.count("*").alias("same")).filter("same = 1")
    sides = [side.select(F.col("fp1").alias(x), F.col("bits").alias(f"bits_{x}"), F.col("n").alias(f"n_{x}")) for x in ("a", "b")]
    direct = pairs.read().filter("not chain").select("a", "b").distinct().join(sides[0], "a", "left").join(sides[1], "b", "left")
    # stored, since what follows runs Python too and a task would hold two workers
    direct = Stored(direct.select("a", "b", "bits_a", "n_a", "bits_b", "n_b").mapInArrow(_plausible(num, den), EDGE_DDL), "jaccard-direct")
    near = connected_components(pairs.read().filter("chain").select("a", "b").unionByName(direct.read())).withColumnRenamed("node", "fp1").join(first.read(), "fp1")
    near = Stored(near.select(F.col("rep").alias("doc_id"), "component", "n", "copies"), "jaccard-near")
    pairs.drop()
    direct.drop()
    release(spark)

    # every set of a class of candidates is compared with the others; large classes in pairs of blocks
    blocks = near.read().groupBy("component").agg(F.ceil(F.sum("n") / TASK_SHINGLES).cast("int").alias("blocks")).filter("blocks > 1")
    words = near.read().select("doc_id").mapInArrow(_mark, "at int, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()  # FILTER_BITS / 64 at most
    marks = np.zeros(FILTER_BITS // 64, np.int64)
    marks[words["at"].to_numpy()] = words["word"].to_numpy()
    filled = spark.sparkContext.broadcast(marks)
    shipped = base.mapInArrow(_ship(filled), "doc_id long, shingles binary").join(near.read().select("doc_id", "component", "copies"), "doc_id")
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    others = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = (
        shipped.join(blocks, "component", "left")
        .withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", F.explode(others))
        .withColumn("task", F.concat_ws(":", "component", F.least("own", "other"), F.greatest("own", "other")))
        .withColumn("inner", F.col("own") == F.col("other"))
        .withColumn("grp", F.when(F.col("blocks").isNull(), F.pmod(F.xxhash64("component"), F.lit(buckets * 4)).cast("string")).otherwise(F.col("task")))
    )
    links = Stored(dealt.select("grp", "task", "doc_id", "shingles", "copies", "own", "inner").groupBy("grp").applyInArrow(_verify(num, den), LINKS_DDL), "jaccard-links")
    filled.destroy()
    release(spark)
    classes = connected_components(links.read().filter("a is not null").select("a", "b")).select(F.col("node").alias("rep"), "component")
    partners = links.read().filter("id is not null").groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    named = rows.drop("bits").join(first.read().drop("bits"), ["fp1", "fp2", "n"], "left").join(classes, "rep", "left").join(partners, "rep", "left")
    n_links = F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
    out = named.select("doc_id", F.col("n").alias("n_shingles"), n_links.cast("long").alias("n_links"), F.coalesce("component", "rep", "doc_id").alias("component_id"))
    if back is not None:
        out = out.join(back, "doc_id")
        least = out.groupBy("component_id").agg(F.min("old_id").alias("least"))
        out = out.join(least, "component_id").select(F.col("old_id").alias("doc_id"), "n_shingles", "n_links", F.col("least").alias("component_id"))
    return out


def similar_groups_sql(num: int = NUM, den: int = DEN) -> str:
    """The same by counting the common shingles of all pairs, for unique ids."""
    upper, lower = (repr("".join(map(chr, range(a, a + 26)))) for a in (65, 97))
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {upper}, {lower}), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
    n AS (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
    i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
    l AS MATERIALIZED (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE i * {den} >= {num} * (x.n + y.n - i)),
    r(id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id WHERE r.c < l.b),
    k AS (SELECT a, count(*) AS k FROM l GROUP BY a), m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
    SELECT doc_id, n AS n_shingles, coalesce(k, 0) AS n_links, c AS component_id FROM n JOIN m ON m.id = doc_id LEFT JOIN k ON k.a = doc_id"""
