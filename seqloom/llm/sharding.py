"""Sharding by best-fit-decreasing bin packing of indivisible groups (rows of equal text).

Groups of one size are interchangeable, so the packing list is a table of (size, number of groups).
Different sizes that add up to no more than the input are fewer than the root of twice its bytes,
which bounds the list.  Best fit puts group after group of one size into the tightest bin while it
fits, so a size is placed in runs, one at most for each shard; rows find theirs by their group's rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, as_text

#: Groups of more than a share of 1 / HOT of all bytes, of which there are fewer than HOT, are joined by broadcast.
HOT = 16_384
#: Sizes that are broadcast at most; where there are more, groups are joined with their size by a shuffle.
FEW_SIZES = 500_000


class CapacityTree:
    """Open bins in an AVL tree ordered by (remaining capacity, number)."""

    __slots__ = ("root",)

    def __init__(self, bins: list[int], capacity: int):
        self.root = None
        for b in bins:
            self.insert((capacity, b))

    # a node is (left, key, right, height); trees share what they have in common
    @staticmethod
    def _node(left, key, right):
        return left, key, right, 1 + max(left[3] if left else 0, right[3] if right else 0)

    @classmethod
    def _balanced(cls, left, key, right):
        a, b = left[3] if left else 0, right[3] if right else 0
        if a > b + 1:
            if (left[2][3] if left[2] else 0) > (left[0][3] if left[0] else 0):
                x = left[2]
                return cls._node(cls._node(left[0], left[1], x[0]), x[1], cls._node(x[2], key, right))
            return cls._node(left[0], left[1], cls._node(left[2], key, right))
        if b > a + 1:
            if (right[0][3] if right[0] else 0) > (right[2][3] if right[2] else 0):
                x = right[0]
                return cls._node(cls._node(left, key, x[0]), x[1], cls._node(x[2], right[1], right[2]))
            return cls._node(cls._node(left, key, right[0]), right[1], right[2])
        return cls._node(left, key, right)

    def insert(self, key) -> None:
        def put(t):
            if t is None:
                return self._node(None, key, None)
            return self._balanced(put(t[0]), t[1], t[2]) if key < t[1] else self._balanced(t[0], t[1], put(t[2]))

        self.root = put(self.root)

    def remove(self, key) -> None:
        def least(t):
            while t[0]:
                t = t[0]
            return t[1]

        def cut(t, k):
            left, here, right, _ = t
            if k < here:
                return self._balanced(cut(left, k), here, right)
            if k > here:
                return self._balanced(left, here, cut(right, k))
            if left is None or right is None:
                return left or right
            after = least(right)
            return self._balanced(left, after, cut(right, after))

        self.root = cut(self.root, key)

    def tightest(self, size: int):
        """(remaining capacity, number) of the tightest bin that takes `size`, or None."""
        t, found = self.root, None
        while t:
            if t[1][0] >= size:
                t, found = t[0], t[1]
            else:
                t = t[2]
        return found


Run = tuple[int, int, int]  # size, number of groups, bin


def best_fit_decreasing(classes: list[tuple[int, int]], bins: list[int], capacity: int) -> list[Run] | None:
    """Runs in the order of (size, number of groups), sizes falling; None if these bins don't suffice."""
    tree, out = CapacityTree(bins, capacity), []
    for size, groups in classes:
        while groups:
            if (bin_ := tree.tightest(size)) is None:
                return None
            left, b = bin_
            # what the bin has left is still the tightest fit until it doesn't fit
            n = min(groups, left // size)
            tree.remove(bin_)
            tree.insert((left - n * size, b))
            out.append((size, n, b))
            groups -= n
    return out


def pack_classes(classes: list[tuple[int, int]], shards: int) -> list[Run]:
    """Runs of all groups, given as (size, number of groups) with sizes falling.

    A group larger than an even share of what is left gets a shard of its own, so one huge group
    doesn't unbalance the others.  The rest is packed into the remaining shards at the first
    capacity that suffices of an even share, then 1, 3, 7, 15, ... bytes more.
    """
    bins, out, rest, todo = list(range(shards)), [], sum(s * n for s, n in classes), list(classes)
    while todo and len(bins) > 1 and todo[0][0] * len(bins) > rest:
        size, n = todo[0]
        out.append((size, 1, bins.pop(0)))
        rest -= size
        todo[:1] = [(size, n - 1)] if n > 1 else []
    if not todo:
        return out
    low, more = max(-(-rest // len(bins)), todo[0][0]), 0
    while (found := best_fit_decreasing(todo, bins, low + more)) is None:
        more = 2 * more + 1
    return out + found


def _ranked(groups: DataFrame) -> DataFrame:
    """groups (key, bytes) with their rank by (bytes falling, key): a range sort, then partition offsets."""
    order = [F.desc("bytes"), F.asc("key")]
    rows = Stored(groups.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "shard-groups").read()
    rows = rows.withColumn("part", F.shiftright("at", 33))
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))  # one row a partition
    ahead = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    return rows.join(F.broadcast(ahead), "part").select("key", "bytes", (F.col("ahead") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("rank"))


def _with_shard(groups: DataFrame, shards: int, few_sizes: int) -> DataFrame:
    """(key, bytes, shard) of every group."""
    spark = groups.sparkSession
    classes = [(r.bytes, r.n) for r in groups.groupBy("bytes").agg(F.count("*").alias("n")).collect()]  # fewer than the root of twice the bytes
    runs: dict[int, list[tuple[int, int]]] = {}
    at = 0
    for size, n, b in pack_classes(sorted(classes, reverse=True), shards):
        runs.setdefault(size, []).append((at, b))
        at += n
    table = spark.createDataFrame(list(runs.items()), "bytes long, runs array<struct<first: long, shard: int>>")
    found = F.element_at(F.filter("runs", lambda r: r["first"] <= F.col("rank")), -1)["shard"]
    return _ranked(groups).join(F.broadcast(table) if len(runs) <= few_sizes else table, "bytes").select("key", "bytes", found.alias("shard"))


def shard(docs: DataFrame, shards: int = 16, hot: int = HOT, few_sizes: int = FEW_SIZES, slot_rows: int = 20_000) -> DataFrame:
    """Put every row into one of `shards` shards of nearly equal bytes; equal texts stay together.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard.  A null text counts as empty,
    rows that repeat a doc_id, or lack one, are placed each on its own, groups of one size go by their
    key, an empty table gives no rows, and extra columns are ignored.  Every group is packed whole; what
    reaches the driver is the number of groups of each size.
    """
    text = as_text()
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    )
    base = Stored(base, "shard-rows").read()
    groups = base.groupBy("key").agg(F.sum("size").alias("bytes"))
    total, n = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    if not n:
        return base.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    where = Stored(_with_shard(groups, shards, few_sizes), "shard-places").read()
    # a group whose rows could skew a shuffle is large, and large groups are few
    large = F.broadcast(where.filter(F.col("bytes") > total // hot).select("key", "shard"))
    small = where.filter(F.col("bytes") <= total // hot).select("key", "shard")
    placed = base.join(large, "key").unionByName(base.join(large.select("key"), "key", "left_anti").join(small, "key"))
    parts = max(1, -(-n // (slot_rows * shards)))
    placed = placed.withColumn("sub", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    ahead = (
        placed.groupBy("shard", "sub").agg(F.count("*").alias("n"))
        .withColumn("ahead", F.sum("n").over(Window.partitionBy("shard").orderBy("sub")) - F.col("n"))
        .drop("n")
    )
    rank = F.row_number().over(Window.partitionBy("shard", "sub").orderBy("doc_id", "text_crc32", "row")) - 1
    return (
        placed.withColumn("rank", rank)
        .join(ahead, ["shard", "sub"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("rank") + F.col("ahead")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )


#: CRC-32 of every text of d, byte by byte with the usual table: c (text, crc).
CRC_SQL = """one(i, k, r) AS (SELECT i, 0, i::BIGINT FROM range(256) x(i) UNION ALL SELECT i, k + 1, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END FROM one WHERE k < 8),
    tab AS (SELECT list(r ORDER BY i) AS tab FROM one WHERE k = 8),
    c AS (SELECT text, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT),
        lambda r, b: xor(r >> 8, tab[(xor(r, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS crc FROM (SELECT DISTINCT text FROM d), tab)"""


def shard_sql(shards: int = 16, doublings: int = 40, slots_in_order: int = 320_000) -> str:
    """The same in SQL, group by group, for unique doc_ids and at most `slots_in_order` rows (slots are then in the order of doc_id)."""
    whole = ", ".join(["NULL::BIGINT"] * shards)
    return f"""WITH RECURSIVE d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size, coalesce(text, '') AS text FROM documents),
    {CRC_SQL},
    g AS (SELECT row_number() OVER (ORDER BY sum(size) DESC, md5(text)) AS i, md5(text) AS key, sum(size)::BIGINT AS bytes FROM d GROUP BY text),
    t(i, more, own, rest, caps, shard) AS (
        SELECT 0::BIGINT, (1::BIGINT << k) - 1, 0, (SELECT sum(bytes) FROM g)::BIGINT, [{whole}], NULL::INT FROM range({doublings}) x(k)
        UNION ALL
        SELECT s.i, more, own2, CASE WHEN alone THEN rest - bytes ELSE rest END,
            CASE WHEN alone THEN caps ELSE list_transform(now, lambda c, j: CASE WHEN j = list_position(now, fit) THEN c - bytes ELSE c END) END,
            CASE WHEN alone THEN own ELSE (list_position(now, fit) - 1) END::INT
        FROM (SELECT *, list_min(list_filter(now, lambda c: c >= bytes)) AS fit FROM (
            SELECT g.i, t.more, t.own, t.rest, t.caps, g.bytes, alone, t.own + alone::INT AS own2,
                CASE WHEN t.caps[{shards}] IS NOT NULL OR alone THEN t.caps
                ELSE list_transform(t.caps, lambda c, j: CASE WHEN j <= t.own THEN -1 ELSE greatest((t.rest + {shards} - t.own - 1) // ({shards} - t.own), g.bytes) + t.more END) END AS now
            FROM t JOIN g ON g.i = t.i + 1, LATERAL (SELECT t.caps[{shards}] IS NULL AND t.own < {shards} - 1 AND g.bytes * ({shards} - t.own) > t.rest AS alone))) s
        WHERE alone OR fit IS NOT NULL),
    best AS (SELECT min(more) AS more FROM t WHERE i = (SELECT max(i) FROM g)),
    p AS (SELECT key, shard FROM t JOIN best USING (more) JOIN g USING (i))
    SELECT doc_id, size, c.crc AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INT AS grown_shard
    FROM d JOIN p ON md5(d.text) = p.key JOIN c USING (text)"""
