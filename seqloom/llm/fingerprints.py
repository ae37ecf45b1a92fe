"""Document fingerprints from prefix polynomial hashes.

A fingerprint is the hash of the whole text, which tells texts apart, and a sketch of the hashes of its
spans, by which likeness is estimated.  Both are read from the text's prefix arrays, as are span
equality and the longest common extension.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, tune, unique_ids

P = np.uint64((1 << 31) - 1)  # a Mersenne prime: products of two residues fit in 64 bits
BASES = (np.uint64(1_315_423_911 % ((1 << 31) - 1)), np.uint64(880_301_671))
#: Code points of the spans whose hashes make the sketch, and the sketch's cells (16 bits each).
SPAN, CELLS = 8, 128
EMPTY = np.iinfo(np.uint64).max


def _mod(x: np.ndarray) -> np.ndarray:
    """x mod P for x < 2**62."""
    x = (x & P) + (x >> np.uint64(31))
    return np.minimum(x, x - P)  # below P the difference wraps to a large number


class Powers:
    """Powers of the bases and of their inverses, grown as longer texts come."""

    def __init__(self):
        self.up = [np.ones(1, np.uint64) for _ in BASES]
        self.down = [np.ones(1, np.uint64) for _ in BASES]

    def need(self, n: int) -> None:
        while len(self.up[0]) <= n:
            for k, base in enumerate(BASES):
                for have, b in ((self.up, int(base)), (self.down, pow(int(base), -1, int(P)))):
                    m = len(have[k])
                    have[k] = np.concatenate([have[k], _mod(have[k] * np.uint64(pow(b, m, int(P))))])


POWERS = Powers()


class PrefixHashes:
    """Modular prefix arrays of one text: the hash of any span in constant time.

    Two residues of 31 bits stand for a span, so unequal spans agree with a chance near 2**-62 each.
    """

    def __init__(self, text: str):
        self.codes = self._codes(text)
        self.n = len(self.codes)
        POWERS.need(self.n + 1)
        self.sums = [self._sums(k, self.codes, 0, np.uint64(0)) for k in range(len(BASES))]

    @staticmethod
    def _codes(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)

    @staticmethod
    def _sums(k: int, codes: np.ndarray, at: int, before: np.uint64) -> np.ndarray:
        """Prefix sums, from `before` on, of codes that stand from `at` on.

        Residues stay below 2**31, so a running sum of 2**32 of them fits.
        """
        out = np.empty(len(codes) + 1, np.uint64)
        out[0] = before
        np.cumsum(_mod(codes * POWERS.up[k][at : at + len(codes)]), out=out[1:])
        out[1:] += before
        return _mod(out)

    def edited(self, keep: int, tail: str) -> PrefixHashes:
        """The hashes of the first `keep` code points followed by `tail`; the common part is shared."""
        out, codes = object.__new__(PrefixHashes), self._codes(tail)
        out.codes = np.concatenate([self.codes[:keep], codes])
        out.n = keep + len(codes)
        POWERS.need(out.n + 1)
        out.sums = [np.concatenate([s[:keep], self._sums(k, codes, keep, s[keep])]) for k, s in enumerate(self.sums)]
        return out

    def spans(self, starts: np.ndarray, length: int) -> np.ndarray:
        """62-bit hashes of the spans of one length at these starts; equal spans have equal hashes."""
        got = []
        for k in range(len(BASES)):
            s = self.sums[k]
            got.append(_mod(_mod(s[starts + length] + P - s[starts]) * POWERS.down[k][starts]))
        return (got[0] << np.uint64(31)) | got[1]

    def span(self, start: int, length: int) -> int:
        return int(self.spans(np.array([start]), length)[0])


def span_equal(a: PrefixHashes, i: int, b: PrefixHashes, j: int, length: int) -> bool:
    return i + length <= a.n and j + length <= b.n and a.span(i, length) == b.span(j, length)


def longest_common_extension(a: PrefixHashes, i: int, b: PrefixHashes, j: int) -> int:
    """Length of the longest equal spans that start at i and j, by binary search."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        if a.span(i, mid) == b.span(j, mid):
            low = mid
        else:
            high = mid - 1
    return low


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def least(hashes: PrefixHashes, begin: int, end: int, width: int, cells: int = CELLS) -> np.ndarray:
    """By cell, the least scrambled hash of the spans of `width` that start in [begin, end)."""
    h = np.sort(_scramble(hashes.spans(np.arange(begin, end), width)))
    shift = np.uint64(64 - (cells - 1).bit_length())
    cell = np.arange(cells, dtype=np.uint64)
    at = np.searchsorted(h, cell << shift)
    h = np.append(h, EMPTY)
    return np.where((h[at] >> shift == cell) & (at < end - begin), h[at], EMPTY)


def finish(low: np.ndarray) -> np.ndarray:
    """16 bits of each cell; an empty cell takes a full one, chosen by the cell's number alone."""
    full = np.nonzero(low != EMPTY)[0]
    if not len(full):
        return np.zeros(len(low), np.uint16)
    empty = np.setdiff1d(np.arange(len(low)), full)
    near = full[(empty * 40503 + 17) % len(full)]
    out = low.copy()
    out[empty] = _scramble(low[near] + empty.astype(np.uint64))
    return (out & np.uint64(0xFFFF)).astype(np.uint16)


def sketch(hashes: PrefixHashes, span: int = SPAN, cells: int = CELLS) -> np.ndarray:
    """One-permutation minimum sketch over the hashes of all spans; a shorter text is one span."""
    if not hashes.n:
        return np.zeros(cells, np.uint16)
    width = min(span, hashes.n)
    return finish(least(hashes, 0, hashes.n - width + 1, width, cells))


def fingerprint_of(hashes: PrefixHashes, cells: np.ndarray) -> str:
    """16 hexadecimal digits of the whole text's hash, then 4 of each cell of its sketch."""
    return f"{hashes.span(0, hashes.n) if hashes.n else 0:016x}" + cells.astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Of two fingerprints: the share of spans that their texts have in common (Dice), estimated from equal cells; 1 of equal texts."""
    if a[:16] == b[:16]:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f[16:]), ">u2") for f in (a, b))
    j = float((x == y).mean())
    return 2 * j / (1 + j)


def edit(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many (or all) of the next text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _part_of(bounds: list[int]):
    """Number of bounds at or below doc_id, found in two steps of about sqrt(len(bounds))."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    chunks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*[F.lit(c[0]) for c in chunks])
    tails = F.array(*[F.array(*[F.lit(x) for x in c]) for c in chunks])
    chunk = F.size(F.filter(heads, lambda b: b <= F.col("doc_id")))
    within = F.size(F.filter(F.element_at(tails, chunk), lambda b: b <= F.col("doc_id")))
    return F.when(F.col("doc_id").isNull() | (chunk == 0), 0).otherwise((chunk - 1) * step + within)


OUT = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("common_prefix", pa.int64()),
    ]
)


def _kept(n: int) -> int:
    """Code points that stay of n: all but the last quarter."""
    return n - n // 4


class _Print:
    """A text's hashes and sketch; the part that an edit leaves alone is sketched once."""

    def __init__(self, text: str):
        self.text, self.hashes = text, PrefixHashes(text)
        n = self.hashes.n
        self.common = max(0, _kept(n) - SPAN + 1)  # spans within the part that stays
        if n >= SPAN:
            self.low = least(self.hashes, 0, self.common, SPAN)
            cells = finish(np.minimum(self.low, least(self.hashes, self.common, n - SPAN + 1, SPAN)))
        else:
            cells = sketch(self.hashes)
        self.fingerprint = fingerprint_of(self.hashes, cells)

    def edit(self, following: str) -> tuple[PrefixHashes, str]:
        n = self.hashes.n
        keep = _kept(n)
        mixed = self.hashes.edited(keep, following[: n - keep])
        if n >= SPAN and mixed.n >= SPAN:
            cells = finish(np.minimum(self.low, least(mixed, self.common, mixed.n - SPAN + 1, SPAN)))
        else:
            cells = sketch(mixed)
        return mixed, fingerprint_of(mixed, cells)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part, extras last: each row meets the one that follows it."""
    held, print_of = None, _Print

    def row(now: _Print, doc, then: _Print):
        mixed, other = now.edit(then.text)
        return (
            doc, now.hashes.n, hashlib.sha256(edit(now.text, then.text).encode("utf-8", "surrogatepass")).hexdigest(), now.fingerprint,
            other, likeness(now.fingerprint, other), likeness(now.fingerprint, then.fingerprint), longest_common_extension(now.hashes, 0, mixed, 0),
        )

    for batch in batches:
        out: list[list] = [[] for _ in OUT]
        for part, extra, doc, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            now = print_of(text)
            if held and held[0] == part:
                for col, x in zip(out, row(held[2], held[1], now)):
                    col.append(x)
                held = None
            if not extra:
                held = (part, doc, now)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, OUT)], schema=OUT)


def fingerprint(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprint every whole text and its edited text, and compare each with the one that follows.

    Documents are dealt by doc_id into ranges; only the first row of each range is sent twice, so a
    text crosses the network once.  Rows that repeat a doc_id, or lack one, are numbered first, in the
    order of doc_id (nulls first) and their texts' hashes, so that they can be dealt too; a null text is
    empty; a single row is followed by itself; an empty table gives no rows; extra columns are ignored.
    Equal texts have equal fingerprints.
    """
    spark = docs.sparkSession
    tune(spark)
    base, back = unique_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_text().alias("text")), ["text"])
    if parts is None:
        parts = min(4000, max(2, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    got = base.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts).alias("b")).first()
    bounds = sorted(set(got.b or []))
    part = _part_of(bounds).cast("int")
    # one row a part, at most `parts` of them
    firsts = base.select(part.alias("part"), "doc_id").groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id")).alias("m")).collect()
    firsts = sorted((r.part, r.m.doc_id) for r in firsts)
    before = [(doc, firsts[i - 1][0]) for i, (_, doc) in enumerate(firsts)]
    lead = spark.createDataFrame(before, "first_id long, before int")
    dealt = (
        base.withColumn("part", part)
        .join(F.broadcast(lead), F.col("doc_id").eqNullSafe(F.col("first_id")), "left")
        .withColumn("to", F.when(F.col("before").isNull(), F.array(F.struct(F.col("part"), F.lit(0).alias("extra"))))
                    .otherwise(F.array(F.struct(F.col("part"), F.lit(0).alias("extra")), F.struct(F.col("before").alias("part"), F.lit(1).alias("extra")))))
        .select(F.inline("to"), "doc_id", "text")
    )
    out = (
        dealt.repartition(max(1, len(firsts)), "part")
        .sortWithinPartitions("part", "extra", "doc_id")
        .mapInArrow(_pairs, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long")
    )
    if back is not None:
        out = out.join(back, "doc_id").select(F.col("old_id").alias("doc_id"), *out.columns[1:])
    return out


def fingerprint_sql(steps: int = 512) -> str:
    """The same in SQL, span by span without prefix arrays, for unique ids and texts of up to `steps` ** 2 code points."""
    p, word = int(P), 1 << 64
    powers = [f"u{k} AS (SELECT 0 AS i, 1::BIGINT AS x UNION ALL SELECT i + 1, x * {int(b)} % {p} FROM u{k} WHERE i < {steps - 1})" for k, b in enumerate(BASES)]
    powers += [f"v{k} AS (SELECT 0 AS i, 1::BIGINT AS x UNION ALL SELECT i + 1, x * {pow(int(b), steps, p)} % {p} FROM v{k} WHERE i < {steps - 1})" for k, b in enumerate(BASES)]
    whole = ", ".join(f"(sum(c * (u{k}.x * v{k}.x % {p}) % {p}) % {p})::BIGINT AS r{k}" for k in (0, 1))
    tables = " ".join(f"JOIN u{k} ON u{k}.i = c.i % {steps} JOIN v{k} ON v{k}.i = c.i // {steps}" for k in (0, 1))
    spans = ", ".join("(" + " + ".join(f"coalesce(lead(c, {j}, 0) OVER w, 0) * {pow(int(b), j, p)} % {p}" for j in range(SPAN)) + f") % {p} AS r{k}" for k, b in enumerate(BASES))

    def scramble(x: str) -> str:
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = f"((xor({x}, {x} >> {shift})::UHUGEINT * {factor}::UHUGEINT) % {word}::UHUGEINT)::UBIGINT"
        return f"xor({x}, {x} >> 31)"

    shift, cells = 64 - (CELLS - 1).bit_length(), CELLS
    return f"""WITH RECURSIVE {", ".join(powers)},
    d AS (SELECT doc_id, coalesce(text, '') AS text, lead(coalesce(text, '')) OVER w AS then_, first_value(coalesce(text, '')) OVER w AS head FROM documents WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    e AS MATERIALIZED (SELECT doc_id, text, length(text) AS n, substr(text, 1, length(text) - length(text) // 4) || substr(coalesce(then_, head), 1, length(text) // 4) AS edited, doc_id AS id FROM d),
    t AS (SELECT doc_id, 0 AS kind, text FROM e UNION ALL SELECT doc_id, 1, edited FROM e),
    l AS (SELECT doc_id, kind, list_transform(regexp_extract_all(text, '(?s).'), lambda ch: unicode(ch)::BIGINT + 1) AS cs FROM t),
    c AS MATERIALIZED (SELECT doc_id, kind, len(cs) AS n, unnest(cs) AS c, unnest(range(len(cs))) AS i FROM l),
    whole AS (SELECT doc_id, kind, (r0 << 31) | r1 AS h FROM (SELECT doc_id, kind, {whole} FROM c {tables} GROUP BY doc_id, kind)),
    s AS (SELECT DISTINCT doc_id, kind, ((r0 << 31) | r1)::UBIGINT AS x FROM (SELECT doc_id, kind, i, n, {spans} FROM c WINDOW w AS (PARTITION BY doc_id, kind ORDER BY i)) WHERE i <= greatest(n - {SPAN}, 0)),
    low AS (SELECT doc_id, kind, (h >> {shift})::INT AS cell, min(h) AS h FROM (SELECT doc_id, kind, {scramble("s.x")} AS h FROM s) GROUP BY ALL),
    f AS (SELECT doc_id, kind, list(h ORDER BY cell) AS hs, list(cell ORDER BY cell) AS at_ FROM low GROUP BY doc_id, kind),
    q AS (SELECT doc_id, kind, cell, CASE WHEN list_contains(at_, cell) THEN hs[list_position(at_, cell)] ELSE NULL END AS own, (hs[(cell * 40503 + 17) % len(hs) + 1]::UHUGEINT + cell::UHUGEINT) % {word}::UHUGEINT AS near_ FROM f, range({cells}) x(cell)),
    b AS (SELECT doc_id, kind, cell, lower(lpad(hex(coalesce(own, {scramble("q.near_::UBIGINT")}) % 65536), 4, '0')) AS x FROM q),
    k AS (SELECT doc_id, kind, string_agg(x, '' ORDER BY cell) AS sketch, list(x ORDER BY cell) AS xs FROM b GROUP BY doc_id, kind),
    z AS MATERIALIZED (SELECT t.doc_id, t.kind, lower(lpad(hex(coalesce(h, 0)), 16, '0')) AS h, coalesce(sketch, repeat('0000', {cells})) AS sketch, coalesce(xs, list_transform(range({cells}), lambda i: '0000')) AS xs
        FROM t LEFT JOIN whole USING (doc_id, kind) LEFT JOIN k USING (doc_id, kind)),
    m AS (SELECT doc_id, coalesce(lead(doc_id) OVER (ORDER BY doc_id), (SELECT min(doc_id) FROM e)) AS next FROM e),
    p AS (SELECT e.doc_id, e.n, e.text, e.edited, a.h || a.sketch AS fp, y.h || y.sketch AS efp, a.h = y.h AS same_e, a.h = g.h AS same_n,
        list_sum(list_transform(list_zip(a.xs, y.xs), lambda r: (r[1] = r[2])::INT))::DOUBLE / {cells} AS je, list_sum(list_transform(list_zip(a.xs, g.xs), lambda r: (r[1] = r[2])::INT))::DOUBLE / {cells} AS jn
        FROM e JOIN m USING (doc_id) JOIN z a ON a.doc_id = e.doc_id AND a.kind = 0 JOIN z y ON y.doc_id = e.doc_id AND y.kind = 1 JOIN z g ON g.doc_id = m.next AND g.kind = 0),
    w AS (SELECT x.doc_id, min(x.i) AS first FROM c x LEFT JOIN c y ON y.doc_id = x.doc_id AND y.kind = 1 AND y.i = x.i WHERE x.kind = 0 AND x.c IS DISTINCT FROM y.c GROUP BY x.doc_id)
    SELECT p.doc_id, n AS n_chars, sha256(encode(edited)) AS edited_sha256, fp AS fingerprint, efp AS edited_fingerprint, CASE WHEN same_e THEN 1.0::DOUBLE ELSE 2 * je / (1 + je) END AS near_edited,
        CASE WHEN same_n THEN 1.0::DOUBLE ELSE 2 * jn / (1 + jn) END AS near_next, coalesce(first, n) AS common_prefix
    FROM p LEFT JOIN w USING (doc_id)"""
