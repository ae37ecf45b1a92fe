"""Exact substring dedup by a blockwise suffix array with a difference cover.

A byte goes if it lies in a LENGTH-byte string that also starts in a document with a smaller id.

1. Exact copies of a whole text are found by digest; only the first stays in the suffix array.
2. Cover ranks.  Positions whose number modulo V lies in the difference cover D are samples.  Any two
   positions p, q have a shift d < V with p + d and q + d both samples, so two equal strings of
   LENGTH bytes share a sample string of LENGTH - V + 1 bytes.  Samples are ranked once, globally: a
   suffix none of whose samples is tied with another can't be tied itself and leaves the array.
3. The suffixes left are sorted one bucket at a time: a bucket is a range of leading bytes, chosen
   from a histogram so that each holds about the same share.  Each pass sorts its bucket inside every
   block of text: word by word for the first V bytes and on, except that a long tie whose members have
   a shift in common is settled at once by the ranks of the cover samples there, which were computed
   once for the block (for two suffixes there always is one).  The blocks' sorted, distinct strings
   are then compared by a 96-bit digest, range by range.  Shuffle files of a pass go before the next
   begins, which bounds disk as well as memory.
4. Flags return to the blocks as bit masks in sort order, and become runs of removed bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, as_text, narrow_batches, release, spare, tune, unique_ids

LENGTH = 50
V = 31
#: A perfect difference set modulo 31.
COVER = (0, 1, 3, 8, 12, 18)
#: Bytes of text in a block, and passes over the suffix buckets.
BLOCK_BYTES, PASSES = 2 << 20, 5

U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def _words(data: np.ndarray, kind: str) -> np.ndarray:
    """Every position's word, unaligned; data ends with at least eight spare bytes."""
    size = np.dtype(kind).itemsize
    return np.ndarray((len(data) - size + 1,), kind, data, strides=(1,))


_ODD = np.random.default_rng(50).integers(1, 1 << 63, (2, 64), dtype=np.uint64) | U(1)


def _digests(data: np.ndarray, at: np.ndarray, length: int, lanes: int) -> list[np.ndarray]:
    """Independent 64-bit hashes of the strings of `length` (8 at least) bytes that start at `at`."""
    eight, out = _words(data, "<u8"), [np.zeros(len(at), U) for _ in range(lanes)]
    for i, k in enumerate([*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]):
        x = eight[at + k]
        x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
        x ^= x >> U(29)
        for lane, h in enumerate(out):
            h += x * _ODD[lane, i]
    return [_mix(h) for h in out]


def _group(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by key, and where a new key begins in it."""
    order = np.argsort(keys)
    s = keys[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    return order, new


class Block:
    """Texts of several documents, end to end, with eight spare bytes."""

    def __init__(self, docs: np.ndarray, lens: np.ndarray, data: bytes):
        self.docs, self.lens = docs, lens
        self.data = np.frombuffer(data + bytes(64), np.uint8)
        self.ends = np.cumsum(lens)
        self.starts = self.ends - lens
        self.n, self._of = int(self.ends[-1]) if len(lens) else 0, None

    def of(self, at: np.ndarray) -> np.ndarray:
        """Number, in the block, of the document at each position."""
        if self._of is None:
            self._of = np.repeat(np.arange(len(self.lens), dtype=np.int32), self.lens)
        return self._of[at]


def cover_samples(block: Block, length: int, v: int, cover: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Sample positions whose string of length - v + 1 bytes ends in their document, and its hashes."""
    gram = length - v + 1
    own = [s + np.arange(d, n - gram + 1, v) for s, n in zip(block.starts.tolist(), block.lens.tolist()) for d in cover if n >= length]
    at = np.concatenate(own) if own else np.zeros(0, np.int64)
    return at, _digests(block.data, at, gram, 1)[0]


class CoverRanks:
    """Ranks of a block's cover samples among themselves, by the LENGTH bytes from each on."""

    def __init__(self, v: int, cover: tuple[int, ...], ranks: np.ndarray):
        self.v, self.ranks, self.size = v, ranks, len(cover)
        self.slot = np.full(v, -1)
        self.slot[list(cover)] = np.arange(len(cover))
        #: by position modulo v: bit d is set if the position d further on is a sample
        self.shifts = np.array([sum(1 << d for d in range(v) if (r + d) % v in cover) for r in range(v)], np.int64)

    @staticmethod
    def places(n: int, v: int, cover: tuple[int, ...]) -> np.ndarray:
        at = (np.arange(0, n + v, v)[:, None] + np.array(sorted(cover))).ravel()
        return at[at < n]

    @classmethod
    def of(cls, block: Block, length: int, v: int, cover: tuple[int, ...]) -> CoverRanks:
        at = cls.places(block.n, v, cover)
        order, new = sorted_strings(block, at, length)
        ranks = np.zeros(len(at), np.uint32)
        ranks[order] = np.cumsum(new) - 1
        return cls(v, cover, ranks)

    def rank(self, at: np.ndarray) -> np.ndarray:
        return self.ranks[at // self.v * self.size + self.slot[at % self.v]].astype(U)


def sorted_strings(block: Block, at: np.ndarray, length: int, ranks: CoverRanks | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sort one bucket of suffixes: the order, and where a new string of `length` bytes begins.

    Most-significant word first; only runs still tied are sorted on by the next word.  Ties longer
    than the cover's period are settled by ranks wherever all members of a run have a shift in common
    to samples; those are then in order for good, and only compared with their neighbours.
    """
    big = _words(block.data, ">u8")
    order, new = _group(big[at].astype(U))
    k = 8
    while k < length:
        tied = ~new
        tied[:-1] |= ~new[1:]
        here = np.nonzero(tied)[0]
        if not len(here):
            break
        begins = new[here]
        run = np.cumsum(begins) - 1
        place = at[order[here]]
        if ranks is not None and k >= ranks.v:
            first = np.nonzero(begins)[0]
            shared = np.bitwise_and.reduceat(ranks.shifts[place % ranks.v], first)
            settled = (shared != 0)[run]
            if settled.any():
                who, low = here[settled], shared[run[settled]]
                shift = np.log2((low & -low).astype(np.float64)).astype(np.int64)
                by = np.argsort((run[settled].astype(U) << U(32)) | ranks.rank(place[settled] + shift))
                order[who] = order[who][by]
                head = new[who]
                there = at[order[who]]
                differs = head.copy()
                for j in [*range(k, length - 7, 8), length - 8]:
                    w = big[there + j]
                    differs[1:] |= w[1:] != w[:-1]
                new[who] = differs
                here, run, place = here[~settled], run[~settled], place[~settled]
                if not len(here):
                    break
            ranks = None  # what is left is read on
            rest, rest_new = here, new[here]
            while k < length and len(rest):
                rest, rest_new = _read_on(big, at, order, new, rest, k, length)
                k += 8
            break
        _read_on(big, at, order, new, here, k, length)
        k += 8
    return order, new


def _read_on(big, at, order, new, here, k: int, length: int):
    """Sort the runs at places `here` by their word at k; returns the places that are still tied."""
    word = big[at[order[here]] + k].astype(U)
    if k + 8 > length:
        word = word >> U(8 * (k + 8 - length))
    begins = new[here]
    run = (np.cumsum(begins) - 1).astype(U)
    by, fresh = _group(word)
    rank = np.empty(len(word), U)
    rank[by] = np.cumsum(fresh) - 1
    by = np.argsort((run << U(32)) | rank)
    order[here] = order[here][by]
    word = word[by]
    fresh = begins.copy()
    fresh[1:] |= word[1:] != word[:-1]
    new[here] = fresh
    tied = ~fresh
    tied[:-1] |= ~fresh[1:]
    return here[tied], fresh[tied]


def _bytes(x: np.ndarray, width: int) -> np.ndarray:
    """A row of the low `width` bytes of each number, lowest first."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]


def _number(records: np.ndarray) -> np.ndarray:
    """The number of each row of at most eight bytes."""
    out = np.zeros((len(records), 8), np.uint8)
    out[:, : records.shape[1]] = records
    return out.reshape(-1).view("<u8")


BLOCKS = pa.schema([("block", pa.int64()), ("docs", pa.binary()), ("lens", pa.binary()), ("data", pa.binary())])
BLOCKS_DDL = "block long, docs binary, lens binary, data binary"


def _block_rows(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, count, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def out():
            docs, data = [d for d, _ in held], [x for _, x in held]
            return pa.RecordBatch.from_arrays(
                [pa.array([base + count]), pa.array([np.array(docs, "<i8").tobytes()]), pa.array([np.array([len(x) for x in data], "<i8").tobytes()]), pa.array([b"".join(data)], pa.binary())],
                schema=BLOCKS,
            )

        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append((doc, data))
                size += len(data)
                if size >= block_bytes:
                    yield out()
                    count, held, size = count + 1, [], 0
        if held:
            yield out()

    return run


def _load(row: dict) -> Block:
    return Block(np.frombuffer(row["docs"], "<i8"), np.frombuffer(row["lens"], "<i8"), row["data"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}


SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("base", pa.int64())])
SENT_DDL = "bucket int, block long, n int, keys binary, base long"
#: Bytes of keys in an Arrow batch that is sent.
SENT_BYTES = 1 << 20
MASK = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("mask", pa.binary())])
MASK_DDL = "block long, bucket int, mask binary"


def _by_bucket(order: np.ndarray, bucket: np.ndarray, buckets: int) -> list[np.ndarray]:
    """order split by bucket; the order within a bucket stays."""
    narrow = bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket  # 16 bits are sorted by counting
    by = order[np.argsort(narrow[order], kind="stable")]
    return np.split(by, np.cumsum(np.bincount(bucket, minlength=buckets))[:-1])


def _sent(block: int, bucket: np.ndarray, buckets: int, records: np.ndarray, base: int | None = None) -> Iterator[pa.RecordBatch]:
    """A block's records by bucket, each bucket's in their order; buckets without any have no row."""
    counts = np.bincount(bucket, minlength=buckets)
    some = np.nonzero(counts)[0]
    data = records[np.concatenate(_by_bucket(np.arange(len(bucket)), bucket, buckets))]
    ends = np.cumsum(counts[some]) * records.shape[1]
    begin = 0
    while begin < len(some):
        low = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, low + SENT_BYTES, side="right")))
        offsets = np.append(0, ends[begin:end] - low).astype("<i4")
        keys = pa.Array.from_buffers(pa.binary(), end - begin, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.reshape(-1)[low : ends[end - 1]].tobytes())])
        own = some[begin:end]
        yield pa.RecordBatch.from_arrays(
            [pa.array(own.astype(np.int32)), pa.array(np.full(len(own), block, np.int64)), pa.array(counts[own].astype(np.int32)), keys, pa.array([base] * len(own), pa.int64())], schema=SENT
        )
        begin = end


def _records(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The records of rows that were sent, and how many each row has; narrower ones are filled up with zeros."""
    ns, blobs = table["n"].to_numpy().astype(np.int64), table["keys"].to_pylist()
    widths = np.array([len(x) for x in blobs]) // ns
    most = int(widths.max())
    if (widths == most).all():
        return np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, most), ns
    out = np.zeros((ns.sum(), most), np.uint8)
    for end, n, width, blob in zip(np.cumsum(ns).tolist(), ns.tolist(), widths.tolist(), blobs):
        out[end - n : end, :width] = np.frombuffer(blob, np.uint8).reshape(n, width)
    return out, ns


def _distinct_samples(block: Block, length: int, v: int, cover: tuple[int, ...]):
    """Samples and their hashes; the distinct hashes in order; whether several documents have each."""
    at, h = cover_samples(block, length, v, cover)
    order, new = _group(h)
    first = np.nonzero(new)[0]
    doc = block.of(at)[order]
    back = np.empty(len(h), np.int64)
    back[order] = np.cumsum(new) - 1
    several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first) if len(first) else np.zeros(0, bool)
    return at, back, h[order[first]], several


def _send_samples(buckets: int, length: int, v: int, cover: tuple[int, ...]):
    def run(batches):
        spare()
        for row in _rows(batches):
            block = _load(row)
            _, _, values, _ = _distinct_samples(block, length, v, cover)
            yield from _sent(row["block"], (values % U(buckets)).astype(np.int64), buckets, _bytes(values >> U(16), 6))

    return run


def _tied_samples(table: pa.Table) -> pa.Table:
    """Of one bucket: which hashes are also in another block."""
    spare()
    records, ns = _records(table)
    keys = _number(records)
    order, new = _group(keys)
    tied = ~new
    tied[:-1] |= ~new[1:]
    flag = np.zeros(len(keys), bool)
    flag[order] = tied
    return _masks(table, ns, flag)


def _masks(table: pa.Table, ns: np.ndarray, flag: np.ndarray) -> pa.Table:
    """Flags by block and bucket; where none is set there is no row."""
    ends = np.cumsum(ns)
    some = np.nonzero(np.logical_or.reduceat(flag, ends - ns))[0]
    masks = [np.packbits(flag[e - n : e]).tobytes() for e, n in zip(ends[some].tolist(), ns[some].tolist())]
    return pa.table([table["block"].combine_chunks().take(pa.array(some)), table["bucket"].combine_chunks().take(pa.array(some)), pa.array(masks, pa.binary())], schema=MASK)


REGIONS_DDL = "block long, docs binary, lens binary, data binary, region_doc binary, region_start binary, leads binary, ranks binary"
REGIONS = pa.schema([(n.split()[0], pa.int64() if n.endswith("long") else pa.binary()) for n in REGIONS_DDL.split(", ")])


def _cut_regions(buckets: int, length: int, v: int, cover: tuple[int, ...]):
    """Blocks with their tied samples -> the stretches of text in which a suffix can be tied."""

    def run(key, blocks: pa.Table, masks: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return REGIONS.empty_table()
        spare()
        block = _load({n: blocks[n][0].as_py() for n in ("docs", "lens", "data")})
        at, back, values, tied = _distinct_samples(block, length, v, cover)
        bucket = (values % U(buckets)).astype(np.int64)
        split = _by_bucket(np.arange(len(values)), bucket, buckets)
        for b, mask in zip(masks["bucket"].to_pylist(), masks["mask"].to_pylist()):
            own = split[b]
            tied[own] |= np.unpackbits(np.frombuffer(mask, np.uint8))[: len(own)].astype(bool)
        hit = np.sort(at[tied[back]])
        doc = block.of(hit)
        # a suffix may be tied if a tied sample lies within the v bytes from its start on
        low, high = np.maximum(hit - (v - 1), block.starts[doc]), np.minimum(hit + 1, block.ends[doc] - (length - 1))
        low, high = low[low < high], high[low < high]
        fresh = np.ones(len(low), bool)
        fresh[1:] = low[1:] > high[:-1]
        first = np.nonzero(fresh)[0]
        begin, end = low[first], high[np.append(first[1:], len(low))[: len(first)] - 1] + (length - 1)
        if not len(begin):
            return REGIONS.empty_table()
        # runs of one document whose texts touch or overlap are one region
        doc = block.of(begin)
        fresh = np.ones(len(begin), bool)
        fresh[1:] = (begin[1:] > end[:-1]) | (doc[1:] != doc[:-1])
        first = np.nonzero(fresh)[0]
        begin, end, doc = begin[first], np.maximum.reduceat(end, first), doc[first]
        text = b"".join(block.data[b:e].tobytes() for b, e in zip(begin.tolist(), end.tolist()))
        keep = np.unique(doc)
        start = begin - block.starts[doc]
        region = Block(block.docs[doc], end - begin, text)
        lead = _leads(region)[_suffixes(region, length)]
        leads = sum(np.bincount(lead[k : k + SLICE], minlength=4096) for k in range(0, len(lead), SLICE))
        return pa.table(
            [
                pa.array([blocks["block"][0].as_py()]), pa.array([block.docs[keep].astype("<i8").tobytes()]), pa.array([region.lens.astype("<i8").tobytes()]),
                pa.array([text], pa.binary()), pa.array([np.searchsorted(keep, doc).astype("<i4").tobytes()]), pa.array([start.astype("<i8").tobytes()]), pa.array([leads.astype("<i8").tobytes()]),
                pa.array([CoverRanks.of(region, length, v, cover).ranks.tobytes()]),
            ],
            schema=REGIONS,
        )

    return run


#: Positions that are counted at a time.
SLICE = 1 << 18


def _leads(region: Block) -> np.ndarray:
    """The leading bits of the suffix at each position."""
    return _words(region.data, ">u2")[: region.n] >> 4


def _suffixes(region: Block, length: int, low: int = 0, high: int = 4096) -> np.ndarray:
    """Positions with `length` bytes left in their region, and a lead from `low` to below `high`."""
    if not region.n:
        return np.zeros(0, np.int64)
    lead = _leads(region)
    ok = (lead >= low) & (lead < high)
    for s, e in zip(region.starts.tolist(), region.ends.tolist()):
        ok[max(s, e - length + 1) : e] = False
    return np.nonzero(ok)[0]


def _bucket_strings(row: dict, low: int, high: int, length: int, v: int, cover: tuple[int, ...]):
    """One suffix bucket of a block: sorted distinct strings, the smallest document of each, all places.

    Returns places in sort order, the string number of each, each string's first place, and the ranks
    of documents among the block's ids: by place, and the smallest by string.
    """
    region = Block(np.frombuffer(row["region_doc"], "<i4").astype(np.int64), np.frombuffer(row["lens"], "<i8"), row["data"])
    at = _suffixes(region, length, low, high)
    order, new = sorted_strings(region, at, length, CoverRanks(v, cover, np.frombuffer(row["ranks"], np.uint32)))
    at = at[order]
    names = np.frombuffer(row["docs"], "<i8")
    rank = np.empty(len(names), np.int32)
    rank[np.argsort(names)] = np.arange(len(names))
    ids = rank[region.docs][region.of(at)]
    number = np.cumsum(new) - 1
    first = np.nonzero(new)[0]
    least = np.minimum.reduceat(ids, first) if len(first) else np.zeros(0, np.int32)
    return region, at, number, at[first], ids, least


def _send_strings(buckets: int, low: int, high: int, length: int, v: int, cover: tuple[int, ...]):
    def run(batches):
        spare()
        for row in _rows(batches):
            region, at, number, first, ids, least = _bucket_strings(row, low, high, length, v, cover)
            if not len(first):
                continue
            # a document is told by its distance from the block's smallest, in as many bytes as the block needs
            ordered = np.sort(np.frombuffer(row["docs"], "<i8"))
            far = ordered.view(U) - ordered[:1].view(U)
            a, b = _digests(region.data, first, length, 2)
            records = np.hstack([_bytes(a, 8), _bytes(b, 4), _bytes(far[least], (int(far[-1]).bit_length() + 7) // 8)])
            yield from _sent(row["block"], (a % U(buckets)).astype(np.int64), buckets, records, int(ordered[0]))

    return run


def _tied_strings(table: pa.Table) -> pa.Table:
    """Of one range of digests: which blocks' strings start in a document smaller than the block's own."""
    spare()
    records, ns = _records(table)
    a, b = _number(records[:, :8]), _number(records[:, 8:12])
    ids = (_number(records[:, 12:]) + np.repeat(table["base"].to_numpy().view(U), ns)).view(np.int64)
    order, new = _group(a)
    other = b[order]
    if (~new[1:] & (other[1:] != other[:-1])).any():  # 64 bits agree and 32 more don't
        order = np.lexsort((b, a))
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    least = np.minimum.reduceat(ids[order], np.nonzero(new)[0])[np.cumsum(new) - 1]
    flag = np.zeros(len(order), bool)
    flag[order] = least < ids[order]
    return _masks(table, ns, flag)


SPANS = pa.schema([("doc_id", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
SPANS_DDL = "doc_id long, starts array<long>, ends array<long>"


def _find_spans(buckets: int, bounds: list[int], length: int, v: int, cover: tuple[int, ...]):
    def run(key, regions: pa.Table, masks: pa.Table) -> pa.Table:
        if not regions.num_rows:
            return SPANS.empty_table()
        spare()
        row = {n: regions[n][0].as_py() for n in regions.schema.names}
        got = {(p, b): m for p, b, m in zip(masks["pass"].to_pylist(), masks["bucket"].to_pylist(), masks["mask"].to_pylist())}
        hit, region = [], None
        for p, (low, high) in enumerate(zip(bounds, bounds[1:])):
            region, at, number, first, ids, least = _bucket_strings(row, low, high, length, v, cover)
            if not len(first):
                continue
            elsewhere = np.zeros(len(first), bool)
            bucket = (_digests(region.data, first, length, 1)[0] % U(buckets)).astype(np.int64)
            for k, own in enumerate(_by_bucket(np.arange(len(first)), bucket, buckets)):
                if (mask := got.get((p, k))) is not None:
                    elsewhere[own] = np.unpackbits(np.frombuffer(mask, np.uint8))[: len(own)].astype(bool)
            hit.append(at[elsewhere[number] | (ids > least[number])])
        hit = np.sort(np.concatenate(hit)) if hit else np.zeros(0, np.int64)
        if not len(hit):
            return SPANS.empty_table()
        place = region.of(hit)
        doc = region.docs[place]
        at = hit - region.starts[place] + np.frombuffer(row["region_start"], "<i8")[place]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + length)
        first = np.nonzero(fresh)[0]
        last = np.append(first[1:], len(at)) - 1
        begin, end, doc = at[first], at[last] + length, doc[first]
        cut = np.nonzero(np.diff(doc))[0] + 1
        who = np.frombuffer(row["docs"], "<i8")[doc[np.append(0, cut)]]
        return pa.table([pa.array(who), pa.array(np.split(begin, cut), pa.list_(pa.int64())), pa.array(np.split(end, cut), pa.list_(pa.int64()))], schema=SPANS)

    return run


def _balanced(counts: np.ndarray, passes: int) -> list[int]:
    """Bounds of `passes` ranges of leads with about equal counts."""
    total = np.cumsum(counts)
    cuts = np.searchsorted(total, total[-1] * np.arange(1, passes) / passes, side="left") + 1 if len(total) and total[-1] else []
    return sorted({0, len(counts), *map(int, cuts)})


def removed_spans(texts: DataFrame, length: int = LENGTH, v: int = V, cover: tuple[int, ...] = COVER, block_bytes: int = BLOCK_BYTES, passes: int = PASSES) -> Stored | None:
    """Runs of bytes to remove from rows (doc_id, data): doc_id, starts, ends.  doc_id is unique.

    Buckets grow with the input, so that what one task sorts stays bounded; a block is sent to them
    with nothing but its strings' digests and documents, so that what one task reads stays bounded too.
    """
    with narrow_batches(texts.sparkSession, 4 << 20, 16):
        return _removed_spans(texts, length, v, cover, block_bytes, passes)


def _removed_spans(texts: DataFrame, length: int, v: int, cover: tuple[int, ...], block_bytes: int, passes: int) -> Stored | None:
    spark = texts.sparkSession
    blocks = Stored(texts.filter(F.length("data") >= length).select("doc_id", "data").mapInArrow(_block_rows(block_bytes), BLOCKS_DDL), "suffix-blocks", large_rows=True)
    total = blocks.read().agg(F.sum(F.length("data"))).first()[0] or 0
    if not total:
        return None
    buckets = max(4, -(-total // (8 << 20)))
    sent = blocks.read().select("block", "docs", "lens", "data").mapInArrow(_send_samples(buckets, length, v, cover), SENT_DDL)
    masks = Stored(sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_tied_samples, MASK_DDL), "suffix-ties")
    release(spark)
    cut = blocks.read().groupBy("block").cogroup(masks.read().groupBy("block")).applyInArrow(_cut_regions(buckets, length, v, cover), REGIONS_DDL)
    regions = Stored(cut, "suffix-regions", large_rows=True)
    blocks.drop()
    masks.drop()
    release(spark)
    # 4,096 counts from each block, summed in the tasks and then by lead
    leads = regions.read().select("leads").mapInArrow(_sum_leads, "lead int, n long").groupBy("lead").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(4096, np.int64)
    for r in leads:
        counts[r.lead] = r.n
    if not counts.sum():
        regions.drop()
        return None
    bounds = _balanced(counts, passes)
    buckets = max(4, -(-int(counts.sum()) // (500_000 * (len(bounds) - 1))))
    found = []
    for k, (low, high) in enumerate(zip(bounds, bounds[1:])):
        sent = regions.read().mapInArrow(_send_strings(buckets, low, high, length, v, cover), SENT_DDL)
        tied = sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_tied_strings, MASK_DDL)
        found.append(Stored(tied.withColumn("pass", F.lit(k)), "suffix-strings"))
        release(spark)
    masks = found[0].read()
    for x in found[1:]:
        masks = masks.unionByName(x.read())
    spans = Stored(regions.read().groupBy("block").cogroup(masks.groupBy("block")).applyInArrow(_find_spans(buckets, bounds, length, v, cover), SPANS_DDL), "suffix-spans")
    for x in (regions, *found):
        x.drop()
    release(spark)
    return spans


def _sum_leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(4096, np.int64)
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            total += np.frombuffer(blob, "<i8")
    some = np.nonzero(total)[0]
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["lead", "n"])


def copies(docs: DataFrame) -> DataFrame:
    """doc_id of each document whose whole text also stands in a document with a smaller id."""
    light = docs.select("doc_id", F.unhex(F.md5("text")).alias("key"), F.octet_length("text").alias("n"))
    first = light.groupBy("key", "n").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")).filter("c > 1").drop("c")
    return light.join(first, ["key", "n"]).filter("doc_id > first").select("doc_id")


def _cut(data: bytes, starts, ends, length: int) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed, and their runs.  An end of -1 is a copy's: all goes."""
    if not starts or ends[0] == -1 and len(data) < length:
        return data, 0, 0
    parts, at, removed = [], 0, 0
    for s, e in zip(starts, ends):
        e = len(data) if e == -1 else e
        parts.append(data[at:s])
        at, removed = e, removed + e - s
    return b"".join([*parts, data[at:]]), removed, len(starts)


def _marked(base: DataFrame, length: int, block_bytes: int, passes: int) -> DataFrame:
    """base (unique doc_id, text, ...) with the starts and ends of what goes from each text."""
    twins = Stored(copies(base), "suffix-copies")
    texts = base.join(twins.read(), "doc_id", "left_anti").select("doc_id", F.col("text").cast("binary").alias("data"))
    spans = removed_spans(texts, length, block_bytes=block_bytes, passes=passes)
    marked = twins.read().select("doc_id", F.array(F.lit(0).cast("long")).alias("starts"), F.array(F.lit(-1).cast("long")).alias("ends"))
    return base.join(marked.unionByName(spans.read()) if spans is not None else marked, "doc_id", "left")


def dedup(docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES, passes: int = PASSES) -> DataFrame:
    """Remove every byte covered by a `length`-byte string that also starts in a smaller document.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes left).  A null or empty
    text gives 0 bytes; texts shorter than `length` stay whole; rows that repeat a doc_id, or lack
    one, count as documents of their own in the order of doc_id (nulls first) and text hash; an empty
    table gives no rows; extra columns are ignored.
    """
    tune(docs.sparkSession)
    base, back = unique_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_text().alias("text")), ["text"])
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def finish(batches):
        for batch in batches:
            out = [[] for _ in schema]
            for doc, data, starts, ends in zip(*(batch.column(i).to_pylist() for i in range(4))):
                kept, removed, runs = _cut(data, starts, ends, length)
                for col, x in zip(out, (doc, len(data), removed, runs, hashlib.sha256(kept).hexdigest())):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    rows = _marked(base, length, block_bytes, passes).select("doc_id", F.col("text").cast("binary").alias("data"), "starts", "ends")
    out = rows.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    if back is not None:
        names = out.columns
        out = out.join(back, "doc_id").drop("doc_id").withColumnRenamed("old_id", "doc_id").select(names)
    return out


def without_repeats(docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES, passes: int = PASSES) -> DataFrame:
    """The same rows and columns with the bytes that `dedup` removes gone from text.

    A character that loses some of its bytes goes whole; n_chars, if there, is counted anew.
    """
    tune(docs.sparkSession)
    rest = [c for c in docs.columns if c != "text"]
    carried = F.struct(*[F.col(f"`{c}`") for c in rest])
    base, _ = unique_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_text().alias("text"), carried.alias("carried")), ["text", "carried"])

    def finish(batches):
        for batch in batches:
            texts = [_cut(*x, length)[0].decode("utf-8", "ignore") for x in zip(*(batch.column(i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(3)], names=["text", "carried"])

    rows = _marked(base, length, block_bytes, passes).select(F.col("text").cast("binary").alias("data"), "starts", "ends", "carried")
    kind = base.schema["carried"].dataType
    from pyspark.sql.types import StringType, StructType

    out = rows.mapInArrow(finish, StructType().add("text", StringType()).add("carried", kind))
    named = {c: F.col(f"carried.`{c}`").alias(c) for c in rest} | {"text": F.col("text")}
    if "n_chars" in named:
        named["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*[named[c] for c in docs.columns])


def dedup_sql(length: int = LENGTH, step: int = 1024) -> str:
    """The same by grouping every string of `length` bytes, for unique ids; texts are read in steps as hexadecimal digits."""
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
    p AS (SELECT doc_id, n, c, substr(h, 2 * c + 1, {2 * (step + length - 1)}) AS piece FROM (SELECT doc_id, h, n, unnest(range(0, n - {length - 1}, {step})) AS c FROM d)),
    s AS (SELECT doc_id, c + j AS spot, substr(piece, 2 * j + 1, {2 * length}) AS g FROM (SELECT doc_id, c, piece, unnest(range(least({step}, n - {length - 1} - c))) AS j FROM p)),
    f AS (SELECT doc_id, spot FROM (SELECT doc_id, spot, min(doc_id) OVER (PARTITION BY g) AS first FROM s) WHERE first < doc_id),
    o AS (SELECT doc_id, spot, coalesce(spot > lag(spot) OVER w + {length}, true) AS fresh FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY spot)),
    q AS (SELECT doc_id, spot, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY spot) AS run FROM o),
    runs AS (SELECT doc_id, run, min(spot) AS b, max(spot) + {length} AS e FROM q GROUP BY doc_id, run),
    cut AS (SELECT doc_id, run, lag(e, 1, 0) OVER w AS from_, b AS to_ FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY run)
        UNION ALL SELECT d.doc_id, 1000000000, coalesce(max(e), 0), any_value(n) FROM d LEFT JOIN runs USING (doc_id) GROUP BY d.doc_id),
    kept AS (SELECT doc_id, string_agg(substr(h, 2 * from_ + 1, 2 * (to_ - from_)), '' ORDER BY run) AS h FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
    SELECT d.doc_id, d.n AS n_bytes, (d.n - strlen(kept.h) // 2)::BIGINT AS n_removed, (SELECT count(*) FROM runs WHERE runs.doc_id = d.doc_id) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
    FROM d JOIN kept USING (doc_id)"""
