"""Suffix-array dedup against brute force; the sort against Python's."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from seqloom.llm import packing
from seqloom.llm import suffixes as S
from seqloom.llm.common import narrow_batches, spare


def brute(data, length=50):
    """By row number: bytes, removed, spans, kept.  data: (key, bytes) in order of documents."""
    first = {}
    for k, b in data:
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], k)
    out = []
    for k, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] != k:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def test_cover():
    assert {(a - b) % S.V for a in S.COVER for b in S.COVER} == set(range(S.V))


@pytest.mark.parametrize("alphabet,n", [("ab", 400), ("a", 300), ("abcdefgh", 2000), ("ab\xe9", 1500)])
def test_sorted_strings(alphabet, n):
    r = random.Random(n)
    piece = "".join(r.choice(alphabet) for _ in range(90))
    text = "".join(piece[: r.randrange(40, 90)] + r.choice(alphabet) for _ in range(n // 60)).encode("latin-1")
    block = S.Block(np.arange(1), np.array([len(text)]), text)
    at = np.arange(len(text) - 49)
    for ranks in (None, S.CoverRanks.of(block, 50, S.V, S.COVER)):
        order, new = S.sorted_strings(block, at, 50, ranks)
        strings = [text[p : p + 50] for p in at[order].tolist()]
        assert strings == sorted(strings)
        assert new.tolist() == [i == 0 or strings[i] != strings[i - 1] for i in range(len(strings))]


def passages(n=60, seed=2):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randrange(2, 9)))
    shared = [" ".join(word() for _ in range(r.randrange(5, 40))) for _ in range(8)]
    out = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(r.randrange(0, 20)))]
        for _ in range(r.randrange(0, 4)):
            s = r.choice(shared)
            a = r.randrange(0, max(1, len(s) // 2))
            parts += [s[a:], " ".join(word() for _ in range(r.randrange(0, 6)))]
        out.append((i, " ".join(parts)))
    return out + [(n, out[3][1]), (n + 1, "x" * 49), (n + 2, "x" * 50), (n + 3, "x" * 51), (n + 4, "x" * 200)]


@pytest.mark.parametrize("block_bytes,passes", [(1 << 20, 1), (1500, 4)])
def test_dedup(spark, block_bytes, passes):
    data = passages()
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in S.dedup(df, block_bytes=block_bytes, passes=passes).collect()}
    want = brute([(d, t.encode()) for d, t in data])
    assert got == {d: (n, m, k, hashlib.sha256(kept).hexdigest()) for (d, _), (n, m, k, kept) in zip(data, want)}
    assert sum(w[1] for w in want)
    left = {r.doc_id: r.text for r in S.without_repeats(df, block_bytes=block_bytes, passes=passes).collect()}
    assert left == {d: kept.decode("utf-8", "ignore") for (d, _), (*_, kept) in zip(data, want)}


def test_whole_table(documents, rows):
    got = {r.doc_id: tuple(r)[1:] for r in S.dedup(documents).collect()}
    want = brute([(d, (t or "").encode()) for d, t in sorted(rows)])
    assert got == {d: (n, m, k, hashlib.sha256(kept).hexdigest()) for (d, _), (n, m, k, kept) in zip(sorted(rows), want)}


def test_odd(odd, nothing):
    df, data = odd
    got = S.dedup(df).collect()
    assert sorted((r.doc_id or -1, r.n_bytes) for r in got) == sorted((d or -1, len((t or "").encode())) for d, t in data)
    # a null id comes first, so of the three equal texts only its own stays
    assert sorted((r.doc_id or -1, r.n_removed > 0) for r in got if r.doc_id in (None, 6) and r.n_bytes) == [(-1, False), (6, True), (6, True), (6, True)]
    assert S.dedup(nothing).count() == 0 and S.without_repeats(nothing).count() == 0
    assert S.without_repeats(df).columns == df.columns and S.without_repeats(df).count() == len(data)


def test_sent():
    """What a bucket reads is its strings alone: records come back by bucket and in order, without the block's documents."""
    r = np.random.default_rng(3)
    bucket, records = r.integers(0, 9, 500), r.integers(0, 256, (500, 15)).astype(np.uint8)
    bucket[bucket == 4] = 5
    sent = pa.Table.from_batches(S._sent(7, bucket, 9, records, -5), S.SENT)
    assert sent["bucket"].to_pylist() == [0, 1, 2, 3, 5, 6, 7, 8] and set(sent["block"].to_pylist()) == {7} and set(sent["base"].to_pylist()) == {-5}
    assert sent["keys"].to_pylist() == [records[bucket == k].tobytes() for k in sent["bucket"].to_pylist()]
    back, ns = S._records(sent)
    assert back.tobytes() == b"".join(sent["keys"].to_pylist()) and ns.tolist() == sent["n"].to_pylist()


def test_buckets_dont_get_documents():
    """A block of many documents sends as many bytes as its strings need, however many buckets there are."""
    texts = [b"%030d" % i + b"common tail of sixty-four bytes, the same in every document....." for i in range(2000)]
    lens = np.array([len(x) for x in texts])
    row = {"block": 0, "docs": np.arange(2000).astype("<i8").tobytes(), "lens": lens.astype("<i8").tobytes(), "data": b"".join(texts), "region_doc": np.arange(2000).astype("<i4").tobytes()}
    region = S.Block(np.arange(2000), lens, row["data"])
    row["ranks"] = S.CoverRanks.of(region, 50, S.V, S.COVER).ranks.tobytes()
    few, many = ([b for b in S._send_strings(n, 0, 4096, 50, S.V, S.COVER)([pa.RecordBatch.from_pylist([row])])] for n in (4, 400))
    size = lambda batches: sum(b.nbytes for b in batches)
    assert sum(b.num_rows for b in many) > 300 and size(many) < size(few) + 400 * 100
    assert len(many) == 1  # one batch a block, not one a bucket
    ids = np.concatenate([S._number(S._records(pa.Table.from_batches([b]))[0][:, 12:]) for b in many])
    assert ids.max() == 1999 and ids.min() == 0


@pytest.mark.parametrize("ids", [[-(1 << 63), -3, 0, 5, (1 << 63) - 1], [7, 8, 9, 10, 11], [1 << 40, 0, 300, 70_000, 1 << 62]])
def test_any_ids(spark, ids):
    """Documents are told by their distance in the block, whatever their ids; blocks differ in width."""
    passage = "a passage of more than fifty bytes that all the texts have in them "
    data = [(d, f"{k} {passage}{k * 7} " + "".join(random.Random(k).choice("abcdef") for _ in range(90))) for k, d in enumerate(ids)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = brute([(d, t.encode()) for d, t in sorted(data)])
    for block_bytes in (1 << 20, 300, 1):
        got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in S.dedup(df, block_bytes=block_bytes, passes=2).collect())
        assert got == [(d, n, m, k) for (d, _), (n, m, k, _) in zip(sorted(data), want)]


def test_batches_of_blocks_are_small(spark):
    """Blocks reach Python a few at a time, and the session's own settings come back."""
    before = [spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize")]
    blocks = spark.range(0, 12, 1, 1).selectExpr("id", "cast(repeat('x', 1048576) as binary) as data")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows])})

    with narrow_batches(spark, 4 << 20, 16):
        assert max(r.n for r in blocks.mapInArrow(sizes, "n long").collect()) <= 6
    assert before == [spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize")]


def test_workers_drop_what_packing_keeps():
    """The words that packing keeps in a worker don't add to what the suffix array needs there."""
    packing._tokenizers["x"] = object()
    spare()
    assert not packing._tokenizers
