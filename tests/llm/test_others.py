"""Fingerprints, near vectors, licences, pieces, classifiers and the pipeline."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from seqloom.llm import compression, fingerprints, licenses, multi_index, pieces
from seqloom.llm.common import table

SF = "/root/testdata/sf0.001"

# ---------------------------------------------------------------- fingerprints


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def test_spans():
    r = random.Random(0)
    a = "".join(r.choice("ab中é") for _ in range(300))
    b = "".join(r.choice("ab中é") for _ in range(40)) + a[100:220] + "zz"
    x, y = fingerprints.PrefixHashes(a), fingerprints.PrefixHashes(b)
    for _ in range(400):
        i, j, n = r.randrange(len(a)), r.randrange(len(b)), r.randrange(1, 6)
        assert fingerprints.span_equal(x, i, y, j, n) == (i + n <= len(a) and j + n <= len(b) and a[i : i + n] == b[j : j + n])
        want = next((k for k, (c, d) in enumerate(zip(a[i:], b[j:])) if c != d), min(len(a) - i, len(b) - j))
        assert fingerprints.longest_common_extension(x, i, y, j) == want
    mixed = x.edited(120, "fresh中")
    assert all((p == q).all() for p, q in zip(mixed.sums, fingerprints.PrefixHashes(a[:120] + "fresh中").sums))


@pytest.mark.parametrize("parts", [1, 7])
def test_fingerprints(documents, rows, parts):
    got = {r.doc_id: r for r in fingerprints.fingerprint(documents, parts=parts).collect()}
    data = sorted(rows)
    assert len(got) == len(data)
    prints, near = {}, []
    for i, (d, t) in enumerate(data):
        then = data[(i + 1) % len(data)][1]
        edited = fingerprints.edit(t, then)
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), sha(edited))
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        a, b, c = (plain_fingerprint(x) for x in (t, edited, then))
        assert (r.fingerprint, r.edited_fingerprint) == (a, b)
        for like, other in ((r.near_edited, b), (r.near_next, c)):
            same = sum(a[k : k + 4] == other[k : k + 4] for k in range(16, len(a), 4)) / 128
            assert like == (1 if a[:16] == other[:16] else 2 * same / (1 + same))
        assert r.common_prefix == next((k for k, (x, y) in enumerate(zip(t, edited)) if x != y), min(len(t), len(edited)))
        near.append(r.near_edited > r.near_next or t == then)
    assert np.mean(near) > 0.97
    assert len(set(prints.values())) == len(prints)


def plain_fingerprint(text):
    """The fingerprint by its definition, in plain integers and without prefix arrays."""
    p, bases, word = 2**31 - 1, (1315423911 % (2**31 - 1), 880301671), 2**64

    def scramble(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % word
        x = (x ^ x >> 27) * 0x94D049BB133111EB % word
        return x ^ x >> 31

    def value(codes):
        out = []
        for base in bases:
            h = 0
            for c in reversed(codes):
                h = (h * base + c) % p
            out.append(h)
        return out[0] << 31 | out[1]

    codes = [ord(c) + 1 for c in text]
    width = min(8, len(codes))
    low = {}
    for h in {value(codes[i : i + width]) for i in range(len(codes) - width + 1)} if codes else ():
        x = scramble(h)
        low[x >> 57] = min(low.get(x >> 57, word), x)
    full = sorted(low)
    cells = [low[k] if k in low else scramble((low[full[(k * 40503 + 17) % len(full)]] + k) % word) if full else 0 for k in range(128)]
    return f"{value(codes):016x}" + "".join(f"{x % 65536:04x}" for x in cells)


def test_fingerprints_of_one_hot_id(spark):
    """Rows of one doc_id, or of none, are dealt to several tasks."""
    df = spark.range(4000).selectExpr("if(id < 3000, 7, if(id < 3500, null, id)) as doc_id", "if(id % 2 = 0, 'the same text', concat('text ', id % 50)) as text")
    found = fingerprints.fingerprint(df, parts=8)
    assert found.count() == 4000 and found.filter("doc_id is null").count() == 500 and found.filter("doc_id = 7").count() == 3000
    base, back = fingerprints.unique_ids(df, ["text"])
    assert back is not None and base.select("doc_id").distinct().count() == 4000 and base.agg({"doc_id": "max"}).first()[0] == 3999


def test_fingerprints_odd(odd, nothing):
    df, data = odd
    got = fingerprints.fingerprint(df).collect()
    assert sorted((r.doc_id or -1, r.n_chars) for r in got) == sorted((d or -1, len(t or "")) for d, t in data)
    assert fingerprints.fingerprint(nothing).count() == 0
    single = fingerprints.fingerprint(df.filter("doc_id = 4")).collect()
    assert len(single) == 1 and single[0].near_next == 1


# ---------------------------------------------------------------- near vectors


def brute_vectors(data, threshold=0.9):
    ids = [i for i, _ in data]
    x = np.array([v for _, v in data], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    close = x @ x.T >= threshold
    np.fill_diagonal(close, False)
    up = {i: i for i in ids}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in zip(*np.nonzero(close)):
        p, q = find(ids[a]), find(ids[b])
        up[max(p, q)] = min(p, q)
    return {i: (int(n), find(i)) for i, n in zip(ids, close.sum(1))}


def test_traverse():
    r = np.random.default_rng(0)
    d1, d2 = r.random((20, 9)), r.random((20, 7))
    for visits in (1, 5, 30, 63, 100):
        got = multi_index.traverse(d1, d2, visits)
        sums = (d1[:, :, None] + d2[:, None, :]).reshape(20, -1)
        assert (got == np.argsort(sums, 1, kind="stable")[:, :visits]).all()


@pytest.mark.parametrize("block,visit", [(4096, 16384), (150, 16384), (150, 100), (4096, 60)])
def test_near_vectors(spark, monkeypatch, block, visit):
    monkeypatch.setattr(multi_index, "BLOCK_ROWS", block)
    monkeypatch.setattr(multi_index, "VISIT_ROWS", visit)
    r = np.random.default_rng(5)
    base = r.standard_normal((300, 32))
    base /= np.linalg.norm(base, axis=1)[:, None]
    data = []
    for k in range(1500):
        b, e, c = base[r.integers(300) if k % 3 else 7], r.standard_normal(32), r.choice([0.9005, 0.93, 0.97, 1.0])
        e -= (e @ b) * b
        data.append((k, (c * b + np.sqrt(1 - c * c) * e / np.linalg.norm(e)).tolist()))
    data += [(2000 + k, data[0][1]) for k in range(5)]
    got = {x.vec_id: x for x in multi_index.near_groups(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    want = brute_vectors(data)
    assert len(got) == len(want) and all(got[i].n_links <= want[i][0] for i in want)
    assert sum(x.n_links for x in got.values()) >= 0.95 * sum(n for n, _ in want.values())
    assert all(x.kept == (x.vec_id == x.component_id) for x in got.values())


def test_near_vectors_table(spark):
    df = table(spark, SF, "embeddings")
    got = {x.vec_id: (x.n_links, x.component_id) for x in multi_index.near_groups(df).collect()}
    assert got == brute_vectors([(r.vec_id, r.embedding) for r in df.collect()])


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [1.0, 2.0, 3.0]
    data = [(0, good), (1, [2.0, 4.0, 6.0]), (2, None), (3, [0.0, 0.0, 0.0]), (4, [nan, 1.0, 1.0]), (5, [inf, 1.0, 1.0]), (6, [1.0, None, 1.0]), (7, []), (8, [1.0]), (9, good), (9, good), (None, good), (10, [-1.0, -2.0, -3.0])]
    got = multi_index.near_groups(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    assert len(got) == len(data)
    links = {}
    for r in got:
        links.setdefault(r.vec_id, set()).add(r.n_links)
    assert links[0] == links[1] == links[9] == links[None] == {4}
    assert all(links[i] == {0} for i in (2, 3, 4, 5, 6, 7, 8, 10))
    assert multi_index.near_groups(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_vectors_of_every_length_link(spark):
    data = [(0, [1.0, 2.0, 3.0]), (1, [2.0, 4.0, 6.0]), (2, [1.0, 2.0, 3.1]), (3, [1.0, 0.0]), (4, [1.0, 0.01]), (5, [0.0, 1.0]), (6, [4.0]), (7, [5.0]), (8, [-5.0])]
    got = multi_index.near_groups(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (1, 3), 4: (1, 3), 5: (0, 5), 6: (1, 6), 7: (1, 6), 8: (0, 8)}


# ---------------------------------------------------------------- licences


def test_licences(spark, documents, odd, nothing):
    r = random.Random(2)
    words = "the of and to in licensed under this work".split()
    notices = list(licenses.TEMPLATES.values())
    fill = lambda: [r.choice(words) for _ in range(r.randrange(60))]
    data = [(i, " ".join(fill() + (r.choice(notices).split() if i % 2 else []) + fill())) for i in range(200)] + [(200, None), (201, ""), (202, "a b"), (203, notices[1][:-30])]
    made = spark.createDataFrame(data, "doc_id long, text string")
    for df in (made, documents, odd[0], nothing):
        con = duckdb.connect()
        con.register("documents", pa.table(df.select("doc_id", "text").toArrow()))
        assert sorted(map(repr, map(tuple, licenses.scan(df).collect()))) == sorted(map(repr, con.sql(licenses.scan_sql()).fetchall()))
    assert licenses.scan(made).select("doc_id").distinct().count() >= 100


def test_licences_stay_native(documents):
    plan = licenses.scan(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---------------------------------------------------------------- pieces


def test_pieces(documents, rows, odd, nothing):
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(1)
    letters = "aA zZéßÀ'’s.,!<|>startofex09 \n\t\r\x0b\x1c\x85  　ΣσİıΑα中国è½²_~^`{}@×÷-don'tLL're​\U0001f600梦    ▁"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(1500)] + [t for _, t in rows[:60]] + ["", " lead", "trail  ", "<s> hi <unk>", "x" * 3000]
    model = pieces.piece_model()
    for t, ids in zip(texts, model.encode(texts)):
        want = lib.encode(t)
        assert ids.tolist() == want and model.decode(ids) == lib.decode(want)
    got = {x.doc_id: x for x in pieces.encode_documents(documents, with_ids=True).collect()}
    for d, t in rows:
        want = lib.encode(t)
        assert got[d].ids == want and got[d].n_ids == len(want)
        assert got[d].ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        assert got[d].round_trip and got[d].decoded_sha256 == sha(t)
    df, data = odd
    assert sorted(x.n_ids for x in pieces.encode_documents(df).collect()) == sorted(len(lib.encode(t or "")) for _, t in data)
    assert pieces.encode_documents(nothing).count() == 0


# ---------------------------------------------------------------- classifiers


def made_corpus(spark, n=900):
    r = random.Random(6)
    words = [f"{a}{b}" for a in "thonerinreedatortistvecal" for b in ("a", "en", "ing", "er", "or", "ly")]
    rude = ["blargwit", "snotgoblin", "dunderclod"]
    docs, labels = [], []
    for i in range(n):
        text = [r.choice(words) for _ in range(r.randrange(60, 200))]
        toxic, poor = i % 5 == 0, i % 4 == 1
        for _ in range(6 if toxic else 0):
            text[r.randrange(len(text))] = r.choice(rude)
        docs.append((i, " ".join(w + "!!###" if poor else w for w in text)))
        labels.append((i, int(not poor), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name,label,limit", [("quality", "quality", 0.5), ("toxicity", "toxic", 0.7)])
def test_classifiers(spark, name, label, limit):
    docs, labels = made_corpus(spark)
    got = getattr(compression, name)(docs, labels).collect()
    truth = {r.doc_id: r[label] for r in labels.collect()}
    assert len(got) == len(truth)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= limit)
    right = [r.predicted == truth[r.doc_id] for r in got if r.held_out]
    assert np.mean(right) > 0.95


def test_labels_due_to_late_passages_are_learnt(spark):
    r = random.Random(8)
    words = [f"{a}{b}" for a in "thonerinreedatortistvecal" for b in ("a", "en", "ing", "er", "or", "ly")]
    docs, labels = [], []
    for i in range(300):
        text = " ".join(r.choice(words) for _ in range(2800))
        assert len(text) > 9000
        docs.append((i, text + " blargwit snotgoblin dunderclod" * 4 if i % 3 == 0 else text))
        labels.append((i, 1, int(i % 3 == 0)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = compression.toxicity(docs, labels).filter("held_out").collect()
    assert all(x.predicted == (x.doc_id % 3 == 0) for x in got)


@pytest.mark.parametrize("name,label,least", [("quality", "quality", 0.99), ("toxicity", "toxic", 0.92)])
def test_held_out_ranking(spark, name, label, least):
    """Held-out rows of a table with few labels (some 300 toxic rows are learnt): area under the curve."""
    folder = SF.replace("0.001", "0.1")
    scored = getattr(compression, name)(table(spark, folder, "documents"), table(spark, folder, "labels")).filter("held_out")
    rows = scored.join(table(spark, folder, "labels").select("doc_id", label).dropna(), "doc_id").select("score", label).collect()
    s, y = np.array([r.score for r in rows]), np.array([r[label] for r in rows])
    above, equal = (s[y == 1][:, None] > s[y == 0]).mean(), (s[y == 1][:, None] == s[y == 0]).mean()
    assert above + equal / 2 >= least


def test_contrast_tells_chance_from_class():
    how = compression.TOXICITY[0]
    ids = np.arange(4, dtype=np.uint64)
    # 0: frequent in own only; 1: as frequent in both; 2: too few; 3: none in other, yet within chance
    own, other = (ids, np.array([40, 200, 3, 4])), (ids[:2], np.array([10, 1600]))
    assert compression.contrast(own, 300, other, 2400, how).tolist() == [0]
    assert compression.contrast(own, 300, (ids[:0], np.zeros(0, int)), 0, how).tolist() == []


@pytest.mark.parametrize("step", [1, 7, 1 << 18])
def test_stretches_do_not_depend_on_steps(step):
    data = ("the blargwit and snotgoblin of " * 5).encode()
    grams = np.unique(np.concatenate([compression._grams(x, 4) for x in (b"blargwit", b"snotgoblin")]))
    assert compression.stretches(data, {4: grams}, step=step) == {b"blargwit", b"snotgoblin"}
    assert (compression._distinct(data, 4, step) == np.unique(compression._grams(data, 4))).all()


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = made_corpus(spark, 300)
    flipped = labels.selectExpr("doc_id", "if(crc32(string(doc_id)) % 3 = 1, 1 - quality, quality) as quality", "toxic")
    a, b = ({r.doc_id: r.score for r in compression.quality(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_classifiers_odd(spark, odd, nothing):
    df, data = odd
    labels = spark.createDataFrame([(1, 1, None), (2, 0, 1), (None, 1, 0), (6, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    got = compression.quality(df, labels).collect()
    assert len(got) == len(data) and {r.score for r in got} == {0.5}
    docs, labels = made_corpus(spark, 300)
    assert compression.toxicity(nothing, labels).count() == 0
    model = compression.learn(docs, labels, "quality", compression.QUALITY)
    assert compression.classify(df, model, 0.5).count() == len(data)
    kept = compression.passing(df, model, lambda s: s < 2)
    assert kept.columns == df.columns and kept.count() == len(data)
    clash = compression.passing(df.withColumnRenamed("score", "__scored"), model, lambda s: s < 2)
    assert clash.columns[6] == "__scored" and {r[6] for r in clash.collect()} == {0.5}
