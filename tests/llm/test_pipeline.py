"""The pipeline, stage by stage, against brute force on what each stage is given."""

import corpus_pipeline
from seqloom.llm import compression
from seqloom.llm.common import table

from .test_jaccard import brute as brute_classes
from .test_shards_and_packs import check_packs
from .test_suffixes import brute as brute_bytes

SF = "/root/testdata/sf0.001"


def test_stages(spark, documents):
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == documents.columns
        seen[name] = ({r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in docs.collect()})
    labels = table(spark, SF, "labels")
    for name, label, how, keep in (("toxicity", "toxic", compression.TOXICITY, lambda s: s < 0.7), ("quality", "quality", compression.QUALITY, lambda s: s >= 0.5)):
        before, after = seen[name]
        model = compression.learn(spark.createDataFrame(list(before.values()), documents.schema), labels, label, how)
        scores = model.scorer()([compression.fold(r.text, how[0].lower) for r in before.values()])
        assert set(after) == {d for d, s in zip(before, scores) if keep(s)}
    before, after = seen["near_copies"]
    classes = brute_classes([(d, r.text) for d, r in before.items()])
    assert set(after) == {d for d, (_, c) in classes.items() if c == d}
    before, after = seen["repeated_passages"]
    rows = sorted((d, r.text.encode()) for d, r in before.items())
    left = {d: kept.decode("utf-8", "ignore") for (d, _), (*_, kept) in zip(rows, brute_bytes(rows))}
    assert {d: r.text for d, r in after.items()} == left
    assert all(r.n_chars == len(r.text) and (r.lang, r.source) == (before[d].lang, before[d].source) for d, r in after.items())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    check_packs(packed, [(d, r.text) for d, r in after.items()])


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_one_row_of_each_group_stays(spark):
    a, b = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    docs = spark.createDataFrame([(1, a, 1), (1, a, 2), (2, b, 3), (1, b, 4), (None, a + " end", 5), (None, a, 6), (3, "", 7), (3, "", 8)], "doc_id long, text string, part int")
    left = corpus_pipeline.near_copies(spark, docs, SF).collect()
    assert sorted(r.part in (3, 4) for r in left if r.text) == [False, True]
    assert sorted(r.part for r in left if not r.text) == [7, 8]


def test_odd(spark, odd, nothing):
    for df in (odd[0], nothing):
        docs = df
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == df.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
