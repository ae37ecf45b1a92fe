import random

import pytest

from seqloom.llm.common import table

SF = "/root/testdata/sf0.001"
WORDS = "the of and to in a is that for it was on are as with his they at be this from have or by one had not but what all were when".split()


@pytest.fixture(scope="session")
def documents(spark):
    return table(spark, SF, "documents").cache()


@pytest.fixture(scope="session")
def rows(documents):
    return [(r.doc_id, r.text) for r in documents.collect()]


def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, clashing extra columns."""
    r = random.Random(4)
    long = " ".join(r.choice(WORDS) + str(r.randrange(300)) for _ in range(30_000))
    base = " ".join(r.choice(WORDS) + str(i) for i in range(80))
    data = [(None, base), (1, None), (2, ""), (3, "  \n\t "), (4, "one two"), (5, long), (6, base), (6, base), (6, base + " more"), (7, long[:2000]), (8, "\U0001f600 é ß 中 ﬁ"), (None, None), (9, "a" * 400), (10, "a" * 400)]
    extra = "component_id long, score double, n long, part int, `__carry` string, text_crc32 long, block int"
    return spark.createDataFrame([(d, t, "en", None, None, 1, 0.5, 2, 3, "x", 4, 5) for d, t in data], f"doc_id long, text string, lang string, source string, n_chars long, {extra}"), data


@pytest.fixture(scope="session")
def odd(spark):
    return odd_documents(spark)


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.limit(0)
