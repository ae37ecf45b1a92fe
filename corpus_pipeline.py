"""A corpus made ready for training: toxic and poor documents go, then near copies, then repeated
passages; what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import compression, jaccard, packing, suffixes
from seqloom.llm.common import Stored, table, unique_ids


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic, by the classifier learnt from the labels of `sf_dir`.

    A null or empty text is judged as one empty window; rows that repeat a doc_id, or lack one, are
    judged each; an empty table gives no rows; all columns stay as they are.
    """
    return compression.without_toxic(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality; odd rows as in `toxicity`."""
    return compression.only_good(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest doc_id.

    Rows that repeat a doc_id, or lack one (these come first), are told apart, so one row of a group
    stays then too; null and empty texts are no one's copies and stay; an empty table gives no rows;
    all columns stay as they are.
    """
    rows, _ = unique_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct("*").alias("__row")), ["__row"])
    groups = jaccard.similar_groups(rows.select("doc_id", F.col("__row.text").alias("text")))
    kept = groups.filter(F.col("doc_id") == F.col("component_id")).select("doc_id")
    return rows.join(kept, "doc_id", "left_semi").select("__row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has.

    Null and short texts stay; a null text comes out empty; rows that repeat a doc_id, or lack one,
    count as documents of their own, nulls first; an empty table gives no rows; other columns stay,
    and n_chars is counted anew.
    """
    return suffixes.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, each with its place in a sequence.

    A null or empty text is one piece of the closing id; rows that repeat a doc_id, or lack one, have
    places of their own; an empty table gives no rows; extra columns are dropped.
    """
    return packing.pack_documents(docs)


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("pack", pack)]

#: SQL can't express the classifiers, the suffix array's byte cuts or the packing; tests/llm hold the
#: stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read by the next stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = Stored(stage(spark, docs, sf_dir), f"pipeline-{name}").read()
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
