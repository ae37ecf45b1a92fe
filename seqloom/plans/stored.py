"""Durable intermediates in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import InvalidArgumentError


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.  One is made only where the session names none and runs on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        there = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = there.get() if there.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise InvalidArgumentError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="seqloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, tag: str, replaces: DataFrame | None = None) -> DataFrame:
    """df written as Parquet and read again: its lineage is cut and it outlives lost executors.

    What `replaces` names, a result of this function that nothing reads any more, is deleted.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if replaces is not None:
        discard(replaces)
    out = spark.read.schema(schema).parquet(path)
    out.__dict__["_seqloom_path"] = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of results of `stored` that no plan in use reads."""
    for df in frames:
        if path := df.__dict__.get("_seqloom_path"):
            _delete(df.sparkSession, path)


class Grown:
    """A table that rounds add rows to; however many, it is read by one scan."""

    def __init__(self, first: DataFrame, tag: str):
        self.spark, self.schema = first.sparkSession, first.schema
        self.path = f"{shared_dir(self.spark)}/{tag}-{uuid.uuid4().hex}"
        first.write.parquet(self.path)

    def add(self, rows: DataFrame) -> None:
        rows.select(*[rows[c].cast(t.dataType).alias(c) for c, t in zip(self.schema.names, self.schema)]).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def discard(self) -> None:
        _delete(self.spark, self.path)
