"""A sequence fed by a stream: each micro-batch is numbered after those before it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.order import IDX, columns, with_index


def read_sequence(spark: SparkSession, path: str) -> DataFrame:
    """The rows appended so far."""
    return spark.read.parquet(path).drop("batch")


def appender(path: str, *order: Column | str) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch: writes a batch, in the given order, under its own number.

    A batch that is delivered again replaces what it wrote before and gets the same positions, since
    it is numbered after the rows of earlier batches only; so results are exactly-once.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = with_index(batch, *order)
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        start = 0
        if files.exists(root):
            before = spark.read.parquet(path).filter(F.col("batch") < number).agg((F.max(IDX) + 1).alias("n")).first()
            start = before.n or 0
        rows.select((F.col(IDX) + start).alias(IDX), *columns(rows)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
