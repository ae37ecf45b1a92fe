"""Helpers shared by the training-data operators: durable intermediates, Arrow columns, checked sizes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import tempfile
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch handed to Python; texts can be long, so batches stay small.
ARROW_ROWS = 500


def tune(spark: SparkSession) -> None:
    """Keep the Arrow batches that reach Python small enough for long texts."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


@contextlib.contextmanager
def narrow_batches(spark: SparkSession, size: int, rows: int):
    """Plans that run inside hand Python batches of about `size` bytes and decode Parquet `rows` rows at a time."""
    wanted = {"spark.sql.execution.arrow.maxBytesPerBatch": str(size), "spark.sql.parquet.columnarReaderBatchSize": str(rows)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: By module, what a worker's later tasks may use again.
WORKER_CACHES = {"seqloom.llm.packing": "_tokenizers", "seqloom.llm.pieces": "_models"}


def spare() -> None:
    """In a worker: drop what earlier operators keep in it, and give unused memory back to the system."""
    for module, name in WORKER_CACHES.items():
        if module in sys.modules:
            getattr(sys.modules[module], name).clear()
    _trim()


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def _trim_jvm(spark: SparkSession) -> str:
    """Have the driver's JVM give memory that its native code has freed back to the system; what it answers."""
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    with contextlib.suppress(Py4JError):  # not every JVM has the command
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        # the server's own class isn't open to calls, its interface is
        kinds, args = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
        for k, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = jvm.java.lang.Class.forName(kind)
        for k, arg in enumerate((name, "systemTrimNativeHeap", array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0))):
            args[k] = arg
        invoke = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)
        return str(invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args))
    return ""


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor shares.  One is made only where the session names none and runs on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        there = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = there.get() if there.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="seqloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


class Stored:
    """A table written to the shared folder: its lineage is cut and it outlives lost executors."""

    def __init__(self, df: DataFrame, tag: str, codec: str = "zstd", large_rows: bool = False):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{tag}-{uuid.uuid4().hex}"
        self.schema = df.schema
        out = df.write.option("compression", codec)
        if large_rows:  # the writer looks at its size after 100 rows otherwise
            out = out.options(**{"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 8, "parquet.page.size.row.check.min": 1})
        out.parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; only for tables that no returned plan reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps whose results are stored, and give the driver's unused memory back."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _trim()
    _trim_jvm(spark)


def as_text(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unique_ids(docs: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose doc_id identifies them, and how to get back.

    Where doc_ids are unique and not null, `docs` itself and None.  Otherwise doc_id is replaced by
    the row's number in the order (doc_id, nulls first; then the other columns), and the second
    DataFrame gives the old doc_id of each number (doc_id, old_id).
    """
    docs = docs.select("doc_id", *columns)
    odd = docs.select("doc_id").groupBy("doc_id").count().filter("doc_id is null or count > 1").limit(1).count()
    if not odd:
        return docs, None
    # rows that are equal in all of this are told apart by where they were read, so they can be dealt to several tasks
    order = ["doc_id", *[F.xxhash64(c) for c in columns], "at"]
    read = docs.withColumn("at", F.monotonically_increasing_id())
    rows = Stored(read.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = rows.read().groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()  # one row a partition
    ahead, before = {}, 0
    for r in sorted(sizes):
        ahead[r.part], before = before, before + r.n
    starts = docs.sparkSession.createDataFrame(list(ahead.items()), "part long, ahead long")
    numbered = rows.read().withColumn("part", part).join(F.broadcast(starts), "part").withColumn("number", F.col("ahead") + place)
    return numbered.select(F.col("number").alias("doc_id"), *columns), numbered.select(F.col("number").alias("doc_id"), F.col("doc_id").alias("old_id"))
