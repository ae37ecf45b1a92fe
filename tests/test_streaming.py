"""A sequence that grows by micro-batches keeps its positions dense and in order."""

from pyspark.sql import functions as F

from seqloom import operators as op
from seqloom.functions import monoids as M
from seqloom.sources.generate import to_values
from seqloom.streaming import appender, read_sequence


def test_append(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    write = appender(out, "v")
    for k, values in enumerate(([3, 1, 2], [9, 7], [5])):
        spark.createDataFrame([(v,) for v in values], "v long").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("v long").parquet(source).writeStream.option("checkpointLocation", str(tmp_path / "state"))
        query = stream.foreachBatch(write).trigger(availableNow=True).start()
        query.awaitTermination()
    assert to_values(read_sequence(spark, out)) == [1, 2, 3, 7, 9, 5]
    # a batch that comes again changes nothing
    write(spark.createDataFrame([(7,), (9,)], "v long"), 1)
    seq = read_sequence(spark, out)
    assert to_values(seq) == [1, 2, 3, 7, 9, 5]
    assert to_values(op.inclusive_scan(seq, F.col("v"), M.add).select("_idx", "scan")) == [1, 3, 6, 13, 22, 27]
