"""Streams into the store's tables: new documents once each, and log metrics as rows arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.functions import text as T
from quillon.operators import segment


def ingest_once(docs: DataFrame, path: str, checkpoint: str, chunk_words: int = 1200) -> StreamingQuery:
    """Append the chunks of a stream of documents (doc_id, text), each content once, to path/chunks.

    Each batch's rows are compared with what is stored by content hash. A batch writes a folder of its own, so one that
    is run again after a failure replaces its first attempt.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keyed = batch.withColumn("hash_id", T.content_id("doc-", F.col("text"))).dropDuplicates(["hash_id"])
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/seen")
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            before = spark.read.parquet(f"{path}/seen").where(F.col("batch") != number)
            keyed = keyed.join(before.select("hash_id"), "hash_id", "left_anti")
        keyed = keyed.persist()
        segment.word_chunks(keyed, chunk_words).write.mode("overwrite").parquet(f"{path}/chunks/batch={number}")
        keyed.select("hash_id").write.mode("overwrite").parquet(f"{path}/seen/batch={number}")
        keyed.unpersist()

    return docs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_metrics(log: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and means by entry type and window of a stream of log rows (timestamp, entry_type, value), late rows allowed for."""
    own = log.withWatermark("timestamp", late).withColumn("n", F.col("value").try_cast("double"))
    return own.groupBy(F.window("timestamp", window).alias("w"), "entry_type").agg(F.count(F.lit(1)).alias("rows"), F.avg("n").alias("mean")).select(F.col("w.start").alias("start"), "entry_type", "rows", "mean")
