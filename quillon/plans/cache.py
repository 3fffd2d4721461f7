"""A cache of embeddings in a folder: vectors under a hash of all that made them; only what is missing is encoded."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def packed(vectors: Column) -> Column:
    """Vectors as the bytes of little-endian 32-bit floats."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return run(vectors)


def unpacked(raw: Column) -> Column:
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))

    return run(raw)


def key_of(text: Column, instruction: str = "", max_length: int | None = None) -> Column:
    """The hash of a text with what else its vector depends on; parts cannot run into each other."""
    return F.sha2(F.to_json(F.struct(F.lit(instruction).alias("instruction"), F.lit("" if max_length is None else str(max_length)).alias("max_length"), text.alias("prompt"))), 256)


class EmbeddingCache:
    """Rows (hash, embedding, batch) partitioned by the hash's first digits. Batches are only added; of equal hashes the last counts."""

    SCHEMA = "hash string, embedding binary, batch long, part string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path) if self._exists() else self.spark.createDataFrame([], self.SCHEMA)

    def vectors(self) -> DataFrame:
        """(hash, vector), one row a hash."""
        last = self.rows.groupBy("hash").agg(F.max_by("embedding", "batch").alias("embedding"))
        return last.select("hash", unpacked(F.col("embedding")).alias("vector"))

    def contains(self, texts: DataFrame, **made: object) -> DataFrame:
        """texts with a column cached."""
        have = self.rows.select("hash").distinct().withColumn("cached", F.lit(True))
        keyed = texts.withColumn("hash", key_of(F.col("text"), **made))
        return keyed.join(have, "hash", "left").select(*texts.columns, F.coalesce("cached", F.lit(False)).alias("cached"))

    def put(self, vectors: DataFrame) -> None:
        """Add (hash, vector) rows as a batch of their own."""
        batch = (self.rows.agg(F.max("batch")).first()[0] or 0) + 1
        rows = vectors.select("hash", packed(F.col("vector")).alias("embedding"), F.lit(batch).cast("long").alias("batch"), F.substring("hash", 1, 2).alias("part"))
        rows.repartition("part").write.mode("append").partitionBy("part").parquet(self.path)

    def encode(self, texts: DataFrame, encode: Callable[[Column], Column], instruction: str = "", max_length: int | None = None) -> DataFrame:
        """texts (id, text) with their vector. Texts that are not cached are encoded, each different one once, and cached first; null texts have no vector."""
        keyed = texts.withColumn("hash", key_of(F.col("text"), instruction, max_length))
        fresh = keyed.where(F.col("text").isNotNull()).join(self.rows.select("hash"), "hash", "left_anti").groupBy("hash").agg(F.any_value("text").alias("text"))
        if not fresh.isEmpty():
            # dealt anew by text, so the encoder's work is spread and its result written before it is read again
            self.put(fresh.repartition("hash").select("hash", encode(F.col("text")).cast("array<float>").alias("vector")))
        return keyed.join(self.vectors(), "hash", "left").select(*texts.columns, F.when(F.col("text").isNotNull(), F.col("vector")).alias("vector"))

    def clear(self) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
