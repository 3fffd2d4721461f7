"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, benchmark decontamination, best-fit packing.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept. All but the last return the columns of
documents: doc_id, text, lang, source, n_chars. Cases of nulls, empty texts, ties and repeated rows are those of the
operators; each stage keeps repeated rows of one doc_id and text together. An empty table gives an empty one.

The module cannot be imported without quillon.llm; only __spark_entry__.py guards against that.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontam, langid, line_dedup, packing, simhash
from quillon.llm.common import cut, without

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language model rejects them: no letter, or no language that is known here."""
    return langid.identify(docs).where(~F.col("rejected")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; n_chars follows the text. Documents stay, even those of which nothing is left."""
    kept = line_dedup.dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group one document stays, the one with the smallest doc_id."""
    found = simhash.near_duplicates(docs)
    return without(docs, found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))), "doc_id").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold a benchmark item."""
    return without(docs, decontam.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "doc_id").select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, with their sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates), ("benchmark_decontamination", decontamination), ("best_fit_packing", best_fit_packing)]

#: Language models, fingerprints and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
