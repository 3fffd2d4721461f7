"""Queries that go through files: each writes a table in the engine's formats and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.catalog import Tables, query
from quillon.operators import runlog as R
from quillon.plans.runlog_queries import LOG, log_of, rounded
from quillon.session import shared_folder
from quillon.sources import readers, writers


def _folder(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/quillon-files-{uuid.uuid4().hex}"


@query(f"with {LOG} select run_id, count(*) as n, round(coalesce(sum(case when entry_type = 'answer' then number end), 0), 4) as total from log group by run_id")
def run_log_csv(t: Tables) -> DataFrame:
    at = _folder(t)
    writers.append_log(log_of(t), at)
    log = readers.run_log(t.spark, at)
    return rounded(log.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(R.of("answer"), R.number())), F.lit(0.0)).alias("total")), 4)


@query("select vec_id, 'chunk-' || md5(cast(vec_id as varchar)) as hash_id, label from embeddings")
def embedding_store(t: Tables) -> DataFrame:
    at = _folder(t)
    t.embeddings.select(F.concat(F.lit("chunk-"), F.md5(F.col("vec_id").cast("string"))).alias("hash_id"), "vec_id", "label", "embedding").write.parquet(at)
    return t.spark.read.parquet(at).select("vec_id", "hash_id", "label")


@query("select doc_id, text from documents")
def article_dump(t: Tables) -> DataFrame:
    """Compressed JSON lines of paragraphs, read back as articles."""
    at = _folder(t)
    rows = t.documents.select(F.col("doc_id").cast("string").alias("id"), F.lit("t").alias("title"), F.array(F.array("text")).alias("text"))
    rows.write.option("compression", "bzip2").json(at)
    return readers.articles(t.spark, at).select(F.col("id").cast("long").alias("doc_id"), "text")


@query("select doc_id, source as title, lang as entity, 'x' as alias from documents")
def structured_documents(t: Tables) -> DataFrame:
    at = _folder(t)
    rows = t.documents.select(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title")).alias("document"), F.array(F.struct(F.col("lang").alias("name"), F.lit("Person").alias("type"), F.array(F.lit("x")).alias("aliases"))).alias("entities"))
    rows.write.json(at)
    back = t.spark.read.schema(readers.STRUCTURED).json(at)
    return back.select(F.col("document.id").cast("long").alias("doc_id"), "document.title", F.col("entities")[0]["name"].alias("entity"), F.col("entities")[0]["aliases"][0].alias("alias"))


@query("select l_suppkey as src, l_partkey as dst, count(*) as weight from lineitem group by 1, 2")
def graph_files(t: Tables) -> DataFrame:
    at = _folder(t)
    edges = t.lineitem.groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.count(F.lit(1)).alias("weight"))
    writers.graph(edges.select(F.col("src").alias("node")).distinct(), edges, at)
    return t.spark.read.parquet(f"{at}/edges")


@query("select item_id as query_id, sha256(text) as key, 2 as documents, 1 as correct from benchmark")
def ranking_files(t: Tables) -> DataFrame:
    at = _folder(t)
    q = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    docs = q.select("query_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("rank")).withColumn("score", 1.0 / F.col("rank"))
    proofs = q.select("query_id", F.lit(1).alias("rank"), F.lit("c").alias("chunk_id"))
    writers.append_json(writers.with_correct_chunks(writers.rankings(q, docs, docs, {"dense": 10.0}), proofs), at)
    back = t.spark.read.json(at)
    return back.select("query_id", "key", F.size("document_scores").alias("documents"), F.size("correct_chunk_ids").alias("correct"))


@query("select round(avg(length(source)), 4) as avg_ent_chars, cast(1 as double) as avg_ent_words from documents")
def openie_averages(t: Tables) -> DataFrame:
    return readers.openie_averages(t.documents.select(F.array("source").alias("extracted_entities")))


@query("select doc_id, case when doc_id % 2 = 0 then 0 else 1 end as part from documents")
def scaling_dataset(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id")
    return readers.with_distractors(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"))


@query("select doc_id from documents where doc_id % 5 <> 0")
def resumed_run(t: Tables) -> DataFrame:
    return readers.missing(t.documents.select("doc_id"), t.documents.where("doc_id % 5 = 0").select("doc_id"), "doc_id")
