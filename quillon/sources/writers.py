"""Writers: logs, rankings, timings, documents and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.sources.readers import STAMP


def append_log(rows: DataFrame, path: str) -> None:
    """Log rows as CSV with a header, beside what is there."""
    text = rows.withColumn("timestamp", F.date_format("timestamp", STAMP)) if dict(rows.dtypes)["timestamp"].startswith("timestamp") else rows
    text.select("run_id", "timestamp", "entry_type", "identifier", "value").write.mode("append").option("header", True).csv(path)


def rankings(questions: DataFrame, documents: DataFrame, chunks: DataFrame, weights: dict[str, float]) -> DataFrame:
    """One nested row a question: weights, ranked document and chunk scores, and a stable file key."""
    rows = lambda df, name: df.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", *[c for c in df.columns if c not in ("query_id", "rank")]))).alias(name))
    own = questions.join(rows(documents, "document_scores"), "query_id", "left").join(rows(chunks, "chunk_scores"), "query_id", "left")
    return own.withColumns({"key": F.sha2("question", 256), "weights": F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])})


def with_correct_chunks(ranked: DataFrame, proofs: DataFrame) -> DataFrame:
    """Rankings with the ids of chunks that ground a proof (query_id, rank, chunk_id), each once, in order."""
    ids = proofs.groupBy("query_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"])).alias("correct_chunk_ids"))
    return ranked.join(ids, "query_id", "left").withColumn("correct_chunk_ids", F.coalesce("correct_chunk_ids", F.array().cast("array<string>")))


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def document_folders(docs: DataFrame, path: str) -> None:
    """Texts and metadata, a folder for each document."""
    docs.select("doc_id", "text").write.mode("overwrite").partitionBy("doc_id").text(f"{path}/text")
    docs.drop("text").withColumn("id", F.col("doc_id")).write.mode("overwrite").partitionBy("doc_id").json(f"{path}/metadata")


def graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def solutions(found: DataFrame, answers: DataFrame, most: int = 5) -> DataFrame:
    """One row a question: its first most chunks, their scores to four digits, and the answer."""
    rows = F.slice(F.array_sort(F.collect_list(F.struct("rank", "text", "score"))), 1, most)
    own = found.groupBy("query_id").agg(rows.alias("r")).select("query_id", F.transform("r", lambda x: x["text"]).alias("docs"), F.transform("r", lambda x: F.round(x["score"], 4)).alias("doc_scores"))
    return answers.select("query_id", "answer").join(own, "query_id", "left")
