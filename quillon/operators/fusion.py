"""Putting signals together: weighted scores, rankings, budgets and fallbacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(signals: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Full outer join of score tables (keys, score) as one column each; what is missing is 0.

    A union and one grouped sum instead of a chain of joins: one shuffle for any number of signals.
    """
    long = reduce(DataFrame.unionByName, [df.select(*keys, *[(F.col("score") if n == name else F.lit(0.0)).alias(n) for n in signals]) for name, df in signals.items()])
    return long.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in signals])


def weighted(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    return scores.withColumn("score", sum((F.col(n) * w for n, w in weights.items()), F.lit(0.0)))


def ranking(scores: DataFrame, id_: str, k: int | None = None, by: str = "query_id") -> DataFrame:
    r = scores.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), id_)))
    return r if k is None else r.where(F.col("rank") <= k)


def fill_chunks(ranked_docs: DataFrame, chunks: DataFrame, entity_chunks: DataFrame, limit: int) -> DataFrame:
    """(query_id, id, from_entity, place): chunks of entities, all of them, then those of ranked documents until limit chunks are there."""
    first = entity_chunks.select("query_id", "id").distinct()
    rest = ranked_docs.join(chunks.select("id", "doc_id"), "doc_id").select("query_id", "id", "rank").join(first, ["query_id", "id"], "left_anti")
    both = first.select("query_id", "id", F.lit(True).alias("from_entity"), F.lit(0).alias("rank")).unionByName(rest.select("query_id", "id", F.lit(False).alias("from_entity"), "rank"))
    placed = both.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("from_entity"), "rank", "id")))
    return placed.where(F.col("from_entity") | (F.col("place") <= limit)).select("query_id", "id", "from_entity", "place")


def fill_documents(ranked_docs: DataFrame, limit: int) -> DataFrame:
    """Documents (query_id, doc_id, rank, n) while their chunks fit in limit; the first always."""
    w = Window.partitionBy("query_id").orderBy("rank")
    return ranked_docs.withColumn("_before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where((F.col("rank") == 1) | (F.col("_before") < limit)).drop("_before")


def token_prefix(rows: DataFrame, size: str, budget: int, order: Column | str = "rank", by: str = "query_id", inclusive: bool = False) -> DataFrame:
    """Rows in order until their sizes pass budget; inclusive keeps the row that passes it. What follows that row is cut even if it would fit."""
    w = Window.partitionBy(by).orderBy(order)
    total = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_t", before if inclusive else total).where(F.col("_t") <= budget).drop("_t")


def rerank_head(ranked: DataFrame, new: str, head: int = 25, by: str = "query_id") -> DataFrame:
    """The first head rows by their new score, the others as they were."""
    tail = F.col("rank") > head
    w = Window.partitionBy(by).orderBy(tail, F.when(tail, 0.0).otherwise(-F.col(new)), "rank")
    return ranked.withColumn("new_rank", F.row_number().over(w))


def fallback(first: DataFrame, second: DataFrame, by: str = "query_id") -> DataFrame:
    """first, and second for queries that first has no row of."""
    return first.unionByName(second.join(first.select(by).distinct(), by, "left_anti"))


def prefix(rows: DataFrame, order: list[str], start: int, stop: int) -> DataFrame:
    """Rows start to stop - 1 in order. Only the first stop rows are ever sorted together."""
    top = rows.orderBy(*order).limit(stop)
    return top.withColumn("_n", F.row_number().over(Window.orderBy(*order))).where(F.col("_n") > start).drop("_n")


def sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """A repeatable random sample of n rows."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)
