"""Retrieval in rounds: each round's thought asks the next, until a thought ends its question."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import forget, written

#: A thought with this ends its question.
DONE = r"(?i)so the answer is:"


def iterate(
    questions: DataFrame, passages: DataFrame, retrieve: Callable[[DataFrame], DataFrame], reason: Callable[[Column, Column, Column], Column], rounds: int = 3, k: int = 5, done: str = DONE
) -> tuple[DataFrame, DataFrame]:
    """What is found, (query_id, id, score, rank), and the course, (query_id, question, thoughts, rounds, open), for questions (query_id, question).

    In the first round retrieve gets each question, (query_id, text), and in later ones its last thought; a passage keeps
    its best score over all rounds. reason makes the next thought from the question, the texts of its k best passages
    (id, text) so far and its thoughts. Questions whose thought matches done, or is empty, are closed and asked no more.
    All open questions of a round are one plan; each round's state is written to the shared folder. Only the number of
    open questions reaches the driver. A question that finds nothing reasons over no passage.
    """
    texts = F.array().cast("array<string>")
    state = written(questions.select("query_id", "question", texts.alias("thoughts"), F.lit(0).alias("rounds"), F.lit(True).alias("open")), "state")
    found = None
    for _ in range(rounds):
        front = state.where("open")
        last = F.try_element_at("thoughts", F.lit(-1))
        got = retrieve(front.select("query_id", F.coalesce(last, "question").alias("text"))).select("query_id", "id", "score")
        before, found = found, written((got if found is None else found.unionByName(got)).groupBy("query_id", "id").agg(F.max("score").alias("score")), "found")
        best = _ranked(found.join(front.select("query_id"), "query_id", "left_semi"), k).join(passages.select("id", "text"), "id")
        read = best.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda r: r["text"]).alias("read"))
        thought = front.join(read, "query_id", "left").select("query_id", "question", "thoughts", "rounds", F.coalesce(reason(F.col("question"), F.coalesce("read", texts), F.col("thoughts")), F.lit("")).alias("thought"))
        moved = thought.select("query_id", "question", F.concat("thoughts", F.array("thought")).alias("thoughts"), (F.col("rounds") + 1).alias("rounds"), (~(F.col("thought").rlike(done) | (F.col("thought") == ""))).alias("open"))
        then = written(state.where("not open").unionByName(moved), "state")
        forget(*[t for t in (state, before) if t is not None])
        state = then
        if state.where("open").isEmpty():
            break
    return _ranked(found, None), state


def _ranked(found: DataFrame, k: int | None) -> DataFrame:
    out = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")))
    return out if k is None else out.where(F.col("rank") <= k)
