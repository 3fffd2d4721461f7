"""Whole retrievals: document filters, chunk rankings, budgets and fallbacks. Labels of embeddings are documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.catalog import Tables, query
from quillon.operators import fusion
from quillon.operators import vector_search as N
from quillon.plans.runlog_queries import rounded
from quillon.plans.vector_queries import COS, V_SQL, chunks, questions

SIGNALS = f"""{V_SQL}, d0 as (select query_id, vec_id as id, label as doc_id, {COS} as score from v, q), dense as (select * from (select *, row_number() over (partition by query_id order by score desc, id) as r from d0) where r <= 20),
lex as (select query_id, vec_id as id, label as doc_id, ((vec_id * 7 + query_id * 13) % 100) / 10.0 as score from v, q where (vec_id + query_id) % 9 = 0)"""


def dense(t: Tables) -> DataFrame:
    return N.top_k(chunks(t), questions(t), 20).join(chunks(t).select("id", "doc_id"), "id").select("query_id", "id", "doc_id", "score")


def lexical(t: Tables) -> DataFrame:
    q = F.broadcast(questions(t).select(F.col("id").alias("query_id")))  # ten questions
    own = chunks(t).join(q, (F.col("id") + F.col("query_id")) % 9 == 0)
    return own.select("query_id", "id", "doc_id", (((F.col("id") * 7 + F.col("query_id") * 13) % 100) / 10.0).alias("score"))


DOCS = "docs as (select query_id, doc_id, sum(l) as lexical, sum(d) as dense, sum(l) * 0.0545 + sum(d) * 10 as score from (select query_id, doc_id, 0.0 as l, max(score) as d from dense group by 1, 2 union all select query_id, doc_id, sum(score), 0.0 from lex group by 1, 2) group by 1, 2), ranked as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from docs)"


def ranked_docs(t: Tables) -> DataFrame:
    by_doc = {"lexical": lexical(t).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score")), "dense": dense(t).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))}
    scores = fusion.weighted(fusion.merge(by_doc, ["query_id", "doc_id"]), {"lexical": 0.0545, "dense": 10.0}).withColumn("score", F.round("score", 9))
    return fusion.ranking(scores, "doc_id")


@query(f"with {SIGNALS}, {DOCS} select query_id, cast(doc_id as bigint) as doc_id, round(score, 6) as score, cast(rank as int) as rank from ranked")
def document_filter(t: Tables) -> DataFrame:
    return rounded(ranked_docs(t).select("query_id", "doc_id", "score", "rank"))


FILL = f"""{SIGNALS}, {DOCS}, en as (select distinct query_id, vec_id as id from v, q where vec_id % 50 = query_id), rest as (select query_id, vec_id as id, rank from ranked join v on v.label = ranked.doc_id where (query_id, vec_id) not in (select query_id, id from en)),
b as (select query_id, id, true as from_entity, 0 as rank from en union all select query_id, id, false, rank from rest), p as (select *, row_number() over (partition by query_id order by from_entity desc, rank, id) as place from b)"""


@query(f"with {FILL} select query_id, id, from_entity, cast(place as int) as place from p where from_entity or place <= 100")
def chunk_budget(t: Tables) -> DataFrame:
    """The advanced search's candidates: chunks of entities, then of the best documents."""
    return candidates(t)


def candidates(t: Tables) -> DataFrame:
    q = F.broadcast(questions(t).select(F.col("id").alias("query_id")))
    entity = chunks(t).join(q, F.col("id") % 50 == F.col("query_id")).select("query_id", "id")
    return fusion.fill_chunks(ranked_docs(t), chunks(t), entity, 100)


@query(f"""with {FILL}, c as (select query_id, id from p where from_entity or place <= 100), s as (select query_id, id, sum(d) * 10 + sum(l) * 0.2369 as score from (select c.query_id, c.id, coalesce(d0.score, 0) as d, 0.0 as l from c left join d0 on d0.query_id = c.query_id and d0.id = c.id union all select c.query_id, c.id, 0.0, lex.score from c join lex on lex.query_id = c.query_id and lex.id = c.id) group by 1, 2),
k as (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from s) select query_id, id, round(score, 6) as score, cast(rank as int) as rank from k where rank <= 25""")
def hybrid_topk(t: Tables) -> DataFrame:
    """Candidates ranked by weighted signals."""
    own = candidates(t).select("query_id", "id")
    close = N.top_k(chunks(t), questions(t), None).join(own, ["query_id", "id"], "left_semi")
    words = lexical(t).select("query_id", "id", "score").join(own, ["query_id", "id"], "left_semi")
    scores = fusion.weighted(fusion.merge({"dense": close, "lexical": words}, ["query_id", "id"]), {"dense": 10.0, "lexical": 0.2369}).withColumn("score", F.round("score", 9))
    return rounded(fusion.ranking(scores, "id", 25).select("query_id", "id", "score", "rank"))


@query(f"with {SIGNALS}, n as (select label, count(*) as n from v group by 1), {DOCS}, w as (select query_id, doc_id, rank, coalesce(sum(n) over (partition by query_id order by rank rows between unbounded preceding and 1 preceding), 0) as before from ranked join n on n.label = doc_id) select query_id, cast(doc_id as bigint) as doc_id, cast(rank as int) as rank from w where rank = 1 or before < 120")
def document_budget(t: Tables) -> DataFrame:
    sizes = chunks(t).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return fusion.fill_documents(ranked_docs(t).join(sizes, "doc_id"), 120).select("query_id", "doc_id", "rank")


@query(f"with {SIGNALS}, x as (select query_id, id, r as rank, cast((id * 31) % 97 as double) as new from dense) select query_id, id, cast(row_number() over (partition by query_id order by rank > 10, case when rank <= 10 then -new else 0 end, rank) as int) as new_rank from x")
def rerank_head(t: Tables) -> DataFrame:
    own = N.top_k(chunks(t), questions(t), 20).withColumn("new", ((F.col("id") * 31) % 97).cast("double"))
    return fusion.rerank_head(own, "new", 10).select("query_id", "id", "new_rank")


@query(f"with {SIGNALS} select query_id, id, round(score, 6) as score from lex where query_id % 2 = 0 union all select query_id, id, round(score, 6) from dense where query_id % 2 = 1")
def dense_fallback(t: Tables) -> DataFrame:
    """Questions without facts fall back to dense retrieval."""
    return rounded(fusion.fallback(lexical(t).where("query_id % 2 = 0"), dense(t)).select("query_id", "id", "score"))
