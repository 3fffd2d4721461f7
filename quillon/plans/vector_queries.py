"""Queries over vectors. The embeddings table plays chunks (label is the document), its first ten vectors the questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.catalog import Tables, query
from quillon.functions import vectors as V
from quillon.operators import segment as S
from quillon.operators import vector_search as N
from quillon.plans.runlog_queries import rounded

V_SQL = "v as (select vec_id, label, cast(embedding as double[]) as e from embeddings), q as (select vec_id as query_id, e as qe from v where vec_id < 10)"
COS = "list_dot_product(e, qe) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(qe, qe)) + 1e-9)"


def chunks(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("doc_id"))


def questions(t: Tables) -> DataFrame:
    return t.embeddings.where("vec_id < 10").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query(f"with {V_SQL}, s as (select query_id, vec_id as id, {COS} as score from v, q), r as (select *, cast(row_number() over (partition by query_id order by score desc, id) as int) as rank from s) select query_id, id, round(score, 6) as score, rank from r where rank <= 10")
def cosine_topk(t: Tables) -> DataFrame:
    return rounded(N.top_k(chunks(t), questions(t), 10))


@query(f"with {V_SQL}, s as (select query_id, vec_id as id, list_dot_product(e, qe) as score from v, q), r as (select *, cast(row_number() over (partition by query_id order by score desc, id) as int) as rank, min(score) over (partition by query_id) as lo, max(score) over (partition by query_id) as hi from s) select query_id, id, round((score - lo) / (hi - lo), 6) as score, rank from r")
def dense_passage_retrieval(t: Tables) -> DataFrame:
    """All passages by scaled inner product."""
    return rounded(N.min_max(N.top_k(chunks(t), questions(t), None, "dot")))


@query(f"with {V_SQL} select query_id, vec_id as id, round(list_sum(list_transform(list_zip(e, qe), lambda x: abs(x[1] - x[2]))), 6) as l1, round(sqrt(list_sum(list_transform(list_zip(e, qe), lambda x: (x[1] - x[2]) * (x[1] - x[2])))), 6) as l2, round(list_max(list_transform(list_zip(e, qe), lambda x: abs(x[1] - x[2]))), 6) as linf, round(1 - list_cosine_similarity(e, qe), 6) as cosine from v, q")
def vector_distances(t: Tables) -> DataFrame:
    q = t.embeddings.where("vec_id < 10").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    both = t.embeddings.join(F.broadcast(q))  # ten questions against all
    return rounded(both.select("query_id", F.col("vec_id").alias("id"), *[V.distance(kind, F.col("embedding"), F.col("q")).alias(kind.lower()) for kind in ("L1", "L2", "Linf", "cosine")]))


@query("with v as (select vec_id, cast(embedding as double[]) as e from embeddings), s as (select a.vec_id as query_id, b.vec_id as id, list_dot_product(a.e, b.e) as score from v a join v b on a.vec_id <> b.vec_id), r as (select *, cast(row_number() over (partition by query_id order by score desc, id) as int) as r from s where score >= 0.1) select query_id, id, round(score, 6) as score from r where r <= 100")
def synonym_graph(t: Tables) -> DataFrame:
    names = chunks(t).withColumn("name", F.concat(F.lit("entity "), "id"))
    return rounded(N.synonym_pairs(names, 0.1, 100))


@query("with u as (select label, unnest(range(64)) as i, unnest(cast(embedding as double[])) as x from embeddings), m as (select label, i, avg(x) as x from u group by 1, 2) select label, list(round(x, 6) order by i) as mean from m group by label")
def mean_pool(t: Tables) -> DataFrame:
    return N.mean_pool(t.embeddings, "label", "embedding", 64).select("label", F.transform("mean", lambda x: F.round(x, 6)).alias("mean"))


@query("""with v as (select vec_id, label, cast(embedding as double[]) as e from embeddings), g as (select *, 1 - list_cosine_similarity(lag(e) over (partition by label order by vec_id), e) as gap from v),
l as (select *, quantile_cont(gap, 0.95) over (partition by label) as most from g) select vec_id, label, round(gap, 6) as gap, cast(sum(case when gap > most then 1 else 0 end) over (partition by label order by vec_id) as bigint) as segment from l""")
def semantic_breaks(t: Tables) -> DataFrame:
    return rounded(S.semantic_breaks(t.embeddings, "label", "vec_id", "embedding").select("vec_id", "label", "gap", "segment"))


@query("select vec_id, round(sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))), 6) as length, len(embedding) = 64 as sound, round(list_sum(list_transform(cast(embedding as double[]), lambda x: x / sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))))), 6) as total from embeddings")
def vector_checks(t: Tables) -> DataFrame:
    e = F.col("embedding")
    return rounded(t.embeddings.select("vec_id", V.norm(e).alias("length"), V.is_sound(e, 64).alias("sound"), F.aggregate(V.normalized(V.checked(e, 64)), F.lit(0.0), lambda a, x: a + x).alias("total")))


@query(f"with {V_SQL}, s as (select query_id, label as doc_id, {COS} as score from v, q where vec_id % 3 = 0), d as (select query_id, cast(doc_id as bigint) as doc_id, max(score) as score from s group by 1, 2) select query_id, doc_id, round(score, 6) as score from d")
def centroid_documents(t: Tables) -> DataFrame:
    """Best centroid of each document: every third vector is a centroid of its label."""
    own = chunks(t).where("id % 3 = 0")
    met = N.top_k(own, questions(t), None).join(own.select("id", "doc_id"), "id")
    return rounded(met.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")))


@query(f"with {V_SQL}, s as (select query_id, vec_id as id, list_dot_product(e, qe) as score from v, q), r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s), t as (select *, sum(100 + id) over (partition by query_id order by rank) as total from r) select query_id, id, cast(rank as int) as rank from t where total <= 3500")
def token_budget_prefix(t: Tables) -> DataFrame:
    """The nearest chunks until their sizes pass the budget."""
    from quillon.operators import fusion

    found = N.top_k(chunks(t), questions(t), None, "dot").withColumn("size", 100 + F.col("id"))
    return fusion.token_prefix(found, "size", 3500).select("query_id", "id", "rank")


@query(f"with {V_SQL}, s as (select query_id, vec_id as id, list_dot_product(e, qe) as score from v, q), r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s), t as (select *, sum(100 + id) over (partition by query_id order by rank) - 100 - id as before from r) select query_id, id, cast(rank as int) as rank from t where before <= 3500")
def token_budget_range(t: Tables) -> DataFrame:
    """The nearest chunks up to and with the one whose size passes the budget."""
    from quillon.operators import fusion

    found = N.top_k(chunks(t), questions(t), None, "dot").withColumn("size", 100 + F.col("id"))
    return fusion.token_prefix(found, "size", 3500, inclusive=True).select("query_id", "id", "rank")


@query("with u as (select label, vec_id % 3 as mask, unnest(range(64)) as i, unnest(cast(embedding as double[])) as x from embeddings), m as (select label, i, sum(x * mask) / greatest(sum(mask), 1e-9) as x from u group by 1, 2) select label, list(round(x, 6) order by i) as mean from m group by label")
def masked_mean_pool(t: Tables) -> DataFrame:
    """Means weighted by a mask of 0, 1 and 2."""
    own = t.embeddings.withColumn("mask", F.col("vec_id") % 3)
    return N.masked_mean(own, "label", "embedding", "mask", 64).select("label", F.transform("mean", lambda x: F.round(x, 6)).alias("mean"))
