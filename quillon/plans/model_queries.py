"""Clusters, trees, tuning and model stand-ins. Most have no SQL; tests hold them against small cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.catalog import Tables, query
from quillon.functions import models as M
from quillon.functions import text as T
from quillon.operators import cluster as C
from quillon.operators import segment as S
from quillon.operators import lexical, tuning
from quillon.plans.lexical_queries import BEST, CHUNKS, INDEX, TOK, kept
from quillon.plans.lexical_queries import chunks as cut_chunks
from quillon.plans.lexical_queries import questions as asked
from quillon.plans.runlog_queries import rounded
from quillon.plans.vector_queries import chunks, questions
from quillon.session import written


@query()
def document_centroids(t: Tables) -> DataFrame:
    return C.document_centroids(chunks(t), 5).select("doc_id", "centroid_no", "n", F.round(F.col("centroid")[0], 6).alias("first"))


@query()
def mixture_clusters(t: Tables) -> DataFrame:
    return C.cluster_groups(chunks(t).withColumnRenamed("doc_id", "group"))


def tree(t: Tables) -> DataFrame:
    """A tree for each document over all its chunks; keys name nodes across documents."""
    leaves = S.word_chunks(t.documents, 200).select(F.col("doc_id").alias("group"), F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_no")).cast("long").alias("id"), "text", M.encode(F.col("text")).cast("array<double>").alias("vector"))
    return C.build_tree(leaves, M.summarize, M.hashed_vector)


def keyed(nodes: DataFrame) -> DataFrame:
    """Nodes whose id and children are keys over all documents."""
    return nodes.withColumns({"id": F.xxhash64("group", "id"), "children": F.transform("children", lambda c: F.xxhash64("group", c))})


@query()
def summary_tree(t: Tables) -> DataFrame:
    return tree(t).select("group", "id", "layer", F.size("children").alias("children"), F.length("text").alias("n_chars"))


@query()
def collapsed_tree(t: Tables) -> DataFrame:
    q = asked(t).select(F.col("query_id").alias("id"), M.encode(F.col("text")).alias("vector"))
    return rounded(C.collapsed(written(keyed(tree(t)), "tree"), q, 10, 600).select("query_id", "id", "layer", "rank"))


@query()
def tree_traversal(t: Tables) -> DataFrame:
    q = asked(t).select(F.col("query_id").alias("id"), M.encode(F.col("text")).alias("vector"))
    return C.traverse(written(keyed(tree(t)), "tree"), q, 5, 3)


@query()
def pairwise_ranker(t: Tables) -> DataFrame:
    rows = t.labels.join(t.documents, "doc_id").select((F.col("doc_id") % 20).alias("q"), "quality", F.col("n_chars").cast("double").alias("n_chars"), F.size(F.split("text", "\n")).cast("double").alias("lines"), F.col("toxic").cast("double").alias("toxic"))
    w = tuning.pairwise_weights(rows, "q", "quality", ["n_chars", "lines", "toxic"], rounds=15)
    return t.spark.createDataFrame([(k, round(v, 4)) for k, v in w.items()], "feature string, weight double")


@query()
def greedy_articles(t: Tables) -> DataFrame:
    """Questions in order that fit a budget of distinct articles: those whose articles are all taken by their turn.

    Only what is taken is found in sequence, streamed in order until the budget is spent.
    """
    lines = t.orders.select("o_orderkey").join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.col("l_suppkey").cast("string").alias("s"))
    groups = lines.groupBy("o_orderkey").agg(F.collect_set("s").alias("s")).orderBy("o_orderkey")
    taken = tuning.greedy_taken(((g.o_orderkey, g.s) for g in groups.toLocalIterator()), 60)
    by = t.spark.createDataFrame(list(taken.items()), "s string, since long")
    late = F.col("s").isNotNull() & (F.col("since").isNull() | (F.col("since") > F.col("o_orderkey")))
    return lines.join(F.broadcast(by), "s", "left").groupBy("o_orderkey").agg(F.count_if(late).alias("late")).where("late = 0").select(F.col("o_orderkey").alias("question"))


@query(r"""with e as (select doc_id, regexp_extract_all(text, '\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)*') as e from documents), u as (select doc_id, unnest(e) as w, unnest(range(len(e))) as i from e), d as (select doc_id, w, min(i) as i from u group by all),
n as (select doc_id as chunk, cast(row_number() over (partition by doc_id order by i) - 1 as int) as pos, w as s, 'occurs with' as r, lead(w) over (partition by doc_id order by i) as o, 1 as rank from d) select * from n where o is not null""")
def entity_triples(t: Tables) -> DataFrame:
    return M.cooccurrences(t.documents.select(F.col("doc_id").alias("id"), "text"))


@query(rf"""with {CHUNKS}, {INDEX}, {BEST}, qw as (select item_id, list_distinct({TOK}) as qw from benchmark), cw as (select id, list_distinct({TOK}) as cw from c)
select item_id, id, round(len(list_intersect(qw, cw)) / greatest(1, len(qw)), 6) as score from k join qw on item_id = query_id join cw using (id) where rank <= 10""")
def rerank_scores(t: Tables) -> DataFrame:
    """The ten best chunks of each item by BM25, scored anew."""
    own = cut_chunks(t)
    found = lexical.top_k(kept(own), asked(t), 10).select("query_id", "id").join(own.select("id", "text"), "id")
    both = found.join(t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("q")), "query_id")
    return both.select(F.col("query_id").alias("item_id"), "id", F.round(M.rerank_score(F.col("q"), F.col("text")), 6).alias("score"))


@query()
def closest_fact(t: Tables) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("ALGERIA", "FRANCE", "GERMANY", "PERU")])
    return t.nation.select("n_nationkey", "n_name", M.closest(F.col("n_name"), names).alias("closest"))


@query()
def response_parsing(t: Tables) -> DataFrame:
    """Sections, truncated JSON, escapes and typed triples of model outputs."""
    said = F.concat(F.lit("[[ ## fact_after_filter ## ]]\n{\"fact\": [[\""), "n_name", F.lit("\", \"is\", \"x"))
    tagged = F.concat(F.lit("tp_XX<triplet> "), "n_name", F.lit(" <loc> place <misc> part of"))
    return t.nation.select("n_nationkey", T.closed_json(T.filter_section(said)).alias("fact"), T.decoded(F.concat(F.lit("\\u00e9 "), "n_name")).alias("decoded"), F.to_json(T.typed_triples(tagged)).alias("triples"))
