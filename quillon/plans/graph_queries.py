"""Graph queries. Suppliers and parts of lineitem play entities and chunks, joined by what was shipped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.catalog import Tables, query
from quillon.operators import graph as G
from quillon.operators import knowledge as K
from quillon.plans.runlog_queries import rounded

EDGES = "e0 as (select 's' || l_suppkey as src, 'p' || l_partkey as dst, cast(count(*) as double) as weight from lineitem group by 1, 2), e as (select src, dst, weight from e0 union all select dst, src, weight from e0), t as (select src, dst, weight / sum(weight) over (partition by src) as p from e)"
SEEDS = "s as (select n_nationkey as query_id, 's' || (n_nationkey + 1) as node, 1.0 + n_regionkey as weight from nation union all select n_nationkey, 'p' || (n_nationkey * 3 + 1), 0.5 from nation)"


def edges(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def shipments(t: Tables) -> DataFrame:
    """The same edges, one for each row; PageRank adds up parallel ones."""
    return t.lineitem.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))


def seeds(t: Tables) -> DataFrame:
    a = t.nation.select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("s"), F.col("n_nationkey") + 1).alias("node"), (1.0 + F.col("n_regionkey")).alias("weight"))
    return a.unionByName(t.nation.select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("p"), F.col("n_nationkey") * 3 + 1).alias("node"), F.lit(0.5).alias("weight")))


def _unrolled(rounds: int, damping: float, normalize: bool) -> str:
    n = "n as (select query_id, node, weight / sum(weight) over (partition by query_id) as weight from s)" if normalize else "n as (select query_id, node, weight from s)"
    first = "r0 as (select query_id, node, weight" + ("" if normalize else f" * {1 - damping}") + " as score from n)"
    steps = [f"r{i + 1} as (select query_id, node, sum(score) as score from (select query_id, node, weight * {1 - damping} as score from n union all select query_id, t.dst, r.score * t.p * {damping} from r{i} r join t on r.node = t.src"
             + (f" union all select n.query_id, n.node, n.weight * m.mass * {damping} from n join (select query_id, sum(score) as mass from r{i} where node not in (select src from t) group by query_id) m on m.query_id = n.query_id" if normalize else "") + ") group by 1, 2)" for i in range(rounds)]
    return f"with {EDGES}, {SEEDS}, {n}, {first}, {', '.join(steps)} select query_id, node, round(score, 6) as score from r{rounds}"


@query(_unrolled(4, 0.85, False))
def ppr_bipartite(t: Tables) -> DataFrame:
    return rounded(G.pagerank(shipments(t), seeds(t), 0.85, 4))


@query(_unrolled(4, 0.5, True))
def ppr_weighted_reset(t: Tables) -> DataFrame:
    return rounded(G.pagerank(shipments(t), seeds(t), 0.5, 4, normalize=True))


@query()
def ppr_converged(t: Tables) -> DataFrame:
    """To convergence; each question's scores sum to 1."""
    scores = G.pagerank(shipments(t), seeds(t), 0.5, 20, normalize=True, tolerance=1e-5)
    return rounded(scores.groupBy("query_id").agg(F.sum("score").alias("mass"), F.count(F.lit(1)).alias("nodes")))


@query(f"with {EDGES}, {SEEDS} select query_id, dst as chunk, round(sum(s.weight * e0.weight / e0.weight), 6) as score from s join e0 on s.node = e0.src group by 1, 2")
def chunk_score_sum(t: Tables) -> DataFrame:
    links = edges(t).select(F.col("src").alias("node"), F.col("dst").alias("chunk"))
    return rounded(G.chunk_scores(seeds(t).withColumnRenamed("weight", "score"), links))


TRIPLES = "tr as (select o_orderkey as pos, 'c' || (o_custkey % 50) as s, lower(o_orderpriority) as r, 'c' || (o_orderkey % 40) as o, 'd' || (o_custkey % 30) as chunk, 1 + o_orderkey % 3 as rank from orders)"


def triples(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("pos"), F.concat(F.lit("c"), F.col("o_custkey") % 50).alias("s"), F.lower("o_orderpriority").alias("r"), F.concat(F.lit("c"), F.col("o_orderkey") % 40).alias("o"), F.concat(F.lit("d"), F.col("o_custkey") % 30).alias("chunk"), (1 + F.col("o_orderkey") % 3).alias("rank"))


@query(f"with {TRIPLES} select s, r, o, arg_min(chunk, pos) as chunk, arg_min(rank, pos) + count(*) - 1 as rank, min(pos) as pos from tr group by s, r, o")
def dedup_triplets(t: Tables) -> DataFrame:
    return K.deduplicate(triples(t))


@query(f"with {TRIPLES} select sha256(lower(trim(s)) || '|' || lower(trim(r)) || '|' || lower(trim(o))) as id, sum(rank)::bigint as rank, string_agg(distinct chunk, ',' order by chunk) as chunks, arg_min(r, pos) as predicate from tr group by 1")
def assertion_merge(t: Tables) -> DataFrame:
    return K.assertions(triples(t)).select("id", "rank", F.array_join("chunks", ",").alias("chunks"), "predicate")


@query(f"with {TRIPLES} select src, dst, cast(count(*) as double) as weight from (select s as src, o as dst from tr where s <> o union all select o, s from tr where s <> o) group by 1, 2")
def cooccurrence_edges(t: Tables) -> DataFrame:
    return G.fact_edges(triples(t))


@query(f"with {TRIPLES} select entity, count(distinct chunk) as chunks from (select s as entity, chunk from tr union all select o, chunk from tr) group by entity")
def entity_chunk_counts(t: Tables) -> DataFrame:
    return K.mentions(triples(t)).groupBy("entity").agg(F.countDistinct("chunk").alias("chunks"))


@query(f"""with {TRIPLES}, f as (select s, o, n_nationkey as query_id, 1.0 / (1 + n_nationkey) as score from tr join nation on pos % 1000 = n_nationkey), m as (select s as entity, chunk from tr union select o, chunk from tr), z as (select entity, count(*) as n from m group by 1),
x as (select query_id, score, lower(s) as entity from f union all select query_id, score, lower(o) from f), w as (select query_id, entity, avg(score / n) as weight from x join z using (entity) group by 1, 2),
k as (select *, row_number() over (partition by query_id order by weight desc, entity) as r from w) select query_id, entity, round(case when r <= 5 then weight else 0 end, 6) as weight from k""")
def phrase_weights(t: Tables) -> DataFrame:
    own = triples(t)
    facts = own.join(F.broadcast(t.nation), F.col("pos") % 1000 == F.col("n_nationkey")).select(F.col("n_nationkey").alias("query_id"), "s", "o", (F.lit(1.0) / (1 + F.col("n_nationkey"))).alias("score"))
    return rounded(G.keep_top(G.phrase_weights(facts, K.mentions(own)), 5))


@query(f"""with {TRIPLES}, fe as (select src, dst, cast(count(*) as double) as weight from (select s as src, o as dst from tr where s <> o union all select o, s from tr where s <> o) group by 1, 2), pe as (select distinct chunk as src, entity as dst, 1.0 as weight from (select s as entity, chunk from tr union select o, chunk from tr)),
sy as (select 'c' || n_nationkey as src, 'c' || (n_nationkey + 1) as dst, 0.9 as weight from nation), al as (select * from fe union all select * from pe), u as (select * from al where (src, dst) not in (select src, dst from sy) union all select * from sy)
select src, dst, cast(weight as double) as weight from u where src <> dst and src <> 'c3' and dst <> 'c3'""")
def graph_assembly(t: Tables) -> DataFrame:
    own = triples(t)
    mentions = K.mentions(own)
    nodes = mentions.select(F.col("entity").alias("node")).unionByName(mentions.select(F.col("chunk").alias("node"))).distinct().where("node <> 'c3'")
    synonyms = t.nation.select(F.concat(F.lit("c"), "n_nationkey").alias("src"), F.concat(F.lit("c"), F.col("n_nationkey") + 1).alias("dst"), F.lit(0.9).alias("weight"))
    return G.assemble([G.fact_edges(own), G.passage_edges(mentions)], nodes, synonyms)


@query(f"with {TRIPLES}, m as (select distinct s as entity, chunk from tr union select o, chunk from tr) select kind, n from (select 'chunk' as kind, count(distinct chunk) as n from m union all select 'entity', count(distinct entity) from m union all select 'mention', count(*) from m)")
def graph_info(t: Tables) -> DataFrame:
    m = K.mentions(triples(t))
    nodes = m.select(F.lit("chunk").alias("kind"), F.col("chunk").alias("node")).distinct().unionByName(m.select(F.lit("entity").alias("kind"), F.col("entity").alias("node")).distinct())
    return G.info(nodes, m.withColumn("kind", F.lit("mention")))


@query(f"""with {TRIPLES}, m as (select distinct s as entity, chunk from tr union select o, chunk from tr), d as (select chunk, 'doc' || (cast(substring(chunk, 2) as int) % 7) as doc_id from (select distinct chunk from m))
select distinct chunk, doc_id, entity from m join d using (chunk) where lower(entity) in ('c1', 'c2', 'c3')""")
def entity_chunks(t: Tables) -> DataFrame:
    own = triples(t)
    docs = own.select("chunk").distinct().withColumn("doc_id", F.concat(F.lit("doc"), F.substring("chunk", 2, 9).cast("int") % 7))
    return K.entity_chunks(own, docs, ["C1", "c2", "C3"])


@query(f"""with {TRIPLES}, a as (select 'c' || n_nationkey as alias, 'C' || (n_nationkey % 5) as canonical from nation) select pos, coalesce(x.canonical, s) as s, r, coalesce(y.canonical, o) as o from tr left join a x on lower(trim(s)) = x.alias left join a y on lower(trim(o)) = y.alias""")
def alias_resolve(t: Tables) -> DataFrame:
    aliases = t.nation.select(F.concat(F.lit("c"), "n_nationkey").alias("alias"), F.concat(F.lit("C"), F.col("n_nationkey") % 5).alias("canonical"))
    return K.resolve(triples(t), aliases).select("pos", "s", "r", "o")


@query("""with e as (select 'n' || (user_id % 40) as name, case when event_type = 'error' then '' else event_type end as type, cast(user_id as varchar) as alias, event_id from events)
select name, arg_min(type, event_id) filter (where type <> '') as type, count(distinct alias) as aliases from e group by name""")
def entity_merge(t: Tables) -> DataFrame:
    own = t.events.select(F.concat(F.lit("n"), F.col("user_id") % 40).alias("name"), F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("type"), F.array(F.col("user_id").cast("string")).alias("aliases"), F.col("event_id").alias("pos"))
    return K.merge_entities(own).select("name", "type", F.size("aliases").cast("long").alias("aliases"))


@query()
def alias_builder(t: Tables) -> DataFrame:
    """Entities of each document with the aliases that its triples state."""
    own = triples(t).select(F.substring("chunk", 2, 9).cast("long").alias("doc_id"), "pos", "s", F.when(F.col("pos") % 50 == 0, "also known as").otherwise(F.col("r")).alias("r"), "o")
    names = own.select("doc_id", "pos", F.explode(F.array("s", "o")).alias("name")).groupBy("doc_id", "name").agg(F.min("pos").alias("pos")).withColumn("type", F.lit("Person"))
    return K.build_aliases(own, names).select("doc_id", "name", "type", F.array_join("aliases", ",").alias("aliases"))
