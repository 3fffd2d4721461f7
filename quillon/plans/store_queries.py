"""Inserts, merges and deletes as pure plans over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.catalog import Tables, query
from quillon.operators import knowledge as K
from quillon.plans import store as M
from quillon.plans.graph_queries import TRIPLES, triples


@query("select c_custkey, c_name, case when c_mktsegment = 'BUILDING' then coalesce(case when c_custkey % 2 = 0 then 1.5 end, c_acctbal) else c_acctbal end as c_acctbal from customer")
def document_upsert(t: Tables) -> DataFrame:
    have = t.customer.select("c_custkey", "c_name", "c_acctbal")
    new = t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 2 == 0, 1.5).alias("c_acctbal"))
    return M.upsert(have, new, "c_custkey", ["c_acctbal"])


@query("select md5(text) as hash_id, text from documents group by text")
def idempotent_insert(t: Tables) -> DataFrame:
    keyed = t.documents.select(F.md5("text").alias("hash_id"), "text")
    have = M.insert_missing(keyed.limit(0), keyed.where("length(text) % 2 = 0"), "hash_id")
    return M.insert_missing(M.insert_missing(have, keyed, "hash_id"), keyed, "hash_id")


@query("select p_partkey, case when p_size < 10 then -1.0 else p_retailprice end as price, p_brand from part")
def centroid_replace(t: Tables) -> DataFrame:
    have = t.part.select("p_partkey", F.col("p_retailprice").alias("price"), "p_brand")
    return M.replace_group(have, t.part.where("p_size < 10").select("p_partkey", F.lit(-1.0).alias("price"), "p_brand"), "p_partkey")


@query(f"with {TRIPLES} select sha256(lower(trim(s)) || '|' || lower(trim(r)) || '|' || lower(trim(o))) as id, sum(rank)::bigint as rank, string_agg(distinct chunk, ',' order by chunk) as chunks from tr group by 1")
def assertion_accumulate(t: Tables) -> DataFrame:
    """Two batches merged one after the other."""
    own = triples(t)
    merged = M.merge_assertions(K.assertions(own.where("pos % 2 = 0")).drop("subject", "object"), K.assertions(own.where("pos % 2 = 1")).drop("subject", "object"))
    return merged.select("id", "rank", F.array_join("chunks", ",").alias("chunks"))


@query("with e as (select user_id % 100 as name, event_type as alias, event_id from events) select name, string_agg(distinct alias, ',' order by alias) as aliases from e group by name")
def entity_accumulate(t: Tables) -> DataFrame:
    own = t.events.select((F.col("user_id") % 100).alias("name"), "event_type", "event_id")
    half = [own.where(f"event_id % 2 = {i}").groupBy("name").agg(F.first(F.lit("x")).alias("type"), F.collect_set("event_type").alias("aliases")) for i in (0, 1)]
    return M.merge_entities(*half).select("name", F.array_join(F.array_sort("aliases"), ",").alias("aliases"))


def _tables(t: Tables) -> dict[str, DataFrame]:
    own = triples(t)
    chunks = own.select(F.col("chunk").alias("chunk_id")).distinct().withColumn("doc_id", F.substring("chunk_id", 2, 9).cast("int") % 10)
    made = K.assertions(own)
    return {"documents": chunks.select("doc_id").distinct(), "chunks": chunks, "assertions": made.select("id", "rank"), "derived": made.select("id", F.explode("chunks").alias("chunk_id"))}


STATE = f"""with {TRIPLES}, d as (select distinct sha256(lower(trim(s)) || '|' || lower(trim(r)) || '|' || lower(trim(o))) as id, chunk, cast(substring(chunk, 2) as int) % 10 as doc_id from tr)"""


@query(f"{STATE}, gone as (select distinct id from d where doc_id in (1, 2)) select distinct id from d where id not in (select id from gone)")
def cascade_delete(t: Tables) -> DataFrame:
    ids = t.region.where("r_regionkey in (1, 2)").select(F.col("r_regionkey").alias("doc_id"))
    return M.delete_cascade(_tables(t), ids)["assertions"].select("id")


@query(f"{STATE} select distinct id from d where doc_id not in (1, 2)")
def shared_delete(t: Tables) -> DataFrame:
    ids = t.region.where("r_regionkey in (1, 2)").select(F.col("r_regionkey").alias("doc_id"))
    return M.delete_sharing(_tables(t), ids)["assertions"].select("id")


@query("select user_id, arg_max(value, event_id) as value, max(event_id) as event_id from events group by user_id")
def cache_latest(t: Tables) -> DataFrame:
    """A response cache where the latest write wins."""
    return M.latest(t.events.select("user_id", "value", "event_id"), "user_id", "event_id")


@query("with f as (select user_id, min(event_id) as event_id from events where user_id >= 20 group by user_id) select user_id, event_id from f order by event_id limit 40")
def first_new_keys(t: Tables) -> DataFrame:
    known = t.events.where("user_id < 20").select("user_id").distinct()
    return M.first_seen(t.events.select("user_id", "event_id"), "user_id", "event_id", known, 40)
