"""Joins, lookups, set operations, windows and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.catalog import Tables, query
from quillon.functions import evaluation as E
from quillon.operators import fusion
from quillon.plans.runlog_queries import rounded


@query("select doc_id, md5(text) as hash_id from documents where md5(text) not in (select md5(text) from documents where doc_id % 3 = 0)")
def missing_hashes(t: Tables) -> DataFrame:
    """Content that a store does not hold yet."""
    keyed = t.documents.select("doc_id", F.md5("text").alias("hash_id"))
    return keyed.join(keyed.where("doc_id % 3 = 0").select("hash_id"), "hash_id", "left_anti").select("doc_id", "hash_id")


@query("select distinct source from documents where lang = 'fr' intersect select distinct source from documents where lang = 'de'")
def corpus_overlap(t: Tables) -> DataFrame:
    return t.documents.where("lang = 'fr'").select("source").intersect(t.documents.where("lang = 'de'").select("source"))


@query("select distinct source from documents where lang = 'en' except select distinct source from documents where lang = 'es'")
def corpus_difference(t: Tables) -> DataFrame:
    return t.documents.where("lang = 'en'").select("source").subtract(t.documents.where("lang = 'es'").select("source"))


@query("with a as (select distinct o_custkey as k from orders), b as (select c_custkey as k from customer) select (select count(*) from a where k in (select k from b)) as shared, case when (select count(*) from b where k not in (select k from a)) = 0 then 'subset' when (select count(*) from a where k in (select k from b)) = 0 then 'disjoint' else 'partial' end as verdict")
def overlap_verdict(t: Tables) -> DataFrame:
    a, b = t.orders.select(F.col("o_custkey").alias("k")).distinct(), t.customer.select(F.col("c_custkey").alias("k")).distinct()
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "k", "full").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"), F.count_if(F.col("a").isNull()).alias("missing"))
    return both.select("shared", F.when(F.col("missing") == 0, "subset").when(F.col("shared") == 0, "disjoint").otherwise("partial").alias("verdict"))


@query("select text from documents union all select text from benchmark")
def bag_union(t: Tables) -> DataFrame:
    return t.documents.select("text").unionByName(t.benchmark.select("text"))


@query("select o_orderkey, coalesce(c_name, regexp_replace('Customer#' || o_custkey, '[<>:\"/\\\\|?*#]', '_', 'g')) as name from orders left join (select * from customer where c_custkey % 2 = 0) c on o_custkey = c_custkey")
def title_lookup(t: Tables) -> DataFrame:
    """A name by key, else a made one."""
    known = t.customer.where("c_custkey % 2 = 0").select("c_custkey", "c_name")
    made = F.regexp_replace(F.concat(F.lit("Customer#"), "o_custkey"), r'[<>:"/\\|?*#]', "_")
    return t.orders.join(known, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.coalesce("c_name", made).alias("name"))


@query("select l_orderkey from lineitem group by l_orderkey having sum(case when l_suppkey <= 90 then 0 else 1 end) = 0")
def covered_questions(t: Tables) -> DataFrame:
    """Orders all of whose suppliers are selected: relational division."""
    chosen = t.supplier.where("s_suppkey <= 90").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(1).alias("in"))
    return t.lineitem.select("l_orderkey", "l_suppkey").join(chosen, "l_suppkey", "left").groupBy("l_orderkey").agg(F.count_if(F.col("in").isNull()).alias("out")).where("out = 0").select("l_orderkey")


@query(r"""with d as (select doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') as w from documents), b as (select item_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') as w from benchmark),
dg as (select distinct doc_id, array_to_string(w[i : i + 7], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d where len(w) >= 8)), bg as (select distinct item_id, array_to_string(w[i : i + 7], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 6)) as i from b where len(w) >= 8)),
m as (select item_id, min(doc_id) as rank from bg join dg using (g) group by 1) select b.item_id as proof_id, coalesce(rank, -1) as rank from benchmark b left join m using (item_id)""")
def proof_grounding(t: Tables) -> DataFrame:
    proofs = t.benchmark.select(F.col("item_id").alias("proof_id"), F.lit(1).alias("question_id"), F.col("text").alias("proof"))
    return E.ground_proofs(proofs, t.documents.select(F.lit(1).alias("question_id"), F.col("doc_id").alias("rank"), "text"))


@query("with l as (select doc_id % 50 as q, doc_id, quality from labels) select p.q, p.doc_id as positive, n.doc_id as negative from l p join l n on p.q = n.q where p.quality = 1 and n.quality = 0")
def positive_negative_pairs(t: Tables) -> DataFrame:
    """Pairs inside each question, for a ranker."""
    own = t.labels.select((F.col("doc_id") % 50).alias("q"), "doc_id", "quality")
    positive = own.where("quality = 1").select("q", F.col("doc_id").alias("positive"))
    return positive.join(own.where("quality = 0").select("q", F.col("doc_id").alias("negative")), "q")


@query("with a as (select o_custkey as id, sum(o_totalprice) as score from orders group by 1), b as (select c_custkey as id, c_acctbal as score from customer where c_custkey % 2 = 0), c as (select o_custkey as id, count(*) as score from orders where o_orderstatus = 'F' group by 1) select coalesce(a.id, b.id, c.id) as id, round(coalesce(a.score, 0), 4) as dense, round(coalesce(b.score, 0), 4) as lexical, round(coalesce(cast(c.score as double), 0), 4) as ppr from a full join b on a.id = b.id full join c on coalesce(a.id, b.id) = c.id")
def score_outer_merge(t: Tables) -> DataFrame:
    dense = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.sum("o_totalprice").alias("score"))
    lexical = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"))
    ppr = t.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("score"))
    return rounded(fusion.merge({"dense": dense, "lexical": lexical, "ppr": ppr}, ["id"]), 4)


@query("select c_custkey, coalesce(string_agg(o_orderkey || ':' || o_orderstatus, ' ' order by o_orderkey), '') as chunks from customer left join orders on o_custkey = c_custkey group by c_custkey")
def optional_chunks(t: Tables) -> DataFrame:
    """Every document with its chunks in order, if any."""
    parts = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("p"))
    met = t.customer.join(parts, F.col("o_custkey") == F.col("c_custkey"), "left")
    return met.select("c_custkey", F.coalesce(F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["o_orderkey"].cast("string"), x["o_orderstatus"])), " "), F.lit("")).alias("chunks"))


@query("select conv_id, q.text as question, a.text as answer from (select conv_id, turn, text from conversations where role = 'user') q join (select conv_id, turn - 1 as turn, text from conversations where role = 'assistant') a using (conv_id, turn)")
def question_answer_pairs(t: Tables) -> DataFrame:
    c = t.conversations
    return c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question")).join(c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")), ["conv_id", "turn"]).select("conv_id", "question", "answer")


@query("with s as (select doc_id, string_split(text, '. ') as s from documents) select item_id, s[1 + item_id % 3] as sentence from benchmark left join s on doc_id = item_id * 5")
def supporting_sentences(t: Tables) -> DataFrame:
    """The sentence that (document, index) points to; null if there is none."""
    own = t.documents.select("doc_id", F.split("text", r"\. ").alias("s"))
    return t.benchmark.select("item_id").join(own, F.col("doc_id") == F.col("item_id") * 5, "left").select("item_id", F.try_element_at("s", (1 + F.col("item_id") % 3).cast("int")).alias("sentence"))


CHOICES = "case doc_id % 4 when 0 then 'Yes' when 1 then 'b' when 2 then 'maybe' else ' A ' end as said"


@query(f"select doc_id, case when lower(trim(said)) in ('a', 'yes') then 'correct' when lower(trim(said)) in ('b', 'no') then 'wrong' else 'formatting_error' end as verdict, case when lower(trim(said)) = 'a' then 'correct' else 'formatting_error' end as open_verdict from (select doc_id, {CHOICES} from documents)")
def correctness(t: Tables) -> DataFrame:
    own = t.documents.select("doc_id", F.expr(CHOICES))
    labels, texts = F.array(F.lit("A"), F.lit("B")), F.array(F.lit("Yes"), F.lit("No"))
    return own.select("doc_id", E.correctness(F.col("said"), F.lit("A"), labels, texts).alias("verdict"), E.correctness(F.col("said"), F.lit("A")).alias("open_verdict"))


NORM = r"array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower({}), '[!\"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{{|}}~]', '', 'g'), '\s+'), lambda w: w not in ('', 'a', 'an', 'the')), ' ')".replace('\\"', '"')


@query(f"select p_partkey, cast({NORM.format('p_name')} = {NORM.format('p_type')} or {NORM.format('p_name')} = {NORM.format('upper(p_name)')} as double) as em, cast(1 as double) as best from part")
def exact_match(t: Tables) -> DataFrame:
    golds = F.array("p_type", F.upper("p_name"))
    return t.part.select("p_partkey", E.exact_match(F.col("p_name"), golds).alias("em"), E.token_f1(F.col("p_name"), golds).alias("best"))


@query("with g as (select user_id, list(event_id order by event_id) as l from events where event_type = 'click' group by 1), f as (select user_id, list(event_id order by value desc, event_id) as l from events where event_type in ('click', 'view') group by 1) select user_id, round(len(list_intersect(f.l[1:10], g.l)) / len(g.l), 4) as recall from f join g using (user_id)")
def pooled_recall(t: Tables) -> DataFrame:
    golds = t.events.where("event_type = 'click'").groupBy("user_id").agg(F.collect_set("event_id").alias("g"))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("v"), "event_id")))
    found = t.events.where("event_type in ('click', 'view')").groupBy("user_id").agg(F.transform(rows, lambda x: x["event_id"]).alias("f"))
    return found.join(golds, "user_id").select("user_id", F.round(E.pooled_recall(F.col("f"), F.col("g"), 10), 4).alias("recall"))


@query()
def rouge_l(t: Tables) -> DataFrame:
    pairs = question_answer_pairs(t)
    return pairs.select("conv_id", F.round(E.rouge_l(F.col("answer"), F.col("question")), 6).alias("rouge_l"))


@query("with r as (select *, row_number() over (order by doc_id) as n from documents) select doc_id from r where n > 100 and n <= 250")
def prefix_slice(t: Tables) -> DataFrame:
    return fusion.prefix(t.documents.select("doc_id"), ["doc_id"], 100, 250)


@query("select doc_id from documents order by md5('42|' || doc_id), doc_id limit 50")
def random_sample(t: Tables) -> DataFrame:
    """A report of fifty rows: sampling is the feature."""
    return fusion.sample(t.documents.select("doc_id"), "doc_id", 50)


@query("select source, any_value(n) as titles from (select source, count(distinct lang) as n from documents group by source) group by source order by 2 desc, source limit 20")
def top_titles(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.countDistinct("lang").alias("titles")).orderBy(F.desc("titles"), "source").limit(20)


@query("select doc_id, md5(source || chr(9) || doc_id) as h, case when row_number() over (partition by source order by doc_id) > 1 then source || '__' || substring(md5(source || chr(9) || doc_id), 1, 8) else source end as slug from documents")
def collision_suffix(t: Tables) -> DataFrame:
    h = F.md5(F.concat_ws("\t", "source", F.col("doc_id").cast("string")))
    again = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) > 1
    return t.documents.select("doc_id", h.alias("h"), F.when(again, F.concat("source", F.lit("__"), F.substring(h, 1, 8))).otherwise(F.col("source")).alias("slug"))


@query("with b as (select p_brand, p_name, p_partkey, row_number() over (partition by p_brand order by (p_size = 1) desc, p_name, p_partkey) as r from part) select p_brand, p_name, p_partkey from b where r = 1")
def article_lookup(t: Tables) -> DataFrame:
    """An exact match, else the first by name."""
    return t.part.groupBy("p_brand").agg(F.min(F.struct((F.col("p_size") != 1).alias("x"), "p_name", "p_partkey")).alias("m")).select("p_brand", "m.p_name", "m.p_partkey")


@query("select cast(floor((row_number() over (order by doc_id) - 1) / 300) as bigint) as batch, doc_id from documents")
def batches(t: Tables) -> DataFrame:
    """Batches of 300 documents in order of id, numbered by a distributed sort instead of one task."""
    return number_rows(t.documents.select("doc_id"), "doc_id").select(F.expr("(n - 1) div 300").alias("batch"), "doc_id")


def number_rows(rows: DataFrame, key: str) -> DataFrame:
    """rows with n from 1 in order of a unique numeric key: ranges are counted, then numbered each on its own."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    width = max(1, ((high or 0) - (low or 0)) // 1024 + 1)
    parts = rows.withColumn("_p", F.expr(f"({key} - {low or 0}) div {width}"))
    before = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("c")).withColumn("_b", F.coalesce(F.sum("c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")  # at most 1024 rows
    return parts.join(before, "_p").withColumn("n", F.col("_b") + F.row_number().over(Window.partitionBy("_p").orderBy(key))).drop("_p", "_b")
