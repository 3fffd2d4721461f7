"""Indexes, merged spans, metadata, caches, trees and rounds over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.catalog import Tables, query
from quillon.functions import maps, models, spans
from quillon.functions import text as T
from quillon.operators import corpus_tree, fulltext, lexical, rounds, vector_index
from quillon.operators import segment as S
from quillon.plans.cache import EmbeddingCache
from quillon.plans.lexical_queries import CHUNKS, TOK
from quillon.plans.lexical_queries import chunks as cut_chunks
from quillon.plans.lexical_queries import questions as asked
from quillon.plans.runlog_queries import rounded
from quillon.session import shared_folder, written

V = "v as (select vec_id, cast(embedding as double[]) as e from embeddings)"
COSINE = "list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)) + 1e-9)"


def _folder(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/quillon-files-{uuid.uuid4().hex}"


def _index(t: Tables) -> vector_index.VectorIndex:
    return vector_index.VectorIndex(t.spark, _folder(t)).build(_vectors(t))


def _vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query()
def vector_index_search(t: Tables) -> DataFrame:
    """The ten nearest of each question, every fiftieth vector, from the eight cells nearest to it."""
    return rounded(_index(t).search(_vectors(t).where("id % 50 = 0"), 10, probes=8))


@query(f"with {V}, s as (select a.vec_id as query_id, b.vec_id as id, {COSINE} as score from v a join v b on a.vec_id % 50 = 0), r as (select *, cast(row_number() over (partition by query_id order by score desc, id) as int) as rank from s) select query_id, id, round(score, 6) as score, rank from r where rank <= 10")
def vector_index_all_cells(t: Tables) -> DataFrame:
    """With every cell probed the index is exact."""
    return rounded(_index(t).search(_vectors(t).where("id % 50 = 0"), 10, probes=vector_index.CELLS))


def _nodes(t: Tables) -> DataFrame:
    """Documents with a title (their first eight words) and an author (the language)."""
    return t.documents.select(F.col("doc_id").alias("id"), F.array_join(F.slice(T.words(F.col("text")), 1, 8), " ").alias("title"), "source", F.col("lang").alias("author"), "text")


def _fielded(nodes: str, fields: list[str]) -> str:
    """The same in SQL: postings by field, each with its own frequencies and lengths."""
    each = " union all ".join(f"select id, '{f}' as field, {TOK.replace('lower(text)', f'lower({f})')} as t from n where {f} is not null" for f in fields)
    return f"""with {nodes}, x as materialized (select id, field, t, len(t) as length from ({each}) where len(t) > 0), s as (select field, count(*) as n, avg(length) as average from x group by field),
p as materialized (select id, field, length, term, count(*) as tf from (select id, field, length, unnest(t) as term from x) group by all), d as (select field, term, count(*) as df from p group by all),
q as (select query_id, term, count(*) as times from (select query_id, unnest({TOK}) as term from asked) group by all),
m as (select query_id, id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / average))) as score from q join p using (term) join d using (field, term) join s using (field) group by 1, 2),
r as (select *, cast(row_number() over (partition by query_id order by round(score, 9) desc, id) as int) as rank from m) select query_id, id, round(score, 6) as score, rank from r where rank <= 10"""


@query(_fielded(r"n as (select doc_id as id, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')[1:8], ' ') as title, source, lang as author, text from documents), asked as (select item_id as query_id, text from benchmark)", ["title", "source", "author", "text"]))
def fulltext_fields(t: Tables) -> DataFrame:
    """Documents by title, source, author and text."""
    return rounded(fulltext.search(_nodes(t), asked(t), fulltext.FIELDS["documents"]))


@query(_fielded("n as (select p_partkey as id, p_name as name, array_to_string([p_brand, p_type], ' ') as aliases from part), asked as (select s_suppkey as query_id, s_name || ' ' || p_type || ' ' || p_name as text from supplier join part on s_suppkey = p_partkey)", ["name", "aliases"]))
def fulltext_entities(t: Tables) -> DataFrame:
    """Parts by name and aliases, a list; each supplier asks for the part of its number."""
    nodes = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.array("p_brand", "p_type").alias("aliases"))
    said = t.supplier.join(t.part, F.col("s_suppkey") == F.col("p_partkey")).select(F.col("s_suppkey").alias("query_id"), F.concat_ws(" ", "s_name", "p_type", "p_name").alias("text"))
    return rounded(fulltext.search(nodes, said, fulltext.FIELDS["entities"]))


@query(_fielded("n as (select event_id as id, event_type || ' at ' || strftime(ts, '%H') as predicate from events), asked as (select distinct user_id as query_id, event_type || ' ' || strftime(ts, '%H') as text from events where event_id in (select min(event_id) from events group by user_id))", ["predicate"]))
def fulltext_predicates(t: Tables) -> DataFrame:
    """Predicates made of events; each user asks with its first event."""
    said = lambda joint: F.concat(F.col("event_type"), F.lit(joint), F.date_format("ts", "HH"))
    first = t.events.groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return rounded(fulltext.search(t.events.select(F.col("event_id").alias("id"), said(" at ").alias("predicate")), t.events.join(first, ["user_id", "event_id"]).select(F.col("user_id").alias("query_id"), said(" ").alias("text")), fulltext.FIELDS["assertions"]))


def _tagged(t: Tables) -> DataFrame:
    """Words of chunks of forty words as spans of three labels, by their length, but for every fifth."""
    pieces = S.word_chunks(t.documents, 40).select(F.col("chunk_id").alias("id"), "text", F.split("text", " ").alias("w"))
    grown = F.aggregate("w", F.array(F.lit(0)), lambda a, w: F.concat(a, F.array(F.element_at(a, -1) + F.length(w) + 1)))
    label = lambda w: F.when(F.length(w) % 3 == 0, "B-PER").when(F.length(w) % 3 == 1, "I-ORG").otherwise("LOC")
    made = F.transform("w", lambda w, i: F.struct(F.get("at", i).alias("start"), (F.get("at", i) + F.length(w)).alias("end"), label(w).alias("label")))
    return pieces.withColumn("at", grown).select("id", "text", F.filter(made, lambda s, i: i % 5 != 4).alias("spans"))


TAGGED = rf"""{CHUNKS.replace("199", "39").replace("200", "40")}, tw as (select id, text, string_split(text, ' ') as w from c), tu as (select id, text, unnest(w) as w, unnest(range(0, len(w))) as i from tw),
tp as (select *, cast(coalesce(sum(length(w) + 1) over (partition by id order by i rows between unbounded preceding and 1 preceding), 0) as int) as a, case length(w) % 3 when 0 then 'PER' when 1 then 'ORG' else 'LOC' end as label from tu),
ts as (select id, text, i, a, a + length(w) as z, label from tp where i % 5 <> 4), tl as (select *, lag(z) over (partition by id order by i) as before, lag(label) over (partition by id order by i) as l from ts),
tg as (select *, sum(case when l = label and substring(text, before + 1, a - before) = ' ' then 0 else 1 end) over (partition by id order by i) as island from tl),
ti as (select id, text, island, label, min(a) as a, max(z) as z from tg group by all)"""


@query(f"with {TAGGED} select id, cast(count(*) as int) as n, string_agg(label || ':' || a || '-' || z, ' ' order by a) as spans from ti group by id")
def merged_spans(t: Tables) -> DataFrame:
    """Neighbouring spans of one label as one: a fold here, gaps and islands in SQL."""
    found = _tagged(t).select("id", spans.merged(F.col("text"), F.col("spans")).alias("s"))
    return found.select("id", F.size("s").alias("n"), F.array_join(F.transform("s", lambda s: F.concat(s["label"], F.lit(":"), s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), " ").alias("spans"))


@query(rf"""with {TAGGED}, tn as (select id, label, substring(text, a + 1, z - a) as name, a from ti), tk as (select *, lower(regexp_replace(name, '^["''`´“”„‚«»‹›‘’]+', '')) as key from tn),
tf as (select * from tk qualify row_number() over (partition by id, label, key order by a) = 1)
select id, string_agg(name || '=' || case label when 'PER' then 'Person' when 'LOC' then 'Location' else 'Organization' end, '|' order by a) as names from tf group by id""")
def span_names(t: Tables) -> DataFrame:
    found = _tagged(t).select("id", "text", spans.merged(F.col("text"), F.col("spans")).alias("s")).select("id", spans.names(F.col("text"), F.col("s")).alias("n"))
    return found.select("id", F.array_join(F.transform("n", lambda x: F.concat(x["name"], F.lit("="), x["type"])), "|").alias("names"))


@query("""with m as (select doc_id, unnest(['source', 'lang', 'original_chunk_id', 'document_title', 'length']) as key, unnest([source, 'xx', cast(doc_id as varchar), nullif(lang, 'en'), cast(n_chars as varchar)]) as value from documents)
select doc_id, key, value from m where value is not null and value <> ''""")
def metadata_defaults(t: Tables) -> DataFrame:
    """What a document says of itself, then defaults for what it lacks."""
    have = maps.of_columns({"source": F.col("source"), "lang": F.lit("xx")})
    more = maps.of_columns({"original_chunk_id": F.col("doc_id"), "source": F.lit("default"), "document_title": F.nullif(F.col("lang"), F.lit("en")), "lang": F.col("lang"), "length": F.col("n_chars"), "empty": F.lit("")})
    return t.documents.select("doc_id", F.explode(maps.with_defaults(have, more)).alias("key", "value")).where("value is not null")


@query("with d as (select text, min(doc_id) as first from documents group by text) select doc_id, first, 64 as size from documents join d using (text)")
def cached_embeddings(t: Tables) -> DataFrame:
    """All documents through the cache twice; equal texts share one vector."""
    cache = EmbeddingCache(t.spark, _folder(t))
    docs = t.documents.select("doc_id", "text")
    cache.encode(docs, models.encode).limit(0).collect()
    out = cache.encode(docs, models.encode)
    by = t.documents.groupBy("text").agg(F.min("doc_id").alias("first"))
    return out.join(by, "text").select("doc_id", "first", F.size("vector").alias("size"))


@query()
def corpus_summary_tree(t: Tables) -> DataFrame:
    """One tree over the chunks of all documents."""
    leaves = S.word_chunks(t.documents, 200).select(F.xxhash64("chunk_id").alias("id"), "text", models.encode(F.col("text")).alias("vector"))
    return corpus_tree.grow(leaves, models.summarize, models.encode, dim=10).select("id", "layer", F.size("children").alias("children"), F.length("text").alias("n_chars"))


@query()
def retrieval_rounds(t: Tables) -> DataFrame:
    """Every item in up to three rounds of BM25, each thought the start of the best passage not thought of yet."""
    own = written(cut_chunks(t), "chunks")
    ix = lexical.kept(written(lexical.tokens(own), "tokens"), written)
    found, state = rounds.iterate(asked(t).withColumnRenamed("text", "question"), own.select("id", "text"), lambda q: lexical.top_k(ix, q, 5), models.next_thought)
    return rounded(found.where("rank <= 5").join(state.select("query_id", "rounds"), "query_id").select("query_id", "id", "score", "rank", "rounds"))


@query()
def named_triples(t: Tables) -> DataFrame:
    """Triples between the names of each chunk, which a first pass found."""
    first = S.word_chunks(t.documents, 200).select(F.col("chunk_id").alias("id"), "text", models.entities(F.col("text")).alias("names"))
    return first.select("id", F.explode(spans.named_triples(F.col("text"), F.col("names"))).alias("x")).select("id", "x.*")
