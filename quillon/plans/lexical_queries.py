"""BM25 queries: documents are chunked by words, benchmark items ask."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.catalog import Tables, query
from quillon.operators import lexical as L
from quillon.operators import segment as S
from quillon.plans.runlog_queries import rounded
from quillon.session import written

TOK = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda w: w <> '')"
CHUNKS = r"""w as (select doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') as w from documents),
c as (select doc_id, doc_id || '_' || lpad(cast(n as varchar), 4, '0') as id, array_to_string(w[n * 200 + 1 : n * 200 + 200], ' ') as text from (select doc_id, w, unnest(range(0, (len(w) + 199) // 200)) as n from w))"""
INDEX = f"""t as materialized (select id, doc_id, {TOK} as t from c), s as (select count(*) as n, avg(len(t)) as average from t),
p as materialized (select id, doc_id, length, term, count(*) as tf from (select id, doc_id, len(t) as length, unnest(t) as term from t) group by all), d as materialized (select term, count(*) as df from p group by term),
r as materialized (select term, ln(n - df + 0.5) - ln(df + 0.5) as raw, ln(1 + (n - df + 0.5) / (df + 0.5)) as plus from d, s), i as materialized (select term, case when raw < 0 then 0.25 * mean else raw end as idf, plus from r, (select avg(raw) as mean from r)),
q as (select item_id as query_id, term, count(*) as times from (select item_id, unnest({TOK}) as term from benchmark) group by all)"""

BEST = """m as (select query_id, id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * length / average))) as score from q join i using (term) join p using (term), s group by 1, 2),
a as (select b.item_id as query_id, c.id, coalesce(m.score, 0) as score from benchmark b cross join c left join m on m.query_id = b.item_id and m.id = c.id),
k as (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from a)"""


def chunks(t: Tables, size: int = 200) -> DataFrame:
    return S.word_chunks(t.documents, size).select(F.col("chunk_id").alias("id"), "doc_id", "text")


def questions(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


def kept(own: DataFrame) -> L.Index:
    """An index of written tokens, so texts are cut once for all its passes."""
    return L.of_tokens_table(written(L.tokens(own), "tokens"))


@query(f"with {CHUNKS}, {INDEX}, {BEST} select query_id, id, round(score, 6) as score, cast(rank as int) as rank from k where rank <= 10")
def bm25_topk(t: Tables) -> DataFrame:
    own = chunks(t)
    return rounded(L.top_k(kept(own), questions(t), 10))


@query(f"""with {CHUNKS}, {INDEX}, m as (select query_id, term, id, doc_id, times * plus * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / average)) as score from q join i using (term) join p using (term), s where times * length > 0),
k as (select *, row_number() over (partition by query_id, term order by round(score, 9) desc, id) as r from m) select query_id, doc_id, round(sum(score), 6) as score from k where r <= 20 group by 1, 2""")
def fulltext_documents(t: Tables) -> DataFrame:
    """Each search term's twenty best chunks, summed by document."""
    own = chunks(t)
    scores = L.best_of_terms(kept(own), questions(t), 20, kind="plus", k1=1.2)
    return rounded(L.document_scores(scores, own, 20))


@query(f"with {CHUNKS}, {INDEX} select term, df, round(idf, 6) as idf from i join d using (term)")
def inverted_index(t: Tables) -> DataFrame:
    ix = L.index(chunks(t))
    return rounded(ix.terms.join(L.weights(ix), "term").select("term", "df", "idf"))
