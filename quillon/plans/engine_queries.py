"""The engines end to end: every document is indexed in written tables, every benchmark item asks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.catalog import Tables, query
from quillon.plans import engines
from quillon.plans.lexical_queries import BEST, CHUNKS, INDEX
from quillon.plans.runlog_queries import rounded
from quillon.session import shared_folder


def _found(t: Tables, kind: type[engines.Engine], k: int = 10) -> DataFrame:
    engine = kind(t.spark, f"{shared_folder(t.spark)}/quillon-engine-{uuid.uuid4().hex}", chunk_words=200)
    engine.index(t.documents.select("doc_id", "text"))
    found = engine.retrieve(t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("question")), k)
    return rounded(found.select("query_id", "chunk_id", "doc_id", "score", F.col("rank").cast("int").alias("rank")))


@query(f"with {CHUNKS}, {INDEX}, {BEST} select k.query_id, k.id as chunk_id, c.doc_id, round(k.score, 6) as score, cast(k.rank as int) as rank from k join c using (id) where k.rank <= 10")
def lexical_engine(t: Tables) -> DataFrame:
    """BM25 from the written index."""
    return _found(t, engines.LexicalEngine)


@query()
def vector_engine(t: Tables) -> DataFrame:
    """Nearest chunks by cosine; the ids that break ties are hashes that SQL does not have."""
    return _found(t, engines.VectorEngine)
