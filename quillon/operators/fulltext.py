"""Full text over several fields: each field has its own postings, lengths and weights, and a node's scores add up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import lexical, scoring
from quillon.session import written

#: The fields of each kind of node.
FIELDS = {"documents": ["title", "source", "author", "text"], "chunks": ["text"], "entities": ["name", "aliases"], "assertions": ["predicate"]}


def _tokens(field: Column, kind: str) -> Column:
    """Tokens of a string or of a list of strings."""
    return T.tokens(F.array_join(field, " ") if kind.startswith("array") else field.cast("string"))


def search(nodes: DataFrame, queries: DataFrame, fields: list[str], k: int = 10, k1: float = 1.2, b: float = 0.75, boost: dict[str, float] | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k best of nodes (id and fields) for queries (query_id, text), ties (to nine decimals) by id.

    A term's score in a field is BM25 over the nodes that have the field, with ln(1 + (n - df + .5) / (df + .5)); terms
    and fields add up, a field times its boost, a repeated query term repeatedly. Only frequencies of asked terms are
    counted; nodes are scored where they lie while the asked terms are few enough to be broadcast (see scoring.best).
    Nodes without an asked term are not found.
    """
    asked = lexical.asked_terms(queries)
    terms = asked.select("term").distinct()
    few = scoring.few(terms, lexical.SMALL)
    kinds = dict(nodes.dtypes)
    rows = written(nodes.select("id", *[F.coalesce(_tokens(F.col(f), kinds[f]), F.array().cast("array<string>")).alias(f) for f in fields]), "tokens")  # texts are cut once
    each = rows.select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("t")) for f in fields])).alias("x"))
    said = each.select("id", "x.field", "x.t").where(F.size("t") > 0)
    boosts = F.create_map(*[x for f in fields for x in (F.lit(f), F.lit(float((boost or {}).get(f, 1.0))))])
    sizes = said.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("t")).alias("average")).withColumn("boost", boosts[F.col("field")])
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    if few:
        has = said.select("field", F.explode(F.array_distinct("t")).alias("term")).join(F.broadcast(terms), "term", "left_semi")
        df = has.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
        weights = df.join(F.broadcast(sizes), "field").select("field", "term", (F.col("boost") * idf).alias("weight"))
        return scoring.best(rows, fields, asked, weights, sizes.select("field", "average"), k, k1, b)
    met = lexical.of_tokens(said, ["id", "field"], terms)
    df = met.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    weighed = df.join(F.broadcast(sizes), "field").withColumn("idf", idf)
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("average")))
    scored = met.join(weighed, ["field", "term"]).select("id", "term", (F.col("boost") * F.col("idf") * part).alias("part")).groupBy("id", "term").agg(F.sum("part").alias("part"))
    return scoring.ranked(scored.join(asked, "term").groupBy("query_id", "id").agg(F.sum(F.col("times") * F.col("part")).alias("score")), k)
