"""Triples, assertions, entities and their aliases."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions.text import ALIAS_RELATIONS


def deduplicate(triples: DataFrame) -> DataFrame:
    """One row for equal (s, r, o): the first chunk and its rank plus one for each repeat; pos is the first position."""
    return triples.groupBy("s", "r", "o").agg(F.min_by("chunk", "pos").alias("chunk"), (F.min_by("rank", "pos") + F.count(F.lit(1)) - 1).alias("rank"), F.min("pos").alias("pos"))


def assertions(triples: DataFrame) -> DataFrame:
    """Triples that are equal but for case and outer blanks as one: ranks add up, chunks are gathered, the first form stays."""
    key = T.assertion_id(F.col("s"), F.col("r"), F.col("o"))
    first = [F.min_by(c, "pos").alias(n) for c, n in (("s", "subject"), ("r", "predicate"), ("o", "object"))]
    return triples.groupBy(key.alias("id")).agg(F.sum("rank").alias("rank"), F.array_sort(F.collect_set("chunk")).alias("chunks"), *first)


def mentions(triples: DataFrame) -> DataFrame:
    """(entity, chunk), each once."""
    return triples.select("chunk", F.explode(F.array("s", "o")).alias("entity")).distinct()


def entity_chunks(triples: DataFrame, chunks: DataFrame, names: list[str]) -> DataFrame:
    """(chunk, doc_id, entity) for entities of these names, whatever their case."""
    own = mentions(triples).where(F.lower("entity").isin([n.lower() for n in names]))
    return own.join(chunks.select("chunk", "doc_id"), "chunk").select("chunk", "doc_id", "entity").distinct()


def resolve(triples: DataFrame, aliases: DataFrame) -> DataFrame:
    """Subjects and objects under their canonical names; aliases: alias (lower case) and canonical."""
    for c in ("s", "o"):
        one = aliases.select(F.col("alias").alias("_a"), F.col("canonical").alias("_c"))
        triples = triples.join(one, F.lower(F.trim(c)) == F.col("_a"), "left").withColumn(c, F.coalesce("_c", c)).drop("_a", "_c")
    return triples


def merge_entities(entities: DataFrame) -> DataFrame:
    """By name: the first type that is not empty, and all aliases in order."""
    kind = F.min_by(F.when(F.col("type") != "", F.col("type")), F.when(F.col("type") != "", F.col("pos")))
    rows = F.array_sort(F.collect_list(F.struct("pos", "aliases")))
    return entities.groupBy("name").agg(kind.alias("type"), F.array_distinct(F.flatten(F.transform(rows, lambda x: x["aliases"]))).alias("aliases"))


def valid_triples(triples: DataFrame, column: str) -> DataFrame:
    """Arrays of arrays: those with three parts, each once."""
    return triples.withColumn(column, F.array_distinct(F.filter(column, lambda t: F.size(t) == 3)))


def _order(name: str, kind: str) -> tuple:
    """Which of two names becomes canonical: two-word persons, then persons, then more words, then more letters."""
    words = len(name.split())
    return (kind == "Person" and words == 2, kind == "Person", words, len(name))


def aliases_of(triples: list[tuple[str, str, str]], entities: list[tuple[str, str]]) -> list[tuple[str, str, list[str]]]:
    """Entities (name, type, aliases) of one document.

    Kept are entities that a triple mentions, and a two-word person that a mentioned one-word person can only mean. The
    latter's name becomes an alias of the former. Triples with an alias relation merge two kept entities, or give one
    the other name as an alias.
    """
    low = lambda s: s.strip().lower()
    said = {low(x) for s, _, o in triples for x in (s, o)}
    full = defaultdict(set)
    for name, kind in entities:
        if kind == "Person" and len(name.split()) == 2:
            for part in name.split():
                full[low(part)].add(low(name))
    short = {low(n): next(iter(full[low(n)])) for n, kind in entities if kind == "Person" and len(n.split()) == 1 and low(n) in said and len(full[low(n)]) == 1}
    keep = said | set(short.values())
    known: dict[str, tuple[str, str]] = {}
    for name, kind in entities:
        if low(name) in keep:
            known.setdefault(low(name), (name, kind))
    parent = {k: k for k in known}
    extra: dict[str, list[str]] = defaultdict(list)

    def top(k: str) -> str:
        while parent[k] != k:
            k = parent[k]
        return k

    def merge(a: str, b: str) -> None:
        a, b = top(a), top(b)
        if a != b:
            win, lose = (a, b) if _order(*known[a]) >= _order(*known[b]) else (b, a)
            parent[lose] = win
            extra[win] += [known[lose][0], *extra.pop(lose, [])]

    for one, whole in short.items():
        if one in known and whole in known:
            merge(whole, one)
    for s, r, o in triples:
        rel = low(r)
        if "alias" in rel or "also known as" in rel or rel in ALIAS_RELATIONS:
            a, b = low(s), low(o)
            if a in known and b in known:
                merge(a, b)
            elif a in known or b in known:
                extra[top(a if a in known else b)].append((o if a in known else s).strip())
    out = []
    for k, (name, kind) in known.items():
        if top(k) == k:
            out.append((name, kind, [x for x in dict.fromkeys(extra[k]) if low(x) != k]))
    return sorted(out, key=lambda e: (e[1], low(e[0])))


def build_aliases(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, name, type, aliases, place) from triples (doc_id, pos, s, r, o) and entities (doc_id, pos, name, type). Documents are independent groups."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("pos"), right.sort_values("pos")
        doc = (left if len(left) else right)["doc_id"].iloc[0]
        rows = aliases_of(list(zip(left["s"], left["r"], left["o"], strict=True)), list(zip(right["name"], right["type"], strict=True)))
        return pd.DataFrame([(doc, *r, i) for i, r in enumerate(rows)], columns=["doc_id", "name", "type", "aliases", "place"])

    return triples.groupBy("doc_id").cogroup(entities.groupBy("doc_id")).applyInPandas(run, "doc_id long, name string, type string, aliases array<string>, place int")
