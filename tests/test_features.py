"""Spans, metadata, fields, caches, snapshots and rounds."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.functions import maps, models, spans
from quillon.operators import fulltext, lexical, rounds
from quillon.plans import cache, snapshots


def test_merged_spans(spark):
    text = "“Jean-Luc’s friend O'Neil of New  York City met U.S. men"
    find = lambda w, k=0: (text.index(w, k), text.index(w, k) + len(w))
    made = [(*find("“Jean"), "B-PER"), (*find("Luc"), "I-PER"), (*find("O"), "B-PER"), (*find("Neil"), "I-PER"), (*find("New"), "LOC"), (*find("York"), "B-LOC"), (*find("City"), "I-LOC"), (*find("U"), "X-Y-Z"), (*find("S", 30), "Y-Z"), (*find("men"), "ORG")]
    df = spark.createDataFrame([(text, made), (text, []), (text, None), (None, made[:1])], "text string, spans array<struct<start:int,end:int,label:string>>")
    out = [None if r.m is None else [(x.start, x.end, x.label) for x in r.m] for r in df.select(spans.merged(F.col("text"), F.col("spans")).alias("m")).collect()]

    def plain():
        done = []
        for start, end, label in made:
            label = label.split("-", 1)[-1]
            gap = text[done[-1][1] : start] if done else None
            if done and done[-1][2] == label and (gap == "" or gap.isspace() or gap in {"-", "’", "'", "."}):
                done[-1] = (done[-1][0], end, label)
            else:
                done.append((start, end, label))
        return done

    assert out[0] == plain() and out[1] == [] and out[2] is None
    repeated = spark.createDataFrame([("The “Cat, the cat, A dog", [(4, 8, "PER"), (14, 17, "PER"), (19, 24, "MISC"), (14, 17, "ORG")])], df.schema)
    names = repeated.select(spans.names(F.col("text"), F.col("spans")).alias("n")).first().n
    assert [tuple(n) for n in names] == [("“Cat", "Person"), ("A dog", "Miscellaneous"), ("cat", "Organization")]


def test_named_triples(spark):
    text = "New York City borders New York. Ann of York, Maine visited New York City!  York met York. Newark is far. Ann, Bob and (Carl). a+b beat $1"
    names = ["York", "New York", "New York City", "Ann", "Bob", "Carl", "a+b", "$1", ""]
    df = spark.createDataFrame([(text, names), ("", names), (None, names), (text, [])], "text string, names array<string>")
    out = df.select(spans.named_triples(F.col("text"), F.col("names")).alias("t")).collect()
    assert [tuple(x) for x in out[0].t] == [
        ("New York City", "borders", "New York"), ("Ann", "of", "York"), ("York", "Maine visited", "New York City"), ("Ann", "is with", "Bob"), ("Bob", "and", "Carl"), ("a+b", "beat", "$1"),
    ]
    assert out[1].t == [] and not out[2].t and out[3].t == []


def test_metadata_defaults(spark):
    df = spark.createDataFrame([({"a": "1"}, {"a": "2", "b": "3", "c": None, "d": ""}), (None, {"a": "2"}), ({}, None), ({"a": None}, {"a": "x"})], "have map<string,string>, more map<string,string>")
    out = [r.m for r in df.select(maps.with_defaults(F.col("have"), F.col("more")).alias("m")).collect()]
    assert out == [{"a": "1", "b": "3"}, {"a": "2"}, {}, {"a": None}]


def test_index_of_tokens_and_of_postings(spark):
    chunks = spark.createDataFrame([(1, "b a b, C a b"), (2, ""), (3, "x"), (4, None)], "id int, text string")
    rows = sorted((r.id, r.term, r.tf, r.length) for r in lexical.postings(chunks).collect())
    assert rows == [(1, "a", 2, 6), (1, "b", 3, 6), (1, "c", 1, 6), (3, "x", 1, 1)]
    lazy, kept = lexical.index(chunks.where("id < 4")), lexical.of_postings(lexical.postings(chunks.where("id < 4")), chunks.where("id < 4"))
    wanted = spark.createDataFrame([("b",), ("x",), ("y",)], "term string")
    q = spark.createDataFrame([(1, "b b x"), (2, "y")], "query_id int, text string")
    for ix in (lazy, kept):
        assert sorted((r.id, r.term, r.tf) for r in ix.postings(wanted, True).collect()) == [(1, "b", 3), (3, "x", 1)] and ix.postings().count() == 4
    found = [sorted((r.query_id, r.id, round(r.score, 9), r["rank"]) for r in lexical.top_k(ix, q, 2).collect()) for ix in (lazy, kept)]
    assert found[0] == found[1] and len(found[0]) == 4


def test_fields(spark):
    rows = [(1, "red fox", ["Reynard", "the fox"], 1.5), (2, "fox", None, 2.0), (3, None, ["fox fox fox"], 0.0), (4, "", [], 0.0), (5, "wolf", ["grey"], 0.0)]
    nodes = spark.createDataFrame(rows, "id int, name string, aliases array<string>, extra double")
    q = spark.createDataFrame([(7, "Fox red fox"), (8, "nothing"), (9, None)], "query_id int, text string")
    got = {(r.query_id, r.id): r.score for r in fulltext.search(nodes, q, ["name", "aliases"]).collect()}

    def bm(tf, length, average, n, df):
        return np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))

    name, alias = (4 / 3, 3), (7 / 3, 3)
    want = {(7, 1): 2 * bm(1, 2, *name, 2) + bm(1, 2, *name, 1) + 2 * bm(1, 3, *alias, 2), (7, 2): 2 * bm(1, 1, *name, 2), (7, 3): 2 * bm(3, 3, *alias, 2)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    twice = {(r.query_id, r.id): r.score for r in fulltext.search(nodes, q, ["name", "aliases"], boost={"aliases": 3.0}).collect()}
    assert abs(twice[7, 3] - 3 * want[7, 3]) < 1e-9
    assert fulltext.search(nodes, q, ["name"], k=1).count() == 1 and fulltext.search(nodes.limit(0), q, ["name"]).count() == 0


def test_embedding_cache(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def encode(text):
        @F.pandas_udf("array<float>")
        def run(s: pd.Series) -> pd.Series:
            seen.add(len(s))
            return s.map(models.hashed_vector)

        return run(text)

    own = cache.EmbeddingCache(spark, str(tmp_path / "cache"))
    texts = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "a b"), (4, ""), (5, None)], "id int, text string")
    first = {r.id: r.vector for r in own.encode(texts, encode).collect()}
    assert seen.value == 3 and first[5] is None and first[1] == first[3] and np.allclose(first[2], np.float32(models.hashed_vector("c")))
    again = {r.id: r.vector for r in own.encode(texts.where("id > 1"), encode).collect()}
    assert seen.value == 3 and again == {i: v for i, v in first.items() if i > 1}
    more = own.encode(texts.unionByName(spark.createDataFrame([(6, "new")], texts.schema)), encode)
    assert more.count() == 6 and seen.value == 4
    own.encode(texts, encode, instruction="query: ").count()
    assert seen.value == 7 and own.contains(texts).where("cached").count() == 4
    assert dict(own.rows.dtypes)["embedding"] == "binary"
    own.put(spark.createDataFrame([(r.h, [1.0, 2.0]) for r in texts.where("id = 2").select(cache.key_of(F.col("text")).alias("h")).collect()], "hash string, vector array<float>"))
    assert {r.id: list(r.vector or []) for r in own.encode(texts, encode).collect()}[2] == [1.0, 2.0]
    own.clear()
    assert own.rows.count() == 0


def test_snapshots(spark, tmp_path):
    own = snapshots.Snapshots(spark, str(tmp_path / "graph"))
    nodes = spark.createDataFrame([(1, "a", [1.5]), (2, None, None)], "id long, name string, vector array<double>")
    edges = spark.createDataFrame([(1, 2, 0.5)], "src long, dst long, weight double")
    with pytest.raises(KeyError):
        own.tables()
    assert own.save({"nodes": nodes, "edges": edges}) == 1
    assert own.save({"nodes": nodes.where("id = 1")}) == 2
    now = own.tables()
    assert now["nodes"].count() == 1 and now["edges"].count() == 1 and now["nodes"].schema == nodes.schema
    assert sorted(own.tables(1)["nodes"].collect()) == sorted(nodes.collect()) and own.restore(1) == 3
    assert sorted(own.tables()["nodes"].collect()) == sorted(nodes.collect())
    failing = nodes.select(F.raise_error(F.lit("no")).cast("int").alias("x"))
    with pytest.raises(Exception, match="no"):
        own.save({"edges": edges.limit(0), "nodes": failing})
    assert own.versions() == [1, 2, 3] and own.tables()["edges"].count() == 1
    with pytest.raises(FileExistsError):
        own._commit(own.manifest(), 3)
    own.vacuum(1)
    assert own.versions() == [3] and own.tables()["nodes"].count() == 2
    folders = [t["folder"] for t in own.manifest().values()]
    assert sorted(f"tables/{p.name}" for p in (tmp_path / "graph" / "tables").iterdir()) == sorted(folders)
    assert json.loads((tmp_path / "graph" / "manifests" / "00000003").read_text()).keys() == {"nodes", "edges"}


def test_rounds(spark):
    passages = {"p1": "alpha leads to beta", "p2": "beta leads to gamma", "p3": "gamma leads to delta", "p4": "nothing here"}
    questions = {1: "alpha", 2: "gamma", 3: "zeta"}
    p = spark.createDataFrame(list(passages.items()), "id string, text string")
    q = spark.createDataFrame(list(questions.items()), "query_id long, question string")
    asked = []

    def retrieve(front):
        asked.append({r.query_id: r.text for r in front.collect()})
        words = front.select("query_id", F.explode(F.array_distinct(F.split("text", " "))).alias("w"))
        met = words.join(p.select("id", F.explode(F.split("text", " ")).alias("w")), "w").groupBy("query_id", "id").agg(F.count(F.lit(1)).cast("double").alias("score"))
        return met.withColumn("rank", F.row_number().over(__import__("pyspark").sql.Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where("rank <= 2")

    def plain():
        best, thoughts, open_, log = {i: {} for i in questions}, {i: [] for i in questions}, set(questions), []
        for _ in range(3):
            log.append({i: thoughts[i][-1] if thoughts[i] else questions[i] for i in open_})
            for i in sorted(open_):
                words = set(log[-1][i].split(" "))
                got = sorted(((-sum(w in words for w in t.split(" ")), k) for k, t in passages.items() if words & set(t.split(" "))))[:2]
                for s, k in got:
                    best[i][k] = max(best[i].get(k, 0), -s)
                read = [passages[k] for k, _ in sorted(best[i].items(), key=lambda x: (-x[1], x[0]))[:5]]
                fresh = [t for t in read if t not in thoughts[i]]
                if len(thoughts[i]) >= 2 or not fresh:
                    thoughts[i].append("So the answer is: " + (read[0] if read else questions[i]))
                    open_ = open_ - {i}
                else:
                    thoughts[i].append(fresh[0])
            if not open_:
                break
        return best, thoughts, log

    found, state = rounds.iterate(q, p, retrieve, models.next_thought)
    best, thoughts, log = plain()
    assert asked == log and len(log) == 3 and 3 not in log[1]
    assert {r.query_id: list(r.thoughts) for r in state.collect()} == thoughts and not state.where("open").count()
    got = {i: {} for i in questions}
    for r in found.collect():
        got[r.query_id][r.id] = r.score
    assert got == best
