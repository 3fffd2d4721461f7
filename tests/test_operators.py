import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import cluster, fusion, graph, knowledge, lexical, runlog, tuning, vector_search
from quillon.plans import store
from quillon.sources import readers, writers
from quillon.streaming import ingest


def log(spark, rows):
    start = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([("r", start + datetime.timedelta(seconds=i), k, q, str(v), i) for i, (k, q, v) in enumerate(rows)], "run_id string, timestamp timestamp, entry_type string, identifier string, value string, row_no long")


def test_recall(spark):
    own = log(spark, [("proof", "q1", x) for x in (0, 3, 7, -1, -1)] + [("proof", "q2", 1)])
    assert runlog.recall_at_k(own, [5]).first().recall_5 == pytest.approx(70.0)


def test_faithfulness_takes_last_verdict(spark):
    own = log(spark, [("proof", "q1", 0), ("correctness", "q1", "wrong"), ("correctness", "q1", "correct"), ("proof", "q2", -1)])
    r = runlog.faithfulness(own, 5).first()
    assert (r.faithfulness, r.unsupported) == (100.0, 0.0)


def test_cost(spark):
    c = lambda a: spark.range(1).select(runlog.cost(F.lit(a), F.lit(2e6), F.lit(1e6))).first()[0]
    assert c(0.0) == 1.0 and c(0.3) == 0.3


def test_triples(spark):
    rows = [(1, "a", "r", "b", "c1", 1), (2, "a", "r", "b", "c2", 1), (3, "a", "r", "b", "c3", 1)]
    own = spark.createDataFrame(rows, "pos long, s string, r string, o string, chunk string, rank long")
    r = knowledge.deduplicate(own).first()
    assert (r["rank"], r.chunk) == (3, "c1")
    two = spark.createDataFrame([(1, "A", "r", "B", "c", 2), (2, "a", "R", "b ", "d", 3)], own.schema)
    r = knowledge.assertions(two).collect()
    assert len(r) == 1 and r[0]["rank"] == 5 and r[0].chunks == ["c", "d"]


def test_aliases():
    got = knowledge.aliases_of([("Curie", "won", "prize"), ("prize", "also known as", "award")], [("Curie", "Person"), ("Marie Curie", "Person"), ("prize", "Thing"), ("Bohr", "Person")])
    assert got == [("Marie Curie", "Person", ["Curie"]), ("prize", "Thing", ["award"])]


def test_pagerank_keeps_mass(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("a", "b", 1.0)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([(1, "a", 2.0), (1, "lonely", 1.0), (1, "c", -5.0)], "query_id int, node string, weight double")
    got = {r.node: r.score for r in graph.pagerank(edges, seeds, 0.5, 30, normalize=True).collect()}
    assert sum(got.values()) == pytest.approx(1.0) and got["lonely"] > got["c"]
    p = np.array([[0, 1, 0, 0], [0.5, 0, 0.5, 0], [0, 1, 0, 0], [2 / 3, 0, 0, 1 / 3]])
    v = s = np.array([2 / 3, 0, 0, 1 / 3])
    for _ in range(30):
        v = 0.5 * s + 0.5 * v @ p
    assert [got[k] for k in ("a", "b", "c", "lonely")] == pytest.approx(v)


def test_token_prefix(spark):
    rows = spark.createDataFrame([(1, 1, 2000), (1, 2, 1000), (1, 3, 800), (1, 4, 10)], "query_id int, rank int, size int")
    assert fusion.token_prefix(rows, "size", 3500).count() == 2
    assert fusion.token_prefix(rows, "size", 3500, inclusive=True).count() == 3


def test_min_max(spark):
    rows = spark.createDataFrame([(1, 2.0), (1, 4.0), (1, 6.0), (2, 3.0), (2, 3.0)], "query_id int, score double")
    assert [r.score for r in vector_search.min_max(rows).orderBy("query_id", "score").collect()] == [0.0, 0.5, 1.0, 1.0, 1.0]


def test_top_k_ties_and_empty(spark):
    items = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)], "id long, vector array<double>")
    got = vector_search.top_k(items, items.where("id = 0"), 2).collect()
    assert [r.id for r in got] == [0, 1]
    assert vector_search.top_k(items.limit(0), items, 2).count() == 0 and vector_search.top_k(items, items.limit(0), 2).count() == 0


def test_bm25_fills_with_zero(spark):
    chunks = spark.createDataFrame([("a", "x y"), ("b", "z"), ("c", "x")], "id string, text string")
    asked = spark.createDataFrame([(1, "z"), (2, "nothing")], "query_id int, text string")
    got = [(r.query_id, r.id) for r in lexical.top_k(lexical.index(chunks), asked, 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, "b"), (1, "a"), (2, "a"), (2, "b")]


def test_kmeans_and_mixture():
    x = np.vstack((np.random.default_rng(1).normal(0, 0.1, (30, 3)), np.random.default_rng(2).normal(5, 0.1, (20, 3))))
    centers, own = cluster.kmeans(x, 2)
    assert sorted(np.bincount(own)) == [20, 30]
    parts = cluster.soft_clusters(x)
    assert set(np.concatenate(parts)) == set(range(50))


def test_pairwise_weights(spark):
    rows = spark.createDataFrame([(q, i % 2, float(i % 2) + 0.01 * i, float(-(i % 3))) for q in range(4) for i in range(10)], "q int, y int, good double, bad double")
    w = tuning.pairwise_weights(rows, "q", "y", ["good", "bad"], rounds=20)
    assert w["good"] == pytest.approx(10) and w["bad"] < 10
    assert tuning.pairwise_weights(rows.where("y = 1"), "q", "y", ["good", "bad"]) == {}


def test_store(spark, tmp_path):
    own = store.CorpusStore(spark, str(tmp_path / "store"), chunk_words=3)
    own.initialize()
    assert not own.is_populated()
    docs = spark.createDataFrame([("d1", "One", "alpha beta gamma delta"), ("d2", "Two", "epsilon zeta")], "doc_id string, title string, text string")
    triples = spark.createDataFrame([(1, "a", "r", "b", "d1_0000", 1), (2, "a", "r", "b", "d2_0000", 2), (3, "x", "r", "y", "d1_0001", 1)], "pos long, s string, r string, o string, chunk string, rank long")
    own.add(docs, triples)
    own.add(docs)
    assert own.count() == 2 and own.table("chunks").count() == 3
    assert own.get_by_id("d1").text == "alpha beta gamma delta"
    assert own.query("zeta", 1).first().doc_id == "d2"
    own.remove(["d1"], keep_shared=True)
    assert own.count() == 1 and own.get_by_id("d1") is None and own.table("assertions").count() == 1
    own.remove(["d2"])
    assert own.count() == 0 and own.table("assertions").count() == 0 and own.table("derived").count() == 0


def test_folders(spark, tmp_path):
    for name, text in (("A", "x\\ref{B} y"), ("B", None)):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}_metadata.json").write_text('{"title": "%s", "yearpub": "2014"}' % name)
        if text:
            (tmp_path / name / f"{name}_raw.txt").write_text(text)
    (tmp_path / "A" / "A_qa.json").write_text('[{"question_id": "1", "question": "why?", "correct_answer": "so", "proofs": [{"document_id": "A", "context": "x"}]}]')
    docs = readers.documents(spark, str(tmp_path))
    rows = {r.doc_id: r for r in docs.collect()}
    assert rows["A"].text == "x\\ y" and rows["A"].references == ["B"] and rows["B"].text is None and rows["A"].year == 2014
    assert readers.questions(spark, docs).first().question == "why?"


def test_log_round_trip(spark, tmp_path):
    writers.append_log(log(spark, [("a", "q,1", 'x"y')]), str(tmp_path / "log"))
    r = readers.run_log(spark, str(tmp_path / "log")).first()
    assert (r.identifier, r.value) == ("q,1", 'x"y')


def test_stream_ingests_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
        ingest.ingest_once(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        docs.write.mode("append").parquet(str(tmp_path / "in"))
    assert spark.read.parquet(str(tmp_path / "out/chunks")).count() == 2


def test_greedy_articles_considers_every_order(spark, tmp_path):
    from quillon import catalog
    from quillon.operators import tuning

    rng = np.random.default_rng(14)
    lines = [(k, int(s)) for k in range(1, 4001, 13) for s in rng.integers(1, 90, rng.integers(1, 5))]
    spark.createDataFrame([(k,) for k in sorted({k for k, _ in lines})], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    groups = {}
    for k, s in lines:
        groups.setdefault(k, []).append(str(s))
    want = tuning.greedy_selection(sorted(groups.items()), 60)
    assert max(want) > 2000
    assert sorted(r.question for r in catalog.queries()["greedy_articles"](spark, str(tmp_path)).collect()) == want


def test_trees_hold_every_document(spark, tmp_path):
    from quillon import catalog

    texts = {i: " ".join(f"w{i}x{j % 97}" for j in range(n)) for i, n in enumerate((5, 300, 900, 2600, 3000))}
    spark.createDataFrame([*texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*texts.items()], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = lambda name: catalog.queries()[name](spark, str(tmp_path))
    nodes = run("summary_tree").withColumn("key", F.xxhash64("group", "id")).collect()
    assert {i: sum(n.group == i and n.layer == 0 for n in nodes) for i in texts} == {0: 1, 1: 2, 2: 5, 3: 13, 4: 15}
    assert {n.group for n in nodes if n.layer > 0} == {3, 4}
    groups = {n.key: n.group for n in nodes}
    for name in ("collapsed_tree", "tree_traversal"):
        found = {(r.query_id, groups[r.id]) for r in run(name).collect()}
        assert {(i, i) for i in texts} <= found, name
    assert {groups[r.id] for r in run("tree_traversal").where("layer = 0").collect()} == set(texts)
