"""Scoring rows where they lie: the same as brute force, few or many queries, and no pairs are moved."""

import numpy as np
import pytest

from quillon.operators import fulltext, lexical, scoring


def data(spark):
    rng = np.random.default_rng(4)
    chunks = [(f"c{i:03}", " ".join(rng.choice(list("abcdefgh"), rng.integers(0, 9)))) for i in range(60)]
    chunks += [(f"d{i:03}", "a b b") for i in range(30)]
    asks = [(i, " ".join(rng.choice(list("abcdefghxyz"), 3))) for i in range(12)] + [(99, "nothing known")]
    return spark.createDataFrame(chunks, "id string, text string"), spark.createDataFrame(asks, "query_id long, text string")


def rows(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("block", [4096, 3])
def test_best_is_exact(spark, monkeypatch, block):
    chunks, asks = data(spark)
    monkeypatch.setattr(scoring, "BLOCK", block)
    monkeypatch.setattr(scoring, "PART", 20)
    table = lexical.of_postings(lexical.postings(chunks), chunks)
    assert rows(lexical.top_k(lexical.index(chunks), asks, 5)) == rows(lexical.top_k(table, asks, 5))
    monkeypatch.setattr(lexical, "SMALL", 10**6)
    got = rows(fulltext.search(chunks, asks, ["text"], 5))
    monkeypatch.setattr(lexical, "SMALL", 1)
    assert got == rows(fulltext.search(chunks, asks, ["text"], 5)) and not [r for r in got if r[0] == 99]


def test_best_of_terms(spark):
    chunks, asks = data(spark)
    by = chunks.selectExpr("id", "substring(id, 4, 1) as doc_id")
    ix = lexical.index(chunks)
    found = [sorted((r.query_id, r.doc_id, round(r.score, 9)) for r in lexical.document_scores(s, by, 4).collect()) for s in (lexical.best_of_terms(ix, asks, 4), lexical.term_scores(ix, asks, kind="plus", k1=1.2))]
    assert found[0] == found[1] and lexical.best_of_terms(ix, asks, 4).count() < lexical.term_scores(ix, asks).count()


def test_pairs_are_not_grouped(spark):
    """No aggregate by query and chunk: that table had a row for nearly each pair."""
    chunks, asks = data(spark)
    for found in (lexical.top_k(lexical.index(chunks), asks, 5), fulltext.search(chunks, asks, ["text"], 5)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "sum(score" not in plan


def test_label_stands_alone_in_ascii(spark):
    from pyspark.sql import functions as F

    from quillon.functions import text as T

    got = spark.createDataFrame([("x. Réê",), ("it B éA",), ("aB_",)], "t string").select(T.mc_label(F.col("t")).alias("l")).collect()
    assert [r.l for r in got] == ["R", "B", "aB_"]


def test_pairs_are_counted_not_made(spark):
    from quillon.operators import tuning

    rng = np.random.default_rng(0)
    own = [(int(g), int(y), float(a), float(b)) for g, y, a, b in zip(rng.integers(0, 3, 40), rng.integers(0, 2, 40), rng.integers(0, 5, 40), rng.normal(size=40))]
    x = np.array([r[2:] for r in own])
    z, w = (x - x.mean(0)) / x.std(0), np.full(2, 0.5)
    gaps = np.array([z[i] - z[j] for i, p in enumerate(own) for j, n in enumerate(own) if p[0] == n[0] and p[1] == 1 and n[1] == 0])
    for i in range(3):
        w = np.maximum(w + 0.5 / np.sqrt(i + 1) * np.where((gaps @ w < 0.1)[:, None], gaps, 0).mean(0), 0)
    got = tuning.pairwise_weights(spark.createDataFrame(own, "g int, y int, a double, b double"), "g", "y", ["a", "b"], rounds=3)
    raw = w / x.std(0)
    assert np.allclose([got["a"], got["b"]], raw / raw.max() * 10)
