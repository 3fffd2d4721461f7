"""Vector search: many queries without the driver, and the inverted file against the exact scan."""

import numpy as np
import pytest

from quillon.operators import vector_index, vector_search


def vectors(spark, x, start=0):
    return spark.createDataFrame([(start + i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, vector array<float>").repartition(3)


def clustered(n, dim=16, groups=30, seed=1):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((groups, dim))[rng.integers(groups, size=n)] + 0.6 * rng.standard_normal((n, dim))).astype(np.float32)


@pytest.mark.parametrize(("metric", "k", "least"), [("cosine", 5, None), ("dot", None, 8.0), ("L2", 3, -4.0)])
def test_blocks_equal_broadcast(spark, monkeypatch, metric, k, least):
    x = clustered(300)
    x[7] = x[3]
    df = vectors(spark, x)
    found = lambda: sorted((r.query_id, r.rank, r.id, round(r.score, 9)) for r in vector_search.top_k(df, df, k, metric, least).collect())
    want = found()
    monkeypatch.setattr(vector_search, "BLOCK", 37)
    monkeypatch.setattr(vector_search, "PART", 50)
    monkeypatch.setattr(vector_search, "SLICE", 10)
    assert found() == want and len(want) > 300


def test_plan_does_not_grow_with_queries(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "BLOCK", 4)
    df = vectors(spark, clustered(60))
    size = lambda q: len(vector_search.top_k(df, q, 3)._jdf.queryExecution().optimizedPlan().toString().split("\n"))
    assert size(df) == size(vectors(spark, clustered(8)))
    assert vector_search.top_k(df, df.limit(0), 3).count() == 0 and vector_search.top_k(df.limit(0), df, 3).count() == 0


def recall(found, want):
    got, have = {(r.query_id, r.id) for r in found}, {(r.query_id, r.id) for r in want}
    return len(got & have) / len(have)


@pytest.mark.parametrize("metric", ["cosine", "L2"])
def test_index(spark, tmp_path, metric):
    df = vectors(spark, clustered(3000))
    ix = vector_index.VectorIndex(spark, str(tmp_path / "ix"), metric).build(df)
    assert len(ix.centers) == 55 and ix.table.count() == 3000
    asked = df.where("id % 50 = 0")
    want = vector_search.top_k(df, asked, 10, metric).collect()
    by = [recall(ix.search(asked, 10, p).collect(), want) for p in (1, 8, 55)]
    assert by[0] < by[1] and by[1] >= 0.95 and by[2] == 1
    key = lambda r: (r.query_id, r.rank)
    assert [(r.query_id, r.id, r.rank) for r in sorted(ix.search(asked, 10, 55).collect(), key=key)] == [(r.query_id, r.id, r.rank) for r in sorted(want, key=key)]


def test_index_reads_only_probed_cells(spark, tmp_path):
    df = vectors(spark, clustered(800))
    ix = vector_index.VectorIndex(spark, str(tmp_path / "ix")).build(df, cells=20)
    found = ix.search(df.where("id = 5"), 3, probes=2)
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "cell#" in plan.split("PartitionFilters", 1)[1][:80]
    cells = {r.cell for r in ix.table.select("cell").distinct().collect()}
    read = ix.table.join(found.select("id"), "id").select("cell").distinct().count()
    assert len(cells) > 10 and read <= 2


def test_index_add_and_odd_rows(spark, tmp_path):
    x = clustered(200)
    x[0] = 0
    odd = spark.createDataFrame([(900, None)], "id long, vector array<float>")
    ix = vector_index.VectorIndex(spark, str(tmp_path / "ix")).build(vectors(spark, x[:150]).unionByName(odd), cells=5)
    ix.add(vectors(spark, x[150:], 150))
    assert ix.table.count() == 200
    want = vector_search.top_k(vectors(spark, x), vectors(spark, x[:20]), 4).collect()
    assert recall(ix.search(vectors(spark, x[:20]), 4, probes=5).collect(), want) == 1
    assert ix.search(odd, 4).count() == 0
    none = vector_index.VectorIndex(spark, str(tmp_path / "none")).build(odd)
    assert none.search(vectors(spark, x[:2]), 3).count() == 0
    with pytest.raises(ValueError):
        vector_index.VectorIndex(spark, "x", "dot")


def test_leading_equals_a_whole_sort(monkeypatch):
    monkeypatch.setattr(vector_search, "SLICE", 7)
    monkeypatch.setattr(vector_search, "STRIP", 16)
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, (90, 4)).astype(float)  # whole numbers: many scores are equal, and exact
    q, ids, own = x[:40], np.arange(40) + 1000, np.sort(rng.permutation(500)[:90])
    for k in (1, 5, 30, 89):
        for metric, least in (("dot", None), ("dot", 3.0), ("L1", -4.0), ("cosine", 2.0)):
            shuffled = rng.permutation(90)
            got = sorted(zip(*(c.tolist() for c in vector_search._best(own[shuffled], x[shuffled], ids, q, k, metric, least, 1e-9)), strict=True))
            s, want = vector_search._scores(metric, x, q, 1e-9), []
            for j in range(40):
                best = sorted(zip((-s[:, j]).tolist(), own.tolist(), strict=True))[:k]
                want += [(int(ids[j]), i, -v) for v, i in best if least is None or -v >= least]
            assert got == sorted(want)


def test_many_vectors_move_few_times(spark, monkeypatch):
    assert vector_search.PART >= 100000  # k rows a query and part are shuffled
    monkeypatch.setattr(vector_search, "BLOCK", 50)
    df = vectors(spark, clustered(300))
    want = sorted((r.query_id, r.id, r["rank"]) for r in vector_search.top_k(df, df, 4, "L2").collect())
    monkeypatch.setattr(vector_search, "PAIRS", 1)
    monkeypatch.setattr(vector_search, "ASKED_LEAST", 20)
    found = vector_search.top_k(df, df, 4, "L2")
    assert sorted((r.query_id, r.id, r["rank"]) for r in found.collect()) == want and "RepartitionByExpression" in found._jdf.queryExecution().analyzed().toString()
