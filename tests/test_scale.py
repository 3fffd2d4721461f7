"""What large tables need: small groups pass no Python, plans stay short, spans are looked at once."""

import numpy as np
from pyspark.sql import functions as F

from quillon.functions import spans
from quillon.operators import cluster, graph


def test_small_groups_are_not_grown(spark):
    leaves = spark.createDataFrame([(g, i, f"t{i}", [1.0, float(i)]) for g in (1, 2) for i in range(1, 4)], "group long, id long, text string, vector array<double>")

    def never(*_):
        raise AssertionError

    tree = cluster.build_tree(leaves, never, never)
    assert tree.count() == 6 and "FlatMapGroups" in (plan := tree._jdf.queryExecution().optimizedPlan().toString()) and "Union" in plan


def test_pagerank_reads_written_scores(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    seeds = spark.createDataFrame([(1, "a", 1.0)], "query_id int, node string, weight double")
    got = graph.pagerank(edges, seeds, 0.5, 3)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r.node: round(r.score, 6) for r in got.collect()} == {"a": 0.5625, "b": 0.3125, "c": 0.0625}


def test_pagerank_in_blocks_and_slices_equals_its_definition(spark, monkeypatch):
    """Many blocks, split ones too, pieces, short steps and several slices give the scores of plain rounds, and rows only where mass comes."""
    for name, value in (("EDGES", 7), ("FEW", 5), ("PIECE", 4), ("STEP", 3), ("WIDTH", 2)):
        monkeypatch.setattr(graph, name, value)
    rng = np.random.default_rng(3)
    pairs = [(f"a{x}", f"b{y}", float(w)) for x, y, w in zip(rng.integers(3, size=40), rng.integers(9, size=40), rng.integers(1, 4, size=40))] + [("far", "off", 1.0)]
    edges = spark.createDataFrame(pairs, "src string, dst string, weight double")
    seeds = spark.createDataFrame([(q, n, w) for q, n, w in zip("uvwxy", ("a0", "b1", "alone", "far", "a1"), (1.0, 2.0, 1.0, 3.0, 0.0))] + [("u", "alone", 1.0)], "query_id string, node string, weight double")
    names = sorted({x for p in pairs for x in p[:2]} | {"alone"})
    at = {x: i for i, x in enumerate(names)}
    for directed, normalize in ((False, False), (False, True), (True, True)):
        a = np.zeros((len(names), len(names)))
        for x, y, w in pairs:
            a[at[x], at[y]] += w
            a[at[y], at[x]] += 0 if directed else w
        total = a.sum(1, keepdims=True)
        p = a / np.where(total, total, 1)
        want = {}
        for q in "uvwxy":
            s = np.zeros(len(names))
            for r in seeds.where(f"query_id = '{q}'").collect():
                s[at[r.node]] += r.weight
            s = s / (s.sum() or 1) if normalize else s
            v, on = s * (1 if normalize else 0.5), np.isin(names, [r.node for r in seeds.where(f"query_id = '{q}'").collect()])
            start = on.copy()
            for _ in range(3):
                v = 0.5 * s + 0.5 * (v @ p) + (0.5 * s * v[total[:, 0] == 0].sum() if normalize else 0)
                on = start | (on.astype(float) @ a > 0)
            want |= {(q, names[i]): v[i] for i in np.flatnonzero(on)}
        got = {(r.query_id, r.node): r.score for r in graph.pagerank(edges, seeds, 0.5, 3, directed, normalize).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_pagerank_shuffles_no_row_for_each_edge_and_query(spark, tmp_path):
    """A complete graph of 2 x 60 nodes for 50 queries: 180 000 products a round, but few rows leave a stage."""
    edges = spark.range(3600).selectExpr("concat('a', id % 60) as src", "concat('b', id div 60) as dst")
    seeds = spark.range(50).selectExpr("id as query_id", "concat('a', id) as node", "1.0D as weight")
    got = graph.pagerank(edges, seeds, 0.5, 2)
    assert got.count() == 50 * 120
    states = spark.read.parquet(got.inputFiles()[0])
    assert states.count() <= 120 and "scores" in states.columns


def test_spans_without_a_fold(spark):
    df = spark.sql("select 'Ann Lee of X' as text, array(named_struct('start', 0, 'end', 3, 'label', 'B-PER'), named_struct('start', 4, 'end', 7, 'label', 'I-PER'), named_struct('start', 11, 'end', 12, 'label', 'ORG')) as s")
    found = df.select(spans.merged(F.col("text"), F.col("s")).alias("m"))
    assert [tuple(x) for x in found.first().m] == [(0, 7, "PER"), (11, 12, "ORG")]
    assert "aggregate(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_names_are_put_in_order_once(spark):
    df = spark.sql("select 'Ann met Bob. Bob of York left.' as text, array('Bob', 'Ann', 'York') as names union all select 'Ann', array('Ann') union all select 'Ann', null union all select null, array('Ann')")
    found = df.select(spans.named_triples(F.col("text"), F.col("names")).alias("t"))
    assert [r.t if not r.t else [tuple(x) for x in r.t] for r in found.collect()] == [[("Ann", "met", "Bob"), ("Bob", "of", "York")], [], None, None]
    assert found._jdf.queryExecution().analyzed().toString().count("array_sort(") == 1
