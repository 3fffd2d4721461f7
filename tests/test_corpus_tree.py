"""Layouts that keep neighbours, two-stage clusters and the tree over a corpus."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import models
from quillon.operators import cluster, corpus_tree, layout


def table(spark, x):
    return spark.createDataFrame([(i * 7, [float(c) for c in v], 10) for i, v in enumerate(x)], "id long, vector array<double>, size int").repartition(3)


def grouped(n, groups, dim=12, noise=0.15, seed=1):
    rng = np.random.default_rng(seed)
    own = rng.integers(groups, size=n)
    return rng.standard_normal((groups, dim))[own] + noise * rng.standard_normal((n, dim)), own


def test_layout_keeps_more_neighbours_than_principal_components():
    rng = np.random.default_rng(0)
    t, h = rng.uniform(0, 4 * np.pi, 400), rng.uniform(0, 8, 400)
    roll = np.stack([t * np.cos(t) / 10, h / 10, t * np.sin(t) / 10, np.ones(400)], 1) @ rng.standard_normal((4, 30)) + 0.01 * rng.standard_normal((400, 30))
    for x in (roll, grouped(400, 30, 30, 0.3)[0]):
        y = layout.lay_out(x, 2, 15)
        linear = layout.preserved(x, cluster.principal(x, 2))
        assert layout.preserved(x, y) > linear + 0.15
        some = np.arange(0, 400, 2)
        placed = layout.place(x, x[some], layout.lay_out(x[some], 2, 15), 15)
        assert layout.preserved(x, placed) > linear + 0.05
        assert (layout.lay_out(x, 2, 15) == y).all()


def test_layout_of_few_and_equal_rows():
    assert layout.lay_out(np.ones((2, 5)), 3, 4).shape == (2, 3)
    for x in (np.ones((9, 4)), np.zeros((9, 4)), np.eye(3)):
        y = layout.lay_out(x, 2, 5)
        assert y.shape == (len(x), 2) and np.isfinite(y).all() and np.isfinite(layout.place(x, x, y, 3)).all()


def test_mixture_against_its_definition():
    x, own = grouped(200, 4, 5)
    m = corpus_tree.Mixture.start(x, 4)
    r, each = m.expect(x)
    dense = np.array([[w * np.prod(np.exp(-((v - mu) ** 2) / (2 * s)) / np.sqrt(2 * np.pi * s)) for w, mu, s in zip(m.weight, m.mean, m.var)] for v in x])
    assert np.allclose(each, np.log(dense.sum(1))) and np.allclose(r, dense / dense.sum(1, keepdims=True))
    found = corpus_tree.soft(x, 0.3)
    assert sorted(len(set(own[m])) for m in found) == [1] * len(found) and sum(map(len, found)) >= 200
    assert [len(m) for m in corpus_tree.members(np.array([[0.25] * 4, [0.1, 0.2, 0.35, 0.35]]), 0.3)] == [1, 0, 1, 1]


def plain_groups(spark, df, dim, threshold):
    """The first stage with everything in one place."""
    rows = df.select("id", "vector", F.xxhash64("id").alias("h")).orderBy("id").collect()
    x, n = np.array([list(r.vector) for r in rows]), len(rows)
    order = sorted(range(n), key=lambda i: (rows[i].h, rows[i].id))[: layout.LANDMARKS]
    marks, near = x[order], int((n - 1) ** 0.5)
    at = layout.lay_out(marks, min(dim, len(marks) - 2), near)
    z = layout.place(x, marks, at, max(2, near))
    starts = [corpus_tree.Mixture.start(at, k) for k in range(1, corpus_tree.MOST + 1)]
    best = corpus_tree.fit_all(starts, lambda fits: corpus_tree.moments(z, fits), n)
    return sorted(sorted(rows[i].id for i in m) for m in corpus_tree.members(best.expect(z)[0], threshold) if len(m))


@pytest.mark.parametrize("marks", [500, 100])
def test_both_stages_equal_a_plain_computation(spark, monkeypatch, marks):
    monkeypatch.setattr(layout, "LANDMARKS", marks)
    x, _ = grouped(240, 6)
    df = table(spark, x)
    by = {}
    for r in corpus_tree.global_groups(df, 5, 0.3).collect():
        by.setdefault(r.group, []).append(r.id)
    want = plain_groups(spark, df, 5, 0.3)
    assert sorted(map(sorted, by.values())) == want and len(want) > 1
    found = {}
    for r in corpus_tree.clusters(df, 5, 0.3, 10**9).collect():
        found.setdefault((r.group, r.cluster), []).append(r.id)
    plain = [sorted((np.array(rows)[m]).tolist()) for rows in want for m in corpus_tree.local(x[np.array(rows) // 7], 5, 0.3)]
    assert sorted(map(sorted, found.values())) == sorted(plain)


def test_large_groups_are_split_again(spark, monkeypatch):
    monkeypatch.setattr(corpus_tree, "LIMIT", 60)
    monkeypatch.setattr(corpus_tree, "GROUPS", 2)
    monkeypatch.setattr(layout, "LANDMARKS", 40)
    for x in (grouped(300, 8)[0], np.ones((150, 6))):
        rows = corpus_tree.global_groups(table(spark, x), 3, 0.3).collect()
        assert max(Counter(r.group for r in rows).values()) <= 60 and {r.id for r in rows} == {i * 7 for i in range(len(x))}


def test_long_clusters_are_cut(spark):
    x, _ = grouped(120, 3)
    rows = corpus_tree.clusters(table(spark, x), 5, 0.3, 150).collect()
    assert {r.id for r in rows} == {i * 7 for i in range(120)}
    assert np.median(list(Counter((r.group, r.cluster) for r in rows).values())) <= 15


def test_tree(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice([words[i % 4], words[i % 4 + 4]], 12)) + f" {i}" for i in range(90)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("vector", models.encode(F.col("text"))).repartition(2)
    tree = corpus_tree.grow(df, models.summarize, models.encode, dim=6)
    nodes = {r.id: r for r in tree.collect()}
    top = max(r.layer for r in nodes.values())
    assert top >= 1 and len(nodes) == tree.count()
    for layer in range(1, top + 1):
        own = [r for r in nodes.values() if r.layer == layer]
        below = {r.id for r in nodes.values() if r.layer == layer - 1}
        assert {c for r in own for c in r.children} == below and len(own) < len(below)
        for r in own:
            assert r.text == models.summarize([nodes[c].text for c in sorted(r.children)]) and np.allclose(r.vector, models.hashed_vector(r.text), atol=1e-6)
    assert any(r.layer == top and len(r.children) for r in nodes.values())
    assert sorted(r.id for r in corpus_tree.grow(df.limit(5), models.summarize, models.encode, dim=6).collect() if r.layer == 0) and corpus_tree.grow(df.limit(0), models.summarize, models.encode).count() == 0


def test_moments_of_mixtures_together_equal_each_alone():
    z, _ = grouped(150, 5, 4)
    fits = corpus_tree.mixtures(z, 6)
    for k, (m, got) in enumerate(zip(fits, corpus_tree.moments(z, fits), strict=True), 1):
        alone = corpus_tree.Mixture.start(z, k)
        assert np.array_equal(m.mean, alone.mean) and np.array_equal(m.weight, alone.weight)
        r, each = m.expect(z)
        for a, b in zip(got, (r.sum(0), r.T @ z, r.T @ (z * z), each.sum()), strict=True):
            assert np.allclose(a, b)


def test_groups_that_fit_a_task_need_few_jobs(spark, monkeypatch):
    x, _ = grouped(240, 6)
    df = table(spark, x)

    def found(group):
        spark.sparkContext.setJobGroup(group, group)
        by = {}
        for r in corpus_tree.global_groups(df, 5, 0.3).collect():
            by.setdefault(r.group, []).append(r.id)
        return sorted(map(sorted, by.values())), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    (one, few), _ = found("inside"), monkeypatch.setattr(corpus_tree, "FIT", 0)
    by_rounds, many = found("rounds")
    assert one == by_rounds and few < 10 < many


def test_groups_are_dealt_to_tasks(spark):
    x, _ = grouped(240, 6)
    assert corpus_tree.clusters(table(spark, x), 5, 0.3, 150).rdd.getNumPartitions() >= 8


def test_layout_takes_powers_once_a_pair(monkeypatch):
    sizes = []

    class Exponent(float):
        __array_ufunc__ = None

        def __rpow__(self, x):
            sizes.append(x.size)
            return x ** float(self)

    x = grouped(40, 4)[0]
    plain = layout.lay_out(x, 3, 6)
    monkeypatch.setattr(layout, "B", Exponent(layout.B))
    assert (layout.lay_out(x, 3, 6) == plain).all() and set(sizes) == {40 * 39 // 2}
