"""Clusters: centroids by document, mixtures chosen by BIC, and trees of summaries."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import vectors as V
from quillon.operators import vector_search
from quillon.session import written


def spread(x: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Up to k different rows, a seeded one and then the one farthest from all before it; fewer are the first of more."""
    k = min(k, len(np.unique(x, axis=0)))
    at = [np.random.default_rng(seed).integers(len(x))]
    gap = np.full(len(x), np.inf)
    while len(at) < k:
        gap = np.minimum(gap, ((x - x[at[-1]]) ** 2).sum(1))
        at.append(gap.argmax())
    return x[at]


def kmeans(x: np.ndarray, k: int, seed: int = 0, rounds: int = 50, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's algorithm from a seeded, spread-out start (the first k rows of start, see spread); centres and the centre of each row."""
    centers = spread(x, k, seed) if start is None else start[:k]
    own = None
    for _ in range(rounds):
        now = ((x[:, None] - centers[None]) ** 2).sum(2).argmin(1)
        if own is not None and (now == own).all():
            break
        own = now
        centers = np.stack([x[own == j].mean(0) if (own == j).any() else centers[j] for j in range(len(centers))])
    return centers, own


def document_centroids(chunks: DataFrame, most: int = 5, seed: int = 0) -> DataFrame:
    """(doc_id, centroid_no, n, centroid) from chunks (doc_id, vector); at most most centroids a document. A document's chunks are one group."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.array(rows["vector"].tolist(), float)
        centers, own = kmeans(x, min(most, len(x)), seed)
        return pd.DataFrame({"doc_id": rows["doc_id"].iloc[0], "centroid_no": range(len(centers)), "n": np.bincount(own, minlength=len(centers)), "centroid": list(centers)})

    return chunks.select("doc_id", "vector").groupBy("doc_id").applyInPandas(run, "doc_id long, centroid_no int, n long, centroid array<double>")


def principal(x: np.ndarray, dim: int) -> np.ndarray:
    """The leading principal coordinates; stands in for a neighbour-preserving reduction."""
    x = x - x.mean(0)
    dim = min(dim, len(x), x.shape[1])
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    return u[:, :dim] * s[:dim]


def mixture(x: np.ndarray, k: int, seed: int = 0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """A diagonal Gaussian mixture: responsibilities and BIC."""
    n, d = x.shape
    centers, own = kmeans(x, k, seed)
    k = len(centers)
    r = np.eye(k)[own]
    low = 1e-6 + 1e-3 * x.var(0)
    total = -np.inf
    for _ in range(rounds):
        w = r.sum(0) + 1e-9
        mu = r.T @ x / w[:, None]
        var = r.T @ (x * x) / w[:, None] - mu**2 + low
        logs = -0.5 * ((((x[:, None] - mu[None]) ** 2) / var[None]).sum(2) + np.log(var).sum(1) + d * np.log(2 * np.pi)) + np.log(w / n)
        top = logs.max(1, keepdims=True)
        each = top[:, 0] + np.log(np.exp(logs - top).sum(1))
        r = np.exp(logs - each[:, None])
        if each.sum() - total < 1e-6 * abs(each.sum()):
            break
        total = each.sum()
    return r, -2 * each.sum() + (2 * k * d + k - 1) * np.log(n)


def soft_clusters(x: np.ndarray, threshold: float = 0.3, most: int = 50, dim: int = 10, seed: int = 0) -> list[np.ndarray]:
    """Members of each cluster, some of several: the mixture with the least BIC, memberships over threshold."""
    if len(x) <= 2:
        return [np.arange(len(x))]
    z = principal(x, min(dim, len(x) - 2))
    fits = [mixture(z, k, seed) for k in range(1, min(10, most, len(x) - 1) + 1)]
    r = min(fits, key=lambda f: f[1])[0]
    return [m for j in range(r.shape[1]) if len(m := np.flatnonzero(r[:, j] > threshold))]


def cluster_groups(vectors: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(group, id, cluster) for vectors (group, id, vector): a mixture for each group."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        found = soft_clusters(np.array(rows["vector"].tolist(), float), threshold)
        return pd.DataFrame([(rows["group"].iloc[0], rows["id"].iloc[i], c) for c, members in enumerate(found) for i in members], columns=["group", "id", "cluster"])

    return vectors.groupBy("group").applyInPandas(run, "group long, id long, cluster int")


def _split(x: np.ndarray, sizes: np.ndarray, most: int, depth: int) -> list[np.ndarray]:
    """Clusters, those whose texts are too long together cut again, at most depth times."""
    out = []
    for members in soft_clusters(x):
        if len(members) > 1 and sizes[members].sum() > most and depth > 0 and len(members) < len(x):
            out += [members[m] for m in _split(x[members], sizes[members], most, depth - 1)]
        else:
            out.append(members)
    return out


def build_tree(leaves: DataFrame, summarize: Callable[[list[str]], str], embed: Callable[[str], list[float]], layers: int = 5, stop: int = 11, most: int = 4000) -> DataFrame:
    """(group, id, layer, text, vector, children) from leaves (group, id, text, vector).

    Each group (a document, or a collection that fits a task) grows its own tree: nodes of a layer are clustered and each
    cluster is summarised into a node above, until a layer has at most stop nodes or layers are built. Groups of at most
    stop leaves have no other nodes and pass no Python; leaves are written once.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        nodes = [(rows["group"].iloc[0], i, 0, t, list(v), []) for i, t, v in zip(rows["id"], rows["text"], rows["vector"], strict=True)]
        now, top = list(nodes), max(n[1] for n in nodes)
        for layer in range(1, layers + 1):
            if len(now) <= stop:
                break
            x, sizes = np.array([n[4] for n in now], float), np.array([len(n[3].split()) for n in now])
            above = []
            for members in _split(x, sizes, most, 5):
                top += 1
                text = summarize([now[m][3].replace("\n", " ") for m in members])
                above.append((now[0][0], top, layer, text, embed(text), [now[m][1] for m in members]))
            nodes += above
            if len(above) >= len(now):
                break
            now = above
        return pd.DataFrame(nodes, columns=["group", "id", "layer", "text", "vector", "children"])

    kept = written(leaves.select("group", "id", "text", F.col("vector").cast("array<double>").alias("vector")), "leaves")
    large = kept.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > stop).select(F.col("group").alias("g"))
    same = F.col("group").eqNullSafe(F.col("g"))
    alone = kept.join(large, same, "left_anti").select("group", "id", F.lit(0).alias("layer"), "text", "vector", F.array().cast("array<long>").alias("children"))
    grown = kept.join(large, same, "left_semi").groupBy("group").applyInPandas(run, "group long, id long, layer int, text string, vector array<double>, children array<long>")
    return grown.unionByName(alone)


def collapsed(tree: DataFrame, queries: DataFrame, k: int, budget: int = 3500) -> DataFrame:
    """All nodes of all layers, the nearest first, while their words fit the budget."""
    from quillon.operators import fusion

    found = vector_search.top_k(tree.select("id", "vector"), queries, k).join(tree.select("id", "layer", "text"), "id").withColumn("size", F.size(F.split("text", r"\s+"))).drop("text")
    return fusion.token_prefix(found, "size", budget)


def traverse(tree: DataFrame, queries: DataFrame, k: int, layers: int) -> DataFrame:
    """(query_id, id, layer): the k nearest of the top layers of all groups, then of their children, down to the leaves.

    Only top nodes meet all queries, of which the k best of each are moved; below, a query meets the children of its own.
    """
    from quillon.operators import fusion

    tops = tree.groupBy("group").agg(F.max("layer").alias("top"))
    first = tree.select("group", "id", "layer", "vector").join(tops, "group").where(F.col("layer") == F.col("top")).select("id", "vector")
    now = vector_search.top_k(first, queries, k).select("query_id", "id", "score")
    asked = queries.select(F.col("id").alias("query_id"), F.col("vector").alias("asked"))
    out = None
    for i in range(layers):
        best = written(fusion.ranking(now, "id", k).select("query_id", "id").join(tree.select("id", "layer", "children"), "id"), "best")
        out = best.select("query_id", "id", "layer") if out is None else out.unionByName(best.select("query_id", "id", "layer"))
        if i + 1 < layers:
            below = best.select("query_id", F.explode("children").alias("id")).distinct()
            now = below.join(tree.select("id", "vector"), "id").join(asked, "query_id").select("query_id", "id", V.cosine(F.col("vector"), F.col("asked")).alias("score"))
    return out


def leaf_chunks(found: DataFrame, leaves: DataFrame) -> DataFrame:
    """Found nodes that are leaves; a query that found none gets one made-up chunk with a stable id."""
    real = found.join(leaves.select("id"), "id", "left_semi").select("query_id", "id")
    none = found.select("query_id").distinct().join(real.select("query_id").distinct(), "query_id", "left_anti")
    return real.unionByName(none.select("query_id", F.xxhash64("query_id").alias("id")))
