"""One tree of summaries over a whole corpus: each level is clustered in two stages, the first of which is distributed."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import layout
from quillon.operators.cluster import kmeans, spread
from quillon.operators.vector_search import _matrix
from quillon.session import forget, written

#: A group of more rows is split again before it is clustered in one task.
LIMIT = 5000
#: A group of up to so many rows is split in one task until none has more than LIMIT; larger ones are split by all tasks.
FIT = 50000
#: So many groups at most are split at a time, which bounds what is broadcast.
GROUPS = 64
#: The groups are dealt to so many tasks each, so that few tasks have two, and to TASKS at most.
SPREAD, TASKS = 4, 4000
#: Most components of a mixture, and rounds of its fit over all rows.
MOST, ROUNDS = 10, 12


class Mixture:
    """A diagonal Gaussian mixture: weights, means and variances of its components, and the least variance."""

    def __init__(self, weight: np.ndarray, mean: np.ndarray, var: np.ndarray, low: np.ndarray):
        self.weight, self.mean, self.var, self.low = weight, mean, var, low

    @classmethod
    def start(cls, z: np.ndarray, k: int, seed: int = 0, start: np.ndarray | None = None) -> Mixture:
        """Components from the clusters of k-means."""
        centers, own = kmeans(z, k, seed, start=start)
        low = 1e-6 + 1e-3 * z.var(0)
        r = np.eye(len(centers))[own]
        return cls.of_sums(r.sum(0), r.T @ z, r.T @ (z * z), low)

    @classmethod
    def of_sums(cls, n: np.ndarray, first: np.ndarray, second: np.ndarray, low: np.ndarray) -> Mixture:
        n = n + 1e-9
        mean = first / n[:, None]
        return cls(n / n.sum(), mean, np.maximum(second / n[:, None] - mean**2, 0) + low, low)

    def expect(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far each row belongs to each component, and its log likelihood."""
        logs = np.log(self.weight) - 0.5 * (np.log(self.var).sum(1) + z.shape[1] * np.log(2 * np.pi))
        logs = logs - 0.5 * ((z * z) @ (1 / self.var).T - 2 * z @ (self.mean / self.var).T + (self.mean**2 / self.var).sum(1))
        top = logs.max(1, keepdims=True)
        each = top[:, 0] + np.log(np.exp(logs - top).sum(1))
        return np.exp(logs - each[:, None]), each

    def bic(self, likelihood: float, n: int) -> float:
        k, d = self.mean.shape
        return -2 * likelihood + (2 * k * d + k - 1) * np.log(n)


def mixtures(z: np.ndarray, most: int) -> list[Mixture]:
    """Mixtures of 1 to most components to start from; their k-means share one spread-out start."""
    start = spread(z, most)
    return [Mixture.start(z, k, start=start) for k in range(1, most + 1)]


def fit_all(starts: list[Mixture], sums: Callable[[list[Mixture]], list[tuple]], n: int, rounds: int = ROUNDS) -> Mixture:
    """The mixture of least BIC after rounds of expectation and maximisation; sums gives n, first and second moments and likelihood."""
    now = starts
    for _ in range(rounds):
        found = sums(now)
        now = [Mixture.of_sums(*s[:3], m.low) for m, s in zip(now, found, strict=True)]
    found = sums(now)
    return min(zip(now, found, strict=True), key=lambda x: x[0].bic(x[1][3], n))[0]


def moments(z: np.ndarray, fits: list[Mixture]) -> list[tuple]:
    """n, first and second moments and log likelihood of each mixture; the components of all are computed together."""
    sizes = [len(m.weight) for m in fits]
    at = np.cumsum([0, *sizes])
    weight, mean, var = np.concatenate([m.weight for m in fits]), np.concatenate([m.mean for m in fits]), np.concatenate([m.var for m in fits])
    square = z * z
    logs = (1 / var) @ square.T - 2 * (mean / var) @ z.T
    logs += (mean**2 / var + np.log(var)).sum(1)[:, None] + z.shape[1] * np.log(2 * np.pi)
    logs *= -0.5
    logs += np.log(weight)[:, None]
    top = np.maximum.reduceat(logs, at[:-1])
    logs -= np.repeat(top, sizes, axis=0)
    r = np.exp(logs, out=logs)
    total = np.add.reduceat(r, at[:-1])
    r /= np.repeat(total, sizes, axis=0)
    like, n, first, second = (top + np.log(total)).sum(1), r.sum(1), r @ z, r @ square
    return [(n[a:b], first[a:b], second[a:b], float(x)) for a, b, x in zip(at[:-1], at[1:], like, strict=True)]


def members(r: np.ndarray, threshold: float) -> list[np.ndarray]:
    """Rows of each component: those over threshold, and a row that is nowhere over it where it belongs most."""
    on = r > threshold
    on[np.arange(len(r)), r.argmax(1)] |= ~on.any(1)
    return [np.flatnonzero(c) for c in on.T]


def soft(z: np.ndarray, threshold: float) -> list[np.ndarray]:
    """Clusters of rows that fit a task: the best mixture of 1 to MOST components."""
    if len(z) <= 2:
        return [np.arange(len(z))]
    some = z[np.linspace(0, len(z) - 1, min(len(z), layout.LANDMARKS)).astype(int)]
    starts = mixtures(some, min(MOST, len(some) - 1))
    return [m for m in members(fit_all(starts, lambda f: moments(z, f), len(z)).expect(z)[0], threshold) if len(m)]


def reduced(x: np.ndarray, dim: int, neighbours: int) -> np.ndarray:
    """Coordinates of rows that fit a task: up to LANDMARKS of them, evenly spaced, are laid out, and all take their places."""
    if len(x) <= 2:
        return x[:, :dim]
    marks = x[np.linspace(0, len(x) - 1, min(len(x), layout.LANDMARKS)).astype(int)]
    at = layout.lay_out(marks, min(dim, len(marks) - 2) or 1, neighbours)
    return at if len(marks) == len(x) else layout.place(x, marks, at, neighbours)


def local(x: np.ndarray, dim: int, threshold: float) -> list[np.ndarray]:
    """The second stage, inside one group: a mixture of its own; up to dim + 1 rows are one cluster."""
    return [np.arange(len(x))] if len(x) <= dim + 1 else soft(reduced(x, dim, 10), threshold)


def two_stages(x: np.ndarray, dim: int, threshold: float) -> list[np.ndarray]:
    """Both stages for rows that fit a task."""
    first = soft(reduced(x, dim, max(2, int((len(x) - 1) ** 0.5))), threshold) if len(x) > 2 else [np.arange(len(x))]
    return [rows[m] for rows in first for m in local(x[rows], dim, threshold)]


def within(x: np.ndarray, sizes: np.ndarray, clusters: list[np.ndarray], dim: int, threshold: float, most: int, depth: int) -> list[np.ndarray]:
    """clusters, those whose texts are longer than most together cut again by both stages, at most depth times."""
    out = []
    for rows in clusters:
        if len(rows) > 1 and sizes[rows].sum() > most and depth > 0:
            out += [rows[m] for m in within(x[rows], sizes[rows], two_stages(x[rows], dim, threshold), dim, threshold, most, depth - 1)]
        else:
            out.append(rows)
    return out


def global_groups(nodes: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(group, id) for nodes (id, vector): the first stage, over all rows.

    Up to LANDMARKS nodes, drawn by a hash of the id, are laid out and broadcast; every node takes its place among them
    in its own task. Mixtures of 1 to MOST components start from the landmarks and are fitted to all nodes by rounds that
    shuffle only sums; the one of least BIC counts. Groups of more than LIMIT nodes are split again alike, GROUPS at a
    time, and those of up to FIT nodes by one task each, which needs no rounds of jobs. A node may be in several groups, and is in one at least.
    """
    start = nodes.select(F.lit(0).cast("long").alias("group"), "id", "vector")
    sizes, done, first, fresh = {0: start.count()}, [], True, 1
    now = start
    while True:
        big = [g for g, n in sizes.items() if first or n > LIMIT]
        if not big:
            return _all([*done, now.select("group", "id")])
        done.append(now.where(~F.col("group").isin(big)).select("group", "id"))
        if small := [g for g in big if sizes[g] <= FIT]:
            done.append(_split_inside(now.where(F.col("group").isin(small)), len(small), dim, threshold, first))
            if len(small) == len(big):
                return _all(done)
            big = [g for g in big if sizes[g] > FIT]
        parts = []
        for s in range(0, len(big), GROUPS):
            own = {g: sizes[g] for g in big[s : s + GROUPS]}
            split, fresh = _split(now.where(F.col("group").isin(list(own))), own, dim, threshold, fresh)
            parts.append(split)
        now = written(_all(parts), "groups")
        before, sizes = max(sizes.values()), _sizes(now)
        if not first and max(sizes.values(), default=0) > 0.9 * before:  # its vectors are all but equal: any cut will do
            for g, n in list(sizes.items()):
                if n > LIMIT:
                    now = now.withColumn("group", F.when(F.col("group") == g, fresh + F.pmod(F.xxhash64("id"), F.lit(-(-n * 2 // LIMIT)))).otherwise(F.col("group")))
                    fresh += -(-n * 2 // LIMIT)
            sizes = _sizes(now)
        first = False


def _sizes(groups: DataFrame) -> dict[int, int]:
    return {r.group: r.n for r in groups.groupBy("group").agg(F.count(F.lit(1)).alias("n")).collect()}


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def first_stage(x: np.ndarray, h: np.ndarray, dim: int, threshold: float, landmarks: int) -> list[np.ndarray]:
    """The split of one group whose rows, in order of their hashes h, fit a task: the same as _split."""
    n, near = len(x), int((len(x) - 1) ** 0.5)
    marks = np.flatnonzero(h % (1 << 30) < min(1.0, 2 * landmarks / n) * (1 << 30))[:landmarks]
    at = layout.lay_out(x[marks], max(1, min(dim, len(marks) - 2)), near)
    z = layout.place(x, x[marks], at, max(2, near))
    parts = [z[s : s + 2048] for s in range(0, n, 2048)]

    def sums(fits: list[Mixture]) -> list[tuple]:
        total = moments(parts[0], fits)
        for p in parts[1:]:
            total = [tuple(a + b for a, b in zip(t, m, strict=True)) for t, m in zip(total, moments(p, fits), strict=True)]
        return total

    best = fit_all(mixtures(at, min(MOST, len(at) - 1) if len(at) > 2 else 1), sums, n)
    return [m for m in members(best.expect(z)[0], threshold) if len(m)]


def _split_inside(rows: DataFrame, n: int, dim: int, threshold: float, first: bool) -> DataFrame:
    """(group, id) for rows (group, id, vector) of n groups of up to FIT rows: each is split in its task until none has more than LIMIT."""
    limit, landmarks = LIMIT, layout.LANDMARKS

    def run(own: pa.Table) -> pa.Table:
        order = np.lexsort((own["id"].to_numpy(), own["h"].to_numpy()))
        ids, h, x = own["id"].to_numpy()[order], own["h"].to_numpy()[order], _matrix(own["vector"])[order]
        todo, done, again = [np.arange(len(ids))], [], not first
        while todo:
            now = todo.pop()
            for m in first_stage(x[now], h[now], dim, threshold, landmarks):
                if len(m) <= limit:
                    done.append(now[m])
                elif again and len(m) > 0.9 * len(now):  # its vectors are all but equal: any cut will do
                    k = -(-len(m) * 2 // limit)
                    for part in (now[m[h[now[m]] % k == j]] for j in range(k)):
                        if len(part):
                            (done if len(part) <= limit else todo).append(part)
                else:
                    todo.append(now[m])
            again = True
        numbers = (1 << 40) + (own["group"][0].as_py() << 20) + np.repeat(np.arange(len(done)), [len(d) for d in done])
        return pa.table([pa.array(numbers, pa.int64()), pa.array(ids[np.concatenate(done)], pa.int64())], ["group", "id"])

    return rows.select("group", "id", F.xxhash64("id").alias("h"), "vector").repartition(min(TASKS, SPREAD * n), "group").groupBy("group").applyInArrow(run, "group long, id long")


def _split(rows: DataFrame, sizes: dict[int, int], dim: int, threshold: float, fresh: int) -> tuple[DataFrame, int]:
    """rows (group, id, vector) in new groups, numbered from fresh, and the next number."""
    spark = rows.sparkSession
    share = F.broadcast(spark.createDataFrame([(g, min(1.0, 2 * layout.LANDMARKS / n)) for g, n in sizes.items()], "group long, share double"))
    drawn = rows.join(share, "group").where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("group", F.xxhash64("id").alias("h"), "id", "vector")

    def marks(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["h", "id"]).head(layout.LANDMARKS)
        x, n = np.array(own["vector"].tolist(), float), sizes[int(own["group"].iloc[0])]
        at = layout.lay_out(x, max(1, min(dim, len(x) - 2)), int((n - 1) ** 0.5))
        return pd.DataFrame({"group": own["group"], "x": list(x), "z": list(at)})

    found = drawn.groupBy("group").applyInPandas(marks, "group long, x array<double>, z array<double>").collect()
    places = {g: tuple(np.array([list(r[c]) for r in found if r.group == g]) for c in ("x", "z")) for g in {r.group for r in found}}
    near = {g: max(2, int((sizes[g] - 1) ** 0.5)) for g in places}
    sent = spark.sparkContext.broadcast(places)

    def locate(batches):
        for batch in batches:
            groups, x = batch.column(0).to_numpy(), _matrix(batch.column(2)) if batch.num_rows else None
            for g in np.unique(groups).tolist():
                own = np.flatnonzero(groups == g)
                z = layout.place(x[own], *sent.value[g], near[g])
                columns = [c.take(pa.array(own)) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(z.tolist(), pa.list_(pa.float64()))], ["group", "id", "vector", "z"])

    kind = rows.schema["vector"].dataType.simpleString()
    placed = written(rows.mapInArrow(locate, f"group long, id long, vector {kind}, z array<double>"), "places")
    starts = {g: mixtures(z, min(MOST, len(z) - 1) if len(z) > 2 else 1) for g, (_, z) in places.items()}

    def sums(fits: dict[int, list[Mixture]]) -> dict[int, list[tuple]]:
        shared = spark.sparkContext.broadcast(fits)

        def run(batches):
            total: dict[int, list] = {}
            for batch in batches:
                groups = batch.column(0).to_numpy()
                for g in np.unique(groups).tolist():
                    z = _matrix(batch.column(1).take(pa.array(np.flatnonzero(groups == g))))
                    now = moments(z, shared.value[g])
                    total[g] = [tuple(a + b for a, b in zip(p, q, strict=True)) for p, q in zip(total[g], now, strict=True)] if g in total else now
            rows = [(g, i, j, float(n[j]), first[j].tolist(), second[j].tolist(), like if j == 0 else 0.0) for g, each in total.items() for i, (n, first, second, like) in enumerate(each) for j in range(len(n))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()), strict=True)], ["group", "i", "j", "n", "first", "second", "like"])

        part = placed.select("group", "z").mapInArrow(run, "group long, i int, j int, n double, first array<double>, second array<double>, like double")
        d = max(z.shape[1] for _, z in places.values())
        total = [F.sum("n").alias("n"), F.sum("like").alias("like"), *[F.sum(F.get(c, F.lit(t))).alias(f"{c}{t}") for c in ("first", "second") for t in range(d)]]
        out = {g: [(np.zeros(len(m.weight)), np.zeros(m.mean.shape), np.zeros(m.mean.shape), [0.0]) for m in each] for g, each in fits.items()}
        for r in part.groupBy("group", "i", "j").agg(*total).collect():
            n, first, second, like = out[r.group][r.i]
            n[r.j], like[0] = r.n, like[0] + r.like
            first[r.j], second[r.j] = ([r[f"{c}{t}"] for t in range(first.shape[1])] for c in ("first", "second"))
        return {g: [(n, first, second, like[0]) for n, first, second, like in each] for g, each in out.items()}

    now = starts
    for _ in range(ROUNDS):
        found = sums(now)
        now = {g: [Mixture.of_sums(*s[:3], m.low) for m, s in zip(each, found[g], strict=True)] for g, each in now.items()}
    found = sums(now)
    best = {g: min(zip(each, found[g], strict=True), key=lambda x: x[0].bic(x[1][3], sizes[g]))[0] for g, each in now.items()}
    numbers = {}
    for g in sorted(best):
        numbers[g] = fresh
        fresh += len(best[g].weight)
    chosen = spark.sparkContext.broadcast((best, numbers))

    def deal(batches):
        fits, first = chosen.value
        for batch in batches:
            groups = batch.column(0).to_numpy()
            for g in np.unique(groups).tolist():
                own = np.flatnonzero(groups == g)
                z = _matrix(batch.column(3).take(pa.array(own)))
                for j, rows in enumerate(members(fits[g].expect(z)[0], threshold)):
                    at = pa.array(own[rows])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), first[g] + j, np.int64)), batch.column(1).take(at), batch.column(2).take(at)], ["group", "id", "vector"])

    return placed.mapInArrow(deal, f"group long, id long, vector {kind}"), fresh


def clusters(nodes: DataFrame, dim: int, threshold: float, most: int, depth: int = 5) -> DataFrame:
    """(group, cluster, id) for nodes (id, vector, size): groups over all nodes, then mixtures inside each group.

    A group is at most LIMIT nodes and is clustered in one task; a cluster whose sizes add up to more than most is cut
    again there, depth times. Memberships of both stages multiply: a node is in each cluster of each of its groups that
    it belongs to.
    """
    groups = written(global_groups(nodes, dim, threshold), "grouped")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        x, sizes, ids = np.array(rows["vector"].tolist(), float), rows["size"].to_numpy(), rows["id"].to_numpy()
        found = within(x, sizes, local(x, dim, threshold), dim, threshold, most, depth)
        return pd.DataFrame({"group": rows["group"].iloc[0], "cluster": np.repeat(np.arange(len(found)), [len(m) for m in found]), "id": ids[np.concatenate(found)]})

    # a group's rows are few bytes and much work: without a number of its own, the exchange would be made into few tasks
    tasks = min(TASKS, SPREAD * groups.select("group").distinct().count()) or 1
    return groups.join(nodes, "id").select("group", "id", "vector", "size").repartition(tasks, "group").groupBy("group").applyInPandas(run, "group long, cluster int, id long")


def grow(leaves: DataFrame, summarize: Callable[[list[str]], str], encode: Callable[[Column], Column], dim: int = 50, layers: int = 5, threshold: float = 0.3, most: int = 4000) -> DataFrame:
    """(id, layer, text, vector, children) of one tree over all leaves (id, text, vector).

    A layer's nodes are clustered (see clusters) and each cluster summarised into a node above, until a layer has no more
    than dim + 1 nodes or layers are built; a layer that would not be smaller than the one below ends the tree. Ids of
    the nodes above are hashes of layer and cluster. Each layer is written to the shared folder. No task has all leaves:
    the first stage streams them, the second has up to LIMIT. No leaves give no tree.
    """
    summary = F.pandas_udf(lambda texts: texts.map(lambda t: summarize([x.replace("\n", " ") for x in t])), "string")
    none = F.array().cast("array<long>")
    now = written(leaves.select(F.col("id").cast("long").alias("id"), F.lit(0).alias("layer"), "text", F.col("vector").cast("array<double>").alias("vector"), none.alias("children")), "layer0")
    out, n = now, now.count()
    for layer in range(1, layers + 1):
        if n <= dim + 1:
            break
        sized = now.select("id", "vector", F.size(F.split(F.trim("text"), r"\s+")).alias("size"))
        met = clusters(sized, dim, threshold, most).join(now.select("id", "text"), "id")
        each = met.groupBy("group", "cluster").agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("c"))
        told = each.select(F.xxhash64(F.lit(layer), "group", "cluster").alias("id"), F.lit(layer).alias("layer"), summary(F.col("c.text")).alias("text"), F.col("c.id").alias("children"))
        above = written(told.withColumn("vector", encode(F.col("text")).cast("array<double>")).select(*now.columns), f"layer{layer}")
        count = above.count()
        if count >= n:
            forget(above)
            break
        out, now, n = out.unionByName(above), above, count
    return out
