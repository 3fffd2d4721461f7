"""Nearest vectors. Few queries are broadcast and all vectors stream past them; many meet the vectors block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: So many queries at most are broadcast.
BLOCK = 4096
#: So many queries at most meet in one task, fewer (ASKED_LEAST at least) where a cell would have under TASKS tasks.
ASKED, ASKED_LEAST, TASKS = 32768, 1024, 96
#: So many vectors meet a block of queries in one task: what is shuffled is k rows a query for each of these parts.
PART = 131072
#: Queries and vectors that are scored at a time, which bounds the matrix of scores.
SLICE, STRIP = 256, 4096
#: Scores at most of a matrix that is taken whole.
MATRIX = 1 << 24
#: From so many pairs on, blocks get exchanges of their own size: few bytes and much work would be made into few tasks.
PAIRS = 1 << 26
FOUND = "query_id long, id long, score double"


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if n and len(flat) % n == 0 and not column.null_count and (np.diff(column.offsets.to_numpy()) == len(flat) // n).all():
        return flat.reshape(n, -1)
    return np.array(column.to_pylist(), np.float64)


def _scores(metric: str, x: np.ndarray, q: np.ndarray, epsilon: float) -> np.ndarray:
    if metric == "dot":
        return x @ q.T
    if metric == "cosine":
        return x @ q.T / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None, :] + epsilon)
    out = np.empty((len(x), len(q)))
    for j, one in enumerate(q):
        gaps = np.abs(x - one)
        out[:, j] = {"L1": lambda g: g.sum(1), "L2": lambda g: np.sqrt((g * g).sum(1)), "Linf": lambda g: g.max(1)}[metric](gaps)
    return -out


def _best(own: np.ndarray, x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int | None, metric: str, least: float | None, epsilon: float) -> list[np.ndarray]:
    """query_id, id and score of the k best of these vectors for each of these queries."""
    if k is not None and len(own) > k:
        if (np.diff(own) < 0).any():
            order = np.argsort(own, kind="stable")
            own, x = own[order], x[order]
        if np.isfinite(x).all() and np.isfinite(q).all():
            return _leading(own, x, ids, q, k, metric, least, epsilon)
    s = _scores(metric, x, q, epsilon)
    at = np.argsort(-s, axis=0, kind="stable")[:k] if k is not None and len(own) > k else np.broadcast_to(np.arange(len(own))[:, None], s.shape)
    col = np.broadcast_to(np.arange(s.shape[1])[None, :], at.shape)
    score = s[at, col]
    on = np.ones(score.shape, bool) if least is None else score >= least
    return [ids[col[on]], own[at[on]], score[on]]


def _leading(own: np.ndarray, x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, metric: str, least: float | None, epsilon: float) -> list[np.ndarray]:
    """_best for finite vectors in order of their ids, a strip of them at a time.

    Only scores over a query's k-th best so far are looked at; one that equals it has a higher id and comes after it.
    """
    out: list[list[np.ndarray]] = [[], [], []]
    for a in range(0, len(ids), SLICE):
        some = q[a : a + SLICE]
        n = len(some)
        over = np.full(n, -np.inf if least is None else np.nextafter(least, -np.inf))
        col, at, score, fresh = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0
        for b in range(0, len(own), STRIP):
            s = np.ascontiguousarray(_scores(metric, x[b : b + STRIP], some, epsilon).T)
            if b == 0 and s.shape[1] >= k:  # the k-th best of the first strip and what equals it stay
                over = np.maximum(over, np.nextafter(np.partition(s, -k, axis=1)[:, -k], -np.inf))
            hit = np.flatnonzero(s > over[:, None])
            if not len(hit):
                continue
            row, place = np.divmod(hit, s.shape[1])
            col, at, score, fresh = np.concatenate((col, row)), np.concatenate((at, place + b)), np.concatenate((score, s.ravel()[hit])), fresh + len(hit)
            if fresh > n * k // 4 or b + STRIP >= len(own):
                col, at, score, over = _kept(col, at, score, k, over)
                fresh = 0
        if fresh:
            col, at, score, over = _kept(col, at, score, k, over)
        for o, c in zip(out, (ids[a + col], own[at], score), strict=True):
            o.append(c)
    return [np.concatenate(o) for o in out] if len(ids) else [ids[:0], own[:0], np.zeros(0)]


def _kept(col: np.ndarray, at: np.ndarray, score: np.ndarray, k: int, over: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query (col), the first of equals, and the scores that further ones must be over."""
    order = np.lexsort((at, -score, col))
    col, at, score = col[order], at[order], score[order]
    first = np.searchsorted(col, np.arange(len(over) + 1))
    on = np.arange(len(col)) - first[col] < k
    full = np.diff(first) >= k
    over = over.copy()
    over[full] = score[first[:-1][full] + k - 1]
    return col[on], at[on], score[on], over


def top_k(items: DataFrame, queries: DataFrame, k: int | None, metric: str = "cosine", least: float | None = None, epsilon: float = 1e-9) -> DataFrame:
    """(query_id, id, score, rank) for items and queries (id, vector): the k best of each query, at least least; ties by id.

    metric is cosine, dot, or a distance L1, L2 or Linf (its score is negative). Each batch keeps its own k best of each
    query, so what is shuffled is k rows a query and batch. Up to BLOCK queries are broadcast; more never pass the driver,
    see blocked. Without k, all pairs that reach least.
    """
    item, query = items.columns[:2], queries.columns[:2]
    items, queries = items.select(F.col(item[0]).cast("long").alias("id"), F.col(item[1]).alias("vector")), queries.select(F.col(query[0]).cast("long").alias("id"), F.col(query[1]).alias("vector"))
    few = queries.limit(BLOCK + 1).collect()
    if not few:
        return items.sparkSession.createDataFrame([], f"{FOUND}, rank int")
    if len(few) <= BLOCK:
        out = _streamed(items, few, k, metric, least, epsilon)
    else:
        one = F.lit(0).alias("cell")
        out = blocked(items.select("*", one), queries.select("*", one), k, metric, least, epsilon)
    return ranked(out, k)


def ranked(found: DataFrame, k: int | None) -> DataFrame:
    out = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return out if k is None else out.where(F.col("rank") <= k)


def _streamed(items: DataFrame, block: list, k: int | None, metric: str, least: float | None, epsilon: float) -> DataFrame:
    shared = items.sparkSession.sparkContext.broadcast((np.array([b[0] for b in block], np.int64), np.array([list(b[1]) for b in block], np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        for batch in batches:
            if batch.num_rows:
                found = _best(batch.column(0).to_numpy(), _matrix(batch.column(1)), ids, q, k, metric, least, epsilon)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "id", "score"])

    return items.mapInArrow(run, FOUND)


def blocked(items: DataFrame, queries: DataFrame, k: int | None, metric: str = "cosine", least: float | None = None, epsilon: float = 1e-9) -> DataFrame:
    """(query_id, id, score): the k best of each part for queries and items (id, vector, cell) that share a cell.

    Both sides stay distributed. A cell's items are dealt by id into parts of about PART rows (without k, BLOCK), its
    queries into blocks of up to ASKED; each part meets each block in a task of its own, so no task grows with a cell. The plan has the same size
    whatever the number of queries. Cells must be few enough to be counted on the driver.
    """
    cells = {r.cell: [r.n, 0] for r in items.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    for r in queries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():
        cells.setdefault(r.cell, [0, 0])[1] = r.n
    spark = items.sparkSession

    def dealt_to(n: int, m: int) -> tuple[int, int]:
        parts = -(-n // (BLOCK if k is None else PART))
        most = BLOCK if k is None else ASKED
        return parts, max(-(-m // most), min(-(-TASKS // (parts * len(cells))), -(-m // ASKED_LEAST)))

    both = [(c, *dealt_to(n, m)) for c, (n, m) in cells.items() if n and m] or [(None, 1, 1)]
    sizes = F.broadcast(spark.createDataFrame(both, "cell int, parts int, blocks int"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    left = items.join(sizes, "cell").select("cell", dealt("parts").alias("part"), upto("blocks").alias("block"), "id", "vector")
    right = queries.join(sizes, "cell").select("cell", upto("parts").alias("part"), dealt("blocks").alias("block"), "id", "vector")

    def meet(own: pa.Table, asked: pa.Table) -> pa.Table:
        found = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if own.num_rows and asked.num_rows:
            ids, x = own["id"].to_numpy(), _matrix(own["vector"])
            q_ids, q = asked["id"].to_numpy(), _matrix(asked["vector"])
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            step = max(1, min(BLOCK, MATRIX // len(ids)))
            for s in range(0, len(q_ids), step):
                for c, part in zip(found, _best(ids, x, q_ids[s : s + step], q[s : s + step], k, metric, least, epsilon), strict=True):
                    c.append(part)
        return pa.table([pa.array(np.concatenate(c)) for c in found], ["query_id", "id", "score"])

    keys = ["cell", "part", "block"]
    if sum(n * m for n, m in cells.values()) >= PAIRS:
        tasks = 2 * min(TASKS, sum(p * b for _, p, b in both))
        left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, FOUND)


def min_max(scores: DataFrame, value: str = "score", by: str = "query_id") -> DataFrame:
    """value scaled to 0 to 1 within each query; all ones if they are equal."""
    w = Window.partitionBy(by)
    span = F.max(value).over(w) - F.min(value).over(w)
    return scores.withColumn(value, F.when(span == 0, 1.0).otherwise((F.col(value) - F.min(value).over(w)) / span))


def mean_pool(vectors: DataFrame, group: str, vector: str, dim: int) -> DataFrame:
    """Element-wise means, one aggregate for each element: no row is exploded, and partial sums are all that is shuffled."""
    means = [F.avg(F.col(vector)[i].cast("double")) for i in range(dim)]
    return vectors.groupBy(group).agg(F.array(*means).alias("mean"))


def masked_mean(vectors: DataFrame, group: str, vector: str, mask: str, dim: int) -> DataFrame:
    """Element-wise sums of vectors times mask by the sum of mask, which counts as 1e-9 at least. Null masks are 0."""
    weight = F.coalesce(F.col(mask).cast("double"), F.lit(0.0))
    sums = [F.sum(F.col(vector)[i].cast("double") * weight) for i in range(dim)]
    return vectors.groupBy(group).agg(F.greatest(F.sum(weight), F.lit(1e-9)).alias("_n"), F.array(*sums).alias("_s")).select(group, F.transform("_s", lambda x: x / F.col("_n")).alias("mean"))


def synonym_pairs(entities: DataFrame, least: float = 0.8, most: int = 100) -> DataFrame:
    """(query_id, id, score) of each entity's neighbours, for entities (id, vector, name) with more than two letters or digits."""
    usable = F.length(F.regexp_replace("name", r"[^A-Za-z0-9]", "")) > 2
    found = top_k(entities.select("id", "vector"), entities.where(usable).select("id", "vector"), most + 1, "dot", least)
    named = entities.where(F.col("name") != "").select("id")
    return found.where("query_id <> id").join(named, "id", "left_semi").select("query_id", "id", "score")
