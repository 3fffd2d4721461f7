"""An inverted file of vectors: cells found by k-means, a table partitioned by cell, and searches that read a few cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import vector_search as N

#: Most cells, and most vectors from which their centres are learnt (drawn by a hash of the id; all vectors are indexed).
CELLS, SAMPLE = 4096, 100_000
ROUNDS = 20


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1.0, n)


def _nearest(x: np.ndarray, centers: np.ndarray, k: int = 1) -> np.ndarray:
    """The k nearest centres of each row, nearest first."""
    gap = (centers * centers).sum(axis=1)[None, :] - 2 * (x @ centers.T)
    if k == 1:
        return gap.argmin(axis=1)[:, None]
    return np.argsort(gap, axis=1, kind="stable")[:, :k]


def centers_of(x: np.ndarray, cells: int, seed: int = 0) -> np.ndarray:
    """Centres by Lloyd's rounds from cells random rows; an empty cell takes a new row."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    centers = x[rng.permutation(len(x))[:cells]]
    for _ in range(ROUNDS):
        own = np.concatenate([_nearest(x[s : s + 4096], centers)[:, 0] for s in range(0, len(x), 4096)])
        counts = np.bincount(own, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        now = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], x[rng.integers(len(x), size=len(centers))])
        if np.allclose(now, centers, atol=1e-9):
            break
        centers = now
    return centers


class VectorIndex:
    """An approximate index of vectors (id, vector) in a folder: the table of centres, and the vectors partitioned by cell.

    Cosine compares directions, so cells are those of unit vectors; L2 takes vectors as they are. The probes cells whose
    centres are nearest to a question are searched, exactly; probes = cells searches all and equals the exact search.
    Vectors that are null have no cell and are not indexed; a zero vector has one.
    """

    def __init__(self, spark: SparkSession, path: str, metric: str = "cosine"):
        if metric not in ("cosine", "L2"):
            raise ValueError("cells are made for cosine and L2")
        self.spark, self.path, self.metric = spark, path.rstrip("/"), metric
        self.form = _unit if metric == "cosine" else np.asarray

    @property
    def centers(self) -> np.ndarray:
        rows = sorted(self.spark.read.parquet(f"{self.path}/centers").collect(), key=lambda r: r.cell)
        return np.array([list(r.vector) for r in rows], np.float64)

    @property
    def table(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/cells")

    def build(self, items: DataFrame, cells: int | None = None, seed: int = 0) -> VectorIndex:
        """Learn the cells from a sample, then write every vector to its cell."""
        items = items.select(F.col("id").cast("long").alias("id"), "vector").where(F.col("vector").isNotNull())
        n = items.count()
        drawn = items.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(SAMPLE) if n > SAMPLE else items
        x = self.form(np.array([list(r.vector) for r in drawn.select("vector").collect()], np.float64)) if n else np.zeros((0, 0))
        count = max(1, min(cells or round(n**0.5), CELLS, n))
        centers = centers_of(x, count, seed) if n else np.zeros((0, 0))
        self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, vector array<double>").write.mode("overwrite").parquet(f"{self.path}/centers")
        self._write(items, centers, "overwrite")
        return self

    def add(self, items: DataFrame) -> VectorIndex:
        """Write more vectors to the cells there are; ids must be new."""
        self._write(items.select(F.col("id").cast("long").alias("id"), "vector").where(F.col("vector").isNotNull()), self.centers, "append")
        return self

    def _write(self, items: DataFrame, centers: np.ndarray, mode: str) -> None:
        placed = self._probed(items, centers, 1)
        # ranges of (cell, id): a crowded cell is the work of several tasks and lies in several files
        placed.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.mode(mode).partitionBy("cell").parquet(f"{self.path}/cells")

    def _probed(self, rows: DataFrame, centers: np.ndarray, probes: int) -> DataFrame:
        """(id, vector, cell) for the probes nearest cells of every row."""
        shared, form = self.spark.sparkContext.broadcast(centers), self.form
        kind = rows.schema["vector"].dataType.simpleString()

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                near = _nearest(form(N._matrix(batch.column(1))), shared.value, probes)
                at = np.repeat(np.arange(batch.num_rows), near.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(near.ravel().astype(np.int32))], ["id", "vector", "cell"])

        return rows.mapInArrow(run, f"id long, vector {kind}, cell int")

    def search(self, queries: DataFrame, k: int, probes: int = 8, least: float | None = None) -> DataFrame:
        """(query_id, id, score, rank): the k best of the probes cells nearest to each of queries (id, vector).

        Which cells are asked for is known before the table is read, so others are pruned from its scan; there are at most
        CELLS of them, while questions stay distributed.
        """
        centers = self.centers
        if not len(centers):
            return self.spark.createDataFrame([], f"{N.FOUND}, rank int")
        queries = queries.select(F.col("id").cast("long").alias("id"), "vector").where(F.col("vector").isNotNull())
        asked = self._probed(queries, centers, min(probes, len(centers)))
        wanted = [r.cell for r in asked.select("cell").distinct().collect()]
        table = self.table if len(wanted) == len(centers) else self.table.where(F.col("cell").isin(wanted))
        return N.ranked(N.blocked(table, asked, k, self.metric, least), k)
