"""Embedding whitening: a one-sided Jacobi SVD of what a blockwise TSQR leaves of the centred rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, forget

#: An entry c becomes floor(SCALE * c) + SHIFT, within LIMIT.
SCALE, SHIFT, LIMIT = 1024, 100000, 1 << 61
#: So many triangles meet in a task, level by level, until one is left.
FAN = 32
SWEEPS = 60


def _valid(v: Column) -> Column:
    """Neither null nor with a null or non-finite entry."""
    return F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def integers(rows: pa.Array, dim: int) -> np.ndarray:
    """The x of every entry, a row a vector."""
    c = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * c), -float(LIMIT), float(LIMIT)).astype(np.int64) + SHIFT


class Centre:
    """The exact mean of n integer vectors, from their sums: whole part and remainder of each dimension."""

    def __init__(self, sums: list[int], n: int):
        self.n = n
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)
        self.part = self.rest / n

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n; the difference to the whole part of the mean is exact."""
        return (x - self.whole).astype(np.float64) - self.part

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n*x-S)^2, exact, of every row; None where a long cannot hold it."""
        y = x - self.whole
        reach = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if y.shape[1] * reach * reach < 1 << 63:
            return ((self.n * y - self.rest) ** 2).sum(axis=1).tolist()
        found = ((y.astype(object) * self.n - self.rest.astype(object)) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in found]


def _sums(rows: DataFrame, dim: int) -> tuple[list[int], int]:
    """Exact sums of x by dimension and the number of rows; tasks add up halves of 32 bits."""

    def run(batches):
        high, low, n = np.zeros(dim, np.int64), np.zeros(dim, np.int64), 0
        for batch in batches:
            x = integers(batch.column(0), dim)
            high, low, n = high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(high), pa.array(low), pa.array(np.full(dim, n, np.int64))], ["at", "high", "low", "n"])

    total = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low", "n")]
    found = rows.select("embedding").mapInArrow(run, "at int, high long, low long, n long").groupBy("at").agg(*total).collect()
    by = {r["at"]: r for r in found}
    return [(int(by[i].high) << 32) + int(by[i].low) for i in range(dim)], int(by[0].n)


def _triangle(blocks, dim: int) -> np.ndarray:
    """R of the rows of all blocks one upon another, with one block and R in memory at a time."""
    r = np.zeros((0, dim))
    for block in blocks:
        r = np.linalg.qr(np.concatenate((r, block)), mode="r")
    return r


def tsqr(rows: DataFrame, dim: int, centre: Centre) -> np.ndarray:
    """R of a QR factorisation of all centred rows: one triangle a task, then FAN at a time meet until one is left."""

    def first(batches):
        def blocks():
            held, size = [], 0
            for batch in batches:
                held.append(centre.centred(integers(batch.column(0), dim)))
                size += len(held[-1])
                if size >= 4 * dim:
                    yield np.concatenate(held)
                    held, size = [], 0
            if size:
                yield np.concatenate(held)

        r = _triangle(blocks(), dim)
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

    def meet(batches):
        group, r = None, None
        for batch in batches:
            for g, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block = np.frombuffer(raw).reshape(-1, dim)
                if g != group:
                    if group is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])
                    group, r = g, np.zeros((0, dim))
                r = np.linalg.qr(np.concatenate((r, block)), mode="r")
        if group is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

    spark = rows.sparkSession
    level = cut(rows.select("embedding").mapInArrow(first, "r binary").withColumn("at", F.monotonically_increasing_id()), "triangles")
    while (left := level.count()) > 1:
        # consecutive numbers of the triangles, from how many each partition of this small table holds
        part = F.shiftright("at", 33)
        held = sorted((p, n) for p, n in level.groupBy(part.alias("p")).count().collect())
        starts = spark.createDataFrame([(p, sum(n for _, n in held[:i])) for i, (p, n) in enumerate(held)], "p long, start long")
        numbered = level.withColumn("p", part).join(F.broadcast(starts), "p").select(((F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)) / FAN).cast("long").alias("g"), "at", "r")
        met = numbered.repartition(max(1, -(-left // FAN)), "g").sortWithinPartitions("g", "at").select("g", "r").mapInArrow(meet, "r binary")
        level, before = cut(met.withColumn("at", F.monotonically_increasing_id()), "triangles"), level
        forget(before)
    found = level.first()
    forget(level)
    return np.frombuffer(found.r).reshape(-1, dim)


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of r, falling, and its right singular vectors as columns.

    Plane rotations make the columns of r orthogonal, dim / 2 disjoint pairs at a time in the order of a round-robin; what
    they are applied to beside r, the identity, becomes the vectors. Orthogonality is relative to the columns' norms, so
    small values come out as accurately as large ones.
    """
    dim = r.shape[1]
    order = np.argsort(-np.linalg.norm(r, axis=0), kind="stable")
    a, v = r[:, order].copy(), np.eye(dim)[:, order]
    seats = np.arange(dim + dim % 2)
    tiny = np.finfo(np.float64).eps
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(len(seats) - 1):
            p, q = seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]
            real = (p < dim) & (q < dim)
            p, q = np.minimum(p, q)[real], np.maximum(p, q)[real]
            seats = np.concatenate((seats[:1], seats[-1:], seats[1:-1]))
            left, right = a[:, p], a[:, q]
            alpha, beta, gamma = (left * left).sum(axis=0), (right * right).sum(axis=0), (left * right).sum(axis=0)
            angle = np.abs(gamma) / np.maximum(np.sqrt(alpha) * np.sqrt(beta), np.finfo(np.float64).tiny)
            turn = angle > tiny
            if not turn.any():
                continue
            worst = max(worst, float(angle[turn].max()))
            p, q, alpha, beta, gamma = p[turn], q[turn], alpha[turn], beta[turn], gamma[turn]
            zeta = (beta - alpha) / (2 * gamma)
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            for m in (a, v):
                m[:, p], m[:, q] = c * m[:, p] - s * m[:, q], s * m[:, p] + c * m[:, q]
        if worst <= tiny * dim:
            break
    norms = np.linalg.norm(a, axis=0)
    order = np.argsort(-norms, kind="stable")
    return norms[order], v[:, order] / np.linalg.norm(v[:, order], axis=0)


def whiten(vectors: DataFrame, most: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for every usable row and component up to most.

    An entry c becomes the integer x = floor(1024 c) + 100000 (held within 2^61 either way). n rows are fitted, all that
    are usable. Their exact sums centre them; a blockwise QR, one triangle a task and triangles by FAN, compresses them to
    R, whose one-sided Jacobi SVD gives the components by falling variance e. deviation is exact (null where it passes 64
    bits), whitened is the centred row on the component by sqrt(e), explained is e over the sum of all, and
    identity_error the largest entry of whitened's covariance less the identity, measured over all rows.

    Rows go whose vector is null, holds null or non-finite entries, or is not of the usual length (that of most rows; of
    the longer on a tie). There are as many components as dimensions if those are fewer than most. A component without
    variance (fewer different rows than dimensions, constant entries) has a null whitened and is left out of
    identity_error. Repeated rows count as often as they come, zero vectors like any other; a null vec_id stays null; no
    usable rows, or vectors without entries, give no rows; extra columns are not read. Only tables of dim numbers and a
    triangle of dim x dim reach the driver.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    own = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")).where(_valid(F.col("embedding")))
    usual = own.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if usual is None or not usual.dim:
        return spark.createDataFrame([], schema)
    dim = usual.dim
    own = own.where(F.size("embedding") == dim)
    sums, n = _sums(own, dim)
    centre = Centre(sums, n)
    values, axes = jacobi(tsqr(own, dim, centre))
    k = min(most, dim)
    alive = values[:k] > max(values[0] * dim * np.finfo(np.float64).eps, 0.0)
    with np.errstate(divide="ignore"):
        axes = axes[:, :k] * np.where(alive, np.sqrt(n) / values[:k], 0.0)
    total = float((values**2).sum())
    explained = [float(v * v / total) if total else 0.0 for v in values[:k]]

    def project(batches):
        for batch in batches:
            x = integers(batch.column(1), dim)
            w = pa.array(np.where(alive, centre.centred(x) @ axes, 0.0).ravel())
            out = [batch.column(0), pa.array(centre.deviations(x), pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), w)]
            yield pa.RecordBatch.from_arrays(out, ["vec_id", "deviation", "w"])

    rows = cut(own.mapInArrow(project, "vec_id long, deviation long, w array<double>"), "whitened")
    live = np.flatnonzero(alive).tolist()
    error = None
    if live:
        mean = rows.agg(*[F.avg(F.col("w")[i]) for i in live]).first()
        less = {i: F.col("w")[i] - F.lit(m) for i, m in zip(live, mean, strict=True)}
        pairs = [(i, j) for i in live for j in live if i <= j]
        found = rows.agg(*[F.sum(less[i] * less[j]) / n for i, j in pairs]).first()
        error = max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs, strict=True))
    shares, live_at = F.array(*map(F.lit, explained)), F.array(*[F.lit(bool(x)) for x in alive])
    each = rows.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.when(live_at[F.col("at")], F.col("whitened")).alias("whitened"),
        shares[F.col("at")].alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
