"""Embedding near-duplicates: passes that sort vectors by random hashes and compare bounded neighbour windows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, forget, join_hot
from .components import components

#: A group of vectors that all meet is cut into chunks of at least BLOCK rows; each row is sent to at most COPIES chunks
#: while a chunk stays within NUMBERS numbers, which bounds a task's memory.
BLOCK, COPIES, NUMBERS = 128, 64, 1 << 22
#: Rows of a chunk that are compared at a time.
SLICE = 64
BITS = 63


def _valid(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def bits_for(rows: int, window: int) -> int:
    """So many leading bits tell all rows down to a window's worth of them, if they spread evenly."""
    return min(BITS, max(0, math.ceil(math.log2(max(rows, 1) / window))))


def passes_for(rows: int, threshold: float, window: int, recall: float) -> int:
    """So many passes that a pair at the threshold itself agrees in all bits of bits_for in one, with this probability.

    A bit differs with probability angle / pi. Vectors that agree in these bits share a bucket, and all pairs of a bucket
    are compared: by the windows, or in blocks where more rows share it than a window spans.
    """
    agree = (1 - math.acos(threshold) / math.pi) ** bits_for(rows, window)
    return max(4, math.ceil(math.log(1 - recall) / math.log(max(1 - agree, 1e-12)))) if agree < 1 else 4


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of unit length; a power of two is taken out first, so no square overflows or vanishes."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _forest(a: np.ndarray, b: np.ndarray, n: int, root: np.ndarray | None = None) -> np.ndarray:
    """For n nodes and links (a, b), besides those that root stands for: the least node that each reaches."""
    root = np.arange(n) if root is None else root
    a, b = root[a], root[b]
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def _hashed(distinct: DataFrame, passes: int, seed: int, bits: int = BITS, wire: type | None = None) -> DataFrame:
    """(pass, dim, key, node) of every vector and pass, key being its leading bits; with the vector's bytes v if wire is given."""

    def spread(batches):
        planes: dict[int, np.ndarray] = {}
        power = (1 << np.arange(bits, dtype=np.int64))[::-1]
        for batch in batches:
            nodes, raw = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            sizes = np.array([len(v) for v in raw])
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                x = np.array([raw[i] for i in own], np.float64)
                packed = [v.tobytes() for v in x.astype(wire)] if wire else None
                own_x = _unit(x)
                if size not in planes:
                    planes[size] = np.random.default_rng([seed, int(size)]).standard_normal((int(size), passes * BITS))
                for p in range(passes):
                    key = ((own_x @ planes[size][:, p * BITS : p * BITS + bits]) > 0) @ power
                    out = [pa.array(np.full(len(own), p, np.int32)), pa.array(np.full(len(own), size, np.int32)), pa.array(key), pa.array(nodes[own])]
                    yield pa.RecordBatch.from_arrays([*out, pa.array(packed, pa.binary())] if wire else out, ["pass", "dim", "key", "node", "v"][: 5 if wire else 4])

    return distinct.select("node", "embedding").mapInArrow(spread, "pass int, dim int, key long, node long" + (", v binary" if wire else ""))


def window_links(distinct: DataFrame, passes: int, threshold: float, window: int, seed: int) -> DataFrame:
    """(a, b) verified links that join up what the windows of all passes show; at most one a vector and pass."""
    wire = np.float32 if distinct.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64

    def compare(batches):
        held = None
        for batch in batches:
            tag = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy()
            nodes, raw = batch.column(3).to_numpy(), batch.column(4).to_pylist()
            if held:
                tag, nodes, raw = np.concatenate((held[0], tag)), np.concatenate((held[1], nodes)), held[2] + raw
            held = (tag[-window:], nodes[-window:], raw[-window:])
            out_a, out_b = [], []
            for t in np.unique(tag):
                own = np.flatnonzero(tag == t)
                x = _unit(np.frombuffer(b"".join(raw[i] for i in own), wire).astype(np.float64).reshape(len(own), -1))
                a, b = [], []
                for off in range(1, min(window, len(own) - 1) + 1):
                    i = np.flatnonzero(np.einsum("ij,ij->i", x[:-off], x[off:]) >= threshold)
                    a.append(i)
                    b.append(i + off)
                if a:
                    mine = nodes[own]
                    order = np.argsort(mine, kind="stable")
                    at = np.empty(len(own), np.int64)
                    at[order] = np.arange(len(own))
                    root = _forest(at[np.concatenate(a)], at[np.concatenate(b)], len(own))
                    linked = np.flatnonzero(root != np.arange(len(own)))
                    out_a.append(mine[order][linked])
                    out_b.append(mine[order][root[linked]])
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    sent = _hashed(distinct, passes, seed, wire=wire)
    keys = ["pass", "dim", "key", "node"]
    return sent.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long").distinct()


def _chunks(rows: str, dim: str) -> Column:
    """Into how many chunks a group of so many vectors of this length is cut."""
    return F.expr(f"cast(ceil({rows} / least(greatest(1, {NUMBERS} div {dim}), greatest({BLOCK}, ceil({rows} / {COPIES})))) as long)")


def _meet(rows: DataFrame, key: list[str], work, schema: str) -> DataFrame:
    """work(nodes, n, x, split) on any two chunks of each group and on each chunk by itself.

    rows has key, chunks, node, n and embedding. Every row is sent to a group of its own chunk with every chunk, so no
    task holds more than two chunks and no pair leaves it. Rows come sorted by node; split is the number of rows of
    the first chunk, which come first, or None if there is but one chunk. work gives columns of schema.
    """
    group = [*key, "i", "j"]
    met = rows.withColumn("x", F.pmod(F.xxhash64("node"), F.col("chunks")))
    sent = met.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    sent = sent.select(*key, F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), (F.col("x") > F.col("y")).alias("right"), "node", "n", "embedding")
    names = [x.split()[0] for x in schema.split(", ")]

    def one(tag, parts):
        right, nodes, n, x = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((nodes, right))
        return work(nodes[order], n[order], _unit(x[order]), None if tag[-1] == tag[-2] else int((~right).sum()))

    def run(batches):
        tag, parts = None, []
        for batch in batches:
            tags = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns[: len(group)]], axis=1)
            if not len(tags):
                continue
            right, nodes, n, vector = batch.columns[len(group) :]
            right, nodes, n = right.to_numpy(zero_copy_only=False), nodes.to_numpy(), n.to_numpy()
            values, offsets = vector.values.to_numpy(zero_copy_only=False), vector.offsets.to_numpy()
            cuts = [0, *(np.flatnonzero((tags[1:] != tags[:-1]).any(axis=1)) + 1).tolist(), len(tags)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                now = tuple(tags[a].tolist())
                if now != tag:
                    if parts:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in one(tag, parts)], names)
                    tag, parts = now, []
                parts.append((right[a:b], nodes[a:b], n[a:b], values[offsets[a] : offsets[b]].astype(np.float64).reshape(b - a, -1)))
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in one(tag, parts)], names)

    return sent.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, schema)


def _joined(x: np.ndarray, split: int | None, threshold: float) -> np.ndarray:
    """The least row that each row of x reaches by links, those between the first split rows and the rest if split is given.

    A slice of rows at a time meets all others: a row is tied to the first of the slice that it links to, and rows of the
    slice that link to one and the same row to each other.
    """
    n = len(x)
    root = np.arange(n)
    for s in range(0, n if split is None else split, SLICE):
        e = min(s + SLICE, n if split is None else split)
        low = s if split is None else split
        hit = x[s:e] @ x[low:].T >= threshold
        first = hit.argmax(axis=0)
        on = np.flatnonzero(hit[first, np.arange(n - low)])
        if not len(on):
            continue
        some = hit[:, on].astype(np.float32)
        a, b = np.nonzero(np.triu(some @ some.T > 0, 1))
        root = _forest(np.concatenate((on + low, a + s)), np.concatenate((first[on] + s, b + s)), n, root)
    return root


def crowded_links(distinct: DataFrame, rows: int, passes: int, threshold: float, window: int, seed: int) -> DataFrame:
    """(a, b) verified links that join up what the buckets show which have more rows than a window spans.

    There the next window rows are but a part of a vector's bucket (a large group of copies of one vector may link to it
    and hardly to each other), so all rows of the bucket meet, see _meet: quadratic in a bucket's distinct vectors.
    """
    keys = ["pass", "dim", "key"]
    light = cut(_hashed(distinct, passes, seed, bits_for(rows, window)), "buckets")
    sizes = light.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > window + 1)
    sizes = cut(sizes.withColumn("chunks", _chunks("rows", "dim")), "crowded")

    def work(nodes, n, x, split):
        root = _joined(x, split, threshold)
        linked = np.flatnonzero(root != np.arange(len(nodes)))
        return nodes[linked], nodes[root[linked]]

    met = join_hot(light, sizes, keys, "rows", rows * passes).join(distinct.select("node", F.lit(1).cast("long").alias("n"), "embedding"), "node")
    return _meet(met, keys, work, "a long, b long").distinct()


def _counts(members: DataFrame, threshold: float) -> DataFrame:
    """(node, links) for members (root, chunks, node, n, embedding): how many rows every vector links to in its component, itself included."""

    def work(nodes, n, x, split):
        end, low = (len(nodes), 0) if split is None else (split, split)
        out = np.zeros(len(nodes), np.int64)
        for s in range(0, end, SLICE):
            e = min(s + SLICE, end)
            hit = x[s:e] @ x[low:].T >= threshold
            if split is None:
                hit[np.arange(e - s), np.arange(s, e)] = True
            out[s:e] += hit @ n[low:]
            if split is not None:
                out[low:] += n[s:e] @ hit
        return nodes, out

    return _meet(members, ["root"], work, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, window: int = 32, recall: float = 0.995, seed: int = 9) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors (vec_id, embedding).

    Rows with equal vectors are collapsed first. Each pass orders the distinct vectors by 63 random hyperplane bits and
    compares each with the next window ones, and where more rows share their leading bits than a window spans, all of
    these with each other; there are as many passes as a pair at the threshold needs to be met with probability recall,
    so their number grows with the logarithm of the rows. (The order is cut into ranges for the tasks; a window ends with
    its range, which at most window pairs a task and pass fall across; recall leaves these out of account.) Verified
    pairs (cosine in double precision) are united over all passes. Then all links inside each component are counted,
    whatever the windows showed, so n_links has no cap. That is quadratic in a component's distinct vectors in time;
    each vector is sent to at most COPIES tasks until a component has more than COPIES * NUMBERS / length vectors.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    different lengths; such rows are components of their own. n_links counts rows, so repeated rows count each other, and
    rows that share a vec_id and not the vector are apart. A null vec_id is a component's id only if it has no other;
    kept is whether a row has its component's id (null is null's). An empty table gives an empty one. Extra columns are
    not read.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    own = vectors.select(F.col("vec_id").cast("long"), "embedding").withColumns({"ok": _valid(F.col("embedding"))})
    good = own.where("ok").select("vec_id", "embedding", F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(7), "embedding").alias("k2"))
    distinct = good.groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.any_value("embedding").alias("embedding"))
    distinct = cut(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")
    rows, total = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    passes = passes_for(rows, threshold, window, recall)
    links = window_links(distinct, passes, threshold, window, seed).unionByName(crowded_links(distinct, rows, passes, threshold, window, seed))
    roots = components(links, "a", "b")
    members = cut(distinct.join(roots, "node"), "members")
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("embedding")).alias("dim"), F.min("least").alias("component_id"))
    sizes = cut(sizes.withColumn("chunks", _chunks("rows", "dim")), "sizes")
    met = join_hot(members, sizes.drop("dim", "component_id"), ["root"], "rows", rows)
    ids = join_hot(members.select("node", "root"), sizes.drop("dim", "chunks"), ["root"], "rows", rows)
    found = _counts(met, threshold).join(ids, "node")
    result = (
        distinct.select("k1", "k2", "n", "least", "node").join(found.withColumn("linked", F.lit(True)), "node", "left")
        .select("k1", "k2", "n", (F.coalesce("links", "n") - 1).alias("n_links"), F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    )
    result = cut(result, "result")
    forget(distinct, members, sizes)
    found = join_hot(good.select("vec_id", "k1", "k2"), result, ["k1", "k2"], "n", total).select("vec_id", "n_links", "component_id")
    alone = own.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
