"""SimHash near-duplicates by anchor points: a covering code's words, near which fingerprints meet."""

from __future__ import annotations

import math
import re
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, join_hot
from .components import components

SEED = 42
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
#: The code: Hamming's perfect (31, 26) code and one free bit, on either half of a fingerprint. Its covering radius is 1.
RADIUS = 1
_SYNDROME = np.array([[np.bitwise_xor.reduce([8 * byte + i + 1 for i in range(8) if v >> i & 1 and 8 * byte + i < 31] or [0]) for v in range(256)] for byte in range(4)], np.uint8)
#: Anchors of more fingerprints than this are split by anchors of the other half.
DENSE = 100_000


def _flips() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome: flips that lead to code words at most RADIUS + 1 away, and how many there are."""
    masks, counts = np.zeros((32, 17), np.uint64), np.zeros(32, np.int64)
    for s in range(32):
        own = [0, 1 << 31] if s == 0 else [1 << (s - 1), 1 << (s - 1) | 1 << 31]
        own += [1 << (i - 1) | 1 << ((i ^ s) - 1) for i in range(1, 32) if s and i < i ^ s]
        masks[s, : len(own)], counts[s] = own, len(own)
    return masks, counts


_MASKS, _COUNTS = _flips()


def fingerprint(text: str | None, words: int = 4) -> int:
    """The 64-bit fingerprint of a text (zero without words)."""
    import xxhash

    own = _WORD.findall((text or "").translate(_LOWER) if not (text or "").isascii() else (text or "").lower())
    if not own:
        return 0
    encoded = [w.encode("utf-8", "surrogatepass") for w in own]
    ends = np.cumsum([len(w) + 1 for w in encoded])
    flat = b" ".join(encoded)
    starts = (ends - [len(w) + 1 for w in encoded]).tolist()
    stops = (ends[words - 1 :] - 1).tolist() or [len(flat)]
    digest = xxhash.xxh64_digest
    # several passes over slices keep the bits of a very long text from filling memory
    n, total = len(stops), np.zeros(64, np.int64)
    for a in range(0, n, 50_000):
        raw = b"".join([digest(flat[s:e], SEED) for s, e in zip(starts[a : a + 50_000], stops[a : a + 50_000], strict=False)])
        total += np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def anchors_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For uint64 fingerprints: rows of (index, anchor key), every anchor of either half within RADIUS + 1."""
    index, keys = [], []
    for half in range(2):
        x = (fps >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        s = np.zeros(len(x), np.uint8)
        for byte in range(4):
            s ^= _SYNDROME[byte, (x >> np.uint64(8 * byte) & np.uint64(255)).astype(np.int64)]
        rows = np.repeat(np.arange(len(x)), _COUNTS[s])
        nth = np.arange(len(rows)) - np.repeat(np.cumsum(_COUNTS[s]) - _COUNTS[s], _COUNTS[s])
        index.append(rows)
        keys.append((x[rows] ^ _MASKS[s[rows], nth]) | np.uint64(half << 32))
    return np.concatenate(index), np.concatenate(keys)


def _quarter_flips() -> list[np.ndarray]:
    """For each syndrome of Hamming's perfect (15, 11) code: flips of 16 bits, one of them free, that lead to code words at most RADIUS + 1 away."""
    out: list[list[int]] = [[] for _ in range(16)]
    for bits in range(3):
        for own in combinations(range(16), bits):
            out[reduce(lambda s, b: s ^ (b + 1), (b for b in own if b < 15), 0)].append(sum(1 << b for b in own))
    return [np.array(x, np.uint64) for x in out]


def split_anchors(anchors: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of (index, key): each anchor of a half together with the anchors, within RADIUS + 1, of either quarter of the other half.

    Fingerprints that link differ in at most 5 bits of the other half, so in at most 2 of one of its quarters, and a word
    between these is within RADIUS of an anchor.
    """
    flips, index, keys = _quarter_flips(), [], []
    other = np.where(anchors >> np.uint64(32) & np.uint64(1), np.uint64(0), np.uint64(32))
    for quarter in range(2):
        x = fps >> (other + np.uint64(16 * quarter)) & np.uint64(0xFFFF)
        s = np.zeros(len(x), np.uint64)
        for b in range(15):
            s ^= (x >> np.uint64(b) & np.uint64(1)) * np.uint64(b + 1)
        for v, masks in enumerate(flips):
            own = np.flatnonzero(s == v)
            index.append(np.repeat(own, len(masks)))
            code = (x[own][:, None] ^ masks).ravel()
            keys.append(anchors[index[-1]] | np.uint64(quarter + 1) << np.uint64(33) | code << np.uint64(35))
    return np.concatenate(index), np.concatenate(keys)


def linked(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that join up one anchor's distinct fingerprints: a breadth-first walk, each step against what it has not met.

    At most len(fps) - 1 links; memory grows with the anchor's fingerprints, never with their pairs.
    """
    links, left = [], np.sort(fps)
    while len(left) > 1:
        root, left = left[0], left[1:]
        todo = [root]
        while todo and len(left):
            near = np.bitwise_count(left ^ todo.pop()) <= bits
            if near.any():
                found = left[near]
                links += [(int(v), int(root)) for v in found.view(np.int64)]
                todo += list(found)
                left = left[~near]
    return [(a, int(np.array([b], np.uint64).view(np.int64)[0])) for a, b in links]


def link_fingerprints(distinct: DataFrame, bits: int = 4) -> DataFrame:
    """(a, b) links that connect all fingerprints (column fp, distinct) with at most bits differing bits, transitively.

    bits may be up to 5: a pair has at most 2 differing bits in one half; a word between the two is within 1 of both,
    and an anchor is within RADIUS of that word, so both lie within RADIUS + 1 of one anchor. Each fingerprint is sent
    to all anchors that near (17 a half, nearly always) and compared with the others there over all 64 bits. An anchor
    with more than DENSE fingerprints is not compared but split: its rows are sent on to it and the anchors of either
    quarter of the other half (about 9 a quarter), by the same argument, so that no task holds a dense anchor.
    """
    if not 0 <= bits <= 5:
        raise ValueError("bits must be 0 to 5")

    def spread(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            index, keys = anchors_of(fps)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(fps[index].view(np.int64))], ["anchor", "fp"])

    def split(batches):
        for batch in batches:
            anchors, fps = (c.to_numpy().view(np.uint64) for c in batch.columns)
            index, keys = split_anchors(anchors, fps)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(fps[index].view(np.int64))], ["anchor", "fp"])

    def met(sent: DataFrame, most: float) -> DataFrame:
        """(anchor, a, b): links, with a null anchor; or rows a of an anchor with more than most, with b null."""

        def work(k, f):
            starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            sizes = np.diff(np.concatenate((starts, [len(k)])))
            a, b = [], []
            for off in range(1, 8):  # anchors with few fingerprints, all at once
                i = np.flatnonzero(k[off:] == k[:-off])
                i = i[np.repeat(sizes <= 8, sizes)[i]]
                i = i[np.bitwise_count(f[i].view(np.uint64) ^ f[i + off].view(np.uint64)) <= bits]
                a.append(f[i])
                b.append(f[i + off])
            for s, n in zip(starts[sizes > 8], sizes[sizes > 8], strict=True):
                more = linked(f[s : s + n].view(np.uint64), bits)
                a.append(np.array([x for x, _ in more], np.int64))
                b.append(np.array([y for _, y in more], np.int64))
            a, b = np.concatenate(a), np.concatenate(b)
            pairs = np.unique(np.stack((np.maximum(a, b), np.minimum(a, b))), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(pairs[0]), np.int64), mask=np.ones(len(pairs[0]), bool)), pa.array(pairs[0]), pa.array(pairs[1])], ["anchor", "a", "b"])

        def dense(k, f):
            return pa.RecordBatch.from_arrays([pa.array(k), pa.array(f), pa.array(np.zeros(len(k), np.int64), mask=np.ones(len(k), bool))], ["anchor", "a", "b"])

        def compare(batches):
            held_k, held_f, crowded = np.zeros(0, np.int64), np.zeros(0, np.int64), None
            for batch in batches:
                k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                if crowded is not None and len(k):
                    n = np.searchsorted(k, crowded, "right") if k[0] == crowded else 0
                    if n:
                        yield dense(k[:n], f[:n])
                        k, f = k[n:], f[n:]
                    crowded = crowded if not len(k) else None
                k, f = np.concatenate((held_k, k)), np.concatenate((held_f, f))
                last = np.searchsorted(k, k[-1]) if len(k) else 0
                if last and len(k) >= 50_000:
                    yield work(k[:last], f[:last])
                    k, f = k[last:], f[last:]
                    last = 0
                if len(k) - last > most:
                    if last:
                        yield work(k[:last], f[:last])
                    crowded = k[-1]
                    yield dense(k[last:], f[last:])
                    k, f = k[:0], f[:0]
                held_k, held_f = k, f
            if len(held_k):
                yield work(held_k, held_f)

        return sent.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, "anchor long, a long, b long")

    first = cut(met(distinct.select("fp").mapInArrow(spread, "anchor long, fp long"), DENSE), "met")
    links = first.where(F.col("b").isNotNull())
    crowded = first.where(F.col("b").isNull())
    if not crowded.isEmpty():
        links = links.unionByName(met(crowded.select("anchor", "a").mapInArrow(split, "anchor long, fp long"), math.inf))
    return links.select("a", "b").distinct()


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = 4) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id): the smallest doc_id that links of at most bits differing bits reach.

    Null and empty texts have fingerprint zero and link like any other. Equal fingerprints are collapsed before anything
    is compared, so copies cost one row. Rows of one doc_id are taken as they are; a null doc_id counts only if a
    component has no other. An empty table gives an empty one; extra columns are not read.
    """
    own = cut(fingerprints(docs, words), "fingerprints")
    groups = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "groups")
    roots = components(link_fingerprints(groups.select("fp"), bits), "a", "b").withColumnRenamed("node", "fp")
    met = groups.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = met.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = cut(met.join(least, "root").select("fp", "n", "component_id"), "components")
    total = own.count()
    return join_hot(own, by_fp, ["fp"], "n", total).select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
