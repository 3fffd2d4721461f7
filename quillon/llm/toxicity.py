"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORDS, WordIndex, bound_batches, starts_of

#: Rows of the hashed embedding table, its columns, filter widths, filters of each width, letters of a word's hashed beginnings.
SLOTS, DIM, WIDTHS, FILTERS, PREFIXES = 1 << 16, 16, (1, 2, 3), 8, (4, 6)
BLOCKS = sum(WIDTHS)
PADS = max(WIDTHS)
#: At most about so many labelled rows teach.
SAMPLE = 6000


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def slots_of(words: list[str]) -> np.ndarray:
    """The rows of the embedding table that make up each word: its own and those of its beginnings."""
    crc = zlib.crc32
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    columns = [[crc(w) % SLOTS for w in raw], *([crc(b"^%d" % n + w[:n].encode("utf-8", "surrogatepass")) % SLOTS for w in words] for n in PREFIXES)]
    return np.array(columns, np.int64).reshape(len(columns), len(words)).T


@dataclass
class Net:
    """embed: SLOTS x DIM; filters: DIM x (BLOCKS * FILTERS), one block for each place of each width; bias and out: a number a filter."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict | None = None

    def project(self, slots: np.ndarray) -> np.ndarray:
        """What each word adds to each filter at each place: the convolution, but for the sum over places."""
        return (self.embed[slots].sum(axis=1) @ self.filters).astype(np.float32)

    def pooled(self, rows: np.ndarray, lengths: np.ndarray, table: np.ndarray, arg: bool = False, span: int = 40_000):
        """Max over places for each text. rows: words' numbers in table end to end, PADS pads (-1) after each text; lengths without pads.

        table's last row, which pads take, is zero.

        Places are worked off in spans, so memory does not grow with a text.
        """
        n, width = len(lengths), FILTERS * len(WIDTHS)
        best, where = np.full((n, width), -np.inf, np.float32), np.zeros((n, width), np.int64)
        firsts = starts_of(lengths + PADS)
        for a in range(0, len(rows), span):
            b = min(len(rows), a + span)
            own = table[np.concatenate((rows[a : min(len(rows), b + PADS)], np.full(max(0, b + PADS - len(rows)), -1, np.int64)))]
            got, col = np.empty((b - a, width), np.float32), 0
            for k, size in enumerate(WIDTHS):
                part = own[: b - a, col : col + FILTERS].copy()
                for j in range(1, size):
                    part += own[j : b - a + j, col + j * FILTERS : col + (j + 1) * FILTERS]
                got[:, k * FILTERS : (k + 1) * FILTERS] = part
                col += size * FILTERS
            lo, hi = np.searchsorted(firsts + lengths + 1, a, "right"), np.searchsorted(firsts, b)
            if hi <= lo:
                continue
            s, e = np.maximum(firsts[lo:hi], a) - a, np.minimum(firsts[lo:hi] + lengths[lo:hi] + 1, b) - a
            edges = np.stack((s, np.minimum(e, b - a)), axis=1).ravel()
            edges = edges[:-1] if edges[-1] == b - a else edges
            top = np.maximum.reduceat(got, edges, axis=0)[::2]
            if arg:
                for i in range(hi - lo):
                    up = top[i] > best[lo + i]
                    where[lo + i, up] = a + s[i] + got[s[i] : e[i], up].argmax(axis=0)
            best[lo:hi] = np.maximum(best[lo:hi], top)
        return (best, where) if arg else best

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.out + self.shift

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.logits(pooled) + b, -40, 40)))


def _flat(texts: list[list[str]], index: WordIndex) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(t) for t in texts], np.int64)
    rows = np.full(int((lengths + PADS).sum()), -1, np.int64)
    at = np.arange(lengths.sum()) + np.repeat(np.arange(len(texts)) * PADS, lengths)
    rows[at] = index.numbers([w for t in texts for w in t])
    return rows, lengths


def train(texts: list[str], labels: np.ndarray, langs: list, epochs: int = 5, seed: int = 1, batch: int = 32) -> Net:
    """Adam on the logistic loss; a fifth of the texts is kept apart for the scale of the scores and the thresholds by language."""
    rng = np.random.default_rng(seed)
    net = Net(rng.normal(0, 0.02, (SLOTS, DIM)).astype(np.float32), rng.normal(0, 0.25, (DIM, BLOCKS * FILTERS)).astype(np.float32), np.zeros(FILTERS * len(WIDTHS), np.float32), rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), -1.0, thresholds={})
    if not len(texts) or labels.min() == labels.max():
        return net
    index = WordIndex()
    docs = [index.numbers(words_of(t)) for t in texts]
    slots = slots_of(list(index))
    apart = rng.random(len(texts)) < 0.2
    apart &= ~(apart.all() | (~apart).all())
    fit = np.flatnonzero(~apart)
    moments: dict[str, list] = {}
    step = 0

    def adam(name, grad, rows=None, rate=0.01):
        value = getattr(net, name)
        m, v = moments.setdefault(name, [np.zeros_like(value), np.zeros_like(value)])
        at = slice(None) if rows is None else rows
        m[at] = 0.9 * m[at] + 0.1 * grad
        v[at] = 0.98 * v[at] + 0.02 * grad * grad
        value[at] -= rate * m[at] / (np.sqrt(v[at]) + 1e-6)

    def pad(own):
        lengths = np.array([len(docs[i]) for i in own], np.int64)
        words, local = np.unique(np.concatenate([docs[i] for i in own]), return_inverse=True)
        rows = np.full(int((lengths + PADS).sum()), -1, np.int64)
        rows[np.arange(lengths.sum()) + np.repeat(np.arange(len(own)) * PADS, lengths)] = local
        return words, rows, lengths

    places = [(k, j) for k, size in enumerate(WIDTHS) for j in range(size)]
    for _ in range(epochs):
        for own in np.array_split(rng.permutation(fit), max(1, len(fit) // batch)):
            step += 1
            words, rows, lengths = pad(own)
            mixed = net.embed[slots[words]].sum(axis=1)
            top, where = net.pooled(rows, lengths, np.pad(mixed @ net.filters, ((0, 1), (0, 0))), arg=True)
            hidden = np.maximum(top + net.bias, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ net.out + net.shift, -40, 40)))
            d = ((p - labels[own]) / len(own)).astype(np.float32)
            back = (d[:, None] * net.out) * (top + net.bias > 0)
            table = np.zeros((len(words) + 1, BLOCKS * FILTERS), np.float32)  # the last row takes what falls on pads
            for block, (k, j) in enumerate(places):
                hit = rows[np.minimum(where[:, k * FILTERS : (k + 1) * FILTERS] + j, len(rows) - 1)]
                cols = np.broadcast_to(block * FILTERS + np.arange(FILTERS), hit.shape)
                np.add.at(table, (hit.ravel(), cols.ravel()), back[:, k * FILTERS : (k + 1) * FILTERS].ravel())
            touched = np.flatnonzero(table[:-1].any(axis=1))
            per_word = table[touched] @ net.filters.T
            at, inverse = np.unique(slots[words[touched]].ravel(), return_inverse=True)
            grad = np.zeros((len(at), DIM), np.float32)
            np.add.at(grad, inverse, np.repeat(per_word, slots.shape[1], axis=0))
            adam("out", hidden.T @ d + 1e-4 * net.out)
            adam("bias", back.sum(axis=0))
            adam("filters", mixed[touched].T @ table[touched] + 1e-5 * net.filters)
            if len(at):
                adam("embed", grad, at, 0.02)
            net.shift -= 0.05 * float(d.sum())
    held = np.flatnonzero(apart) if apart.any() else fit
    z = np.concatenate([net.logits(net.pooled(rows, lengths, np.pad(net.project(slots[words]), ((0, 1), (0, 0))))) for words, rows, lengths in map(pad, np.array_split(held, max(1, len(held) // 64)))])
    y = labels[held].astype(float)
    aims = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(500):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        w = np.maximum(p * (1 - p), 1e-6)
        g, h = np.array([((p - aims) * z).sum(), (p - aims).sum()]), np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        move = np.linalg.solve(h, g)
        a, b = a - np.clip(move[0], -0.5, 0.5), b - np.clip(move[1], -0.5, 0.5)
    net.scale = (max(float(a), 1e-3), float(b))
    p = 1 / (1 + np.exp(-np.clip(net.scale[0] * z + b, -40, 40)))
    for lang in sorted({langs[i] for i in held if langs[i] is not None}):
        own = np.array([langs[i] == lang for i in held])
        net.thresholds[lang] = _best_threshold(p[own], y[own])
    return net


def _best_threshold(p: np.ndarray, y: np.ndarray, usual: float = 0.3) -> float:
    """The threshold with the best F1, or the usual one if that is as good."""
    def f1(t):
        hit = ((p >= t) & (y > 0)).sum()
        return 2 * hit / max(1, (p >= t).sum() + y.sum())
    tries = [usual, *np.arange(0.05, 1, 0.05)]
    return float(max(tries, key=lambda t: (f1(t), t == usual)))


def fit(docs: DataFrame, labels: DataFrame, teaches: Column | None = None, sample: int = SAMPLE) -> Net:
    """A net from about sample labelled rows, drawn by hash among those that teaches allows (crc32(doc_id) mod 4 is not 2).

    Labels of one doc_id that differ count as toxic; null labels are passed over. Of documents that share a doc_id one,
    that with the least text, teaches, so no more rows than were drawn reach the driver.
    """
    rest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(teaches if teaches is not None else rest != 2)
    n = known.count()
    drawn = known.where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1_000_003)) < int(1_000_003 * min(1.0, sample / max(n, 1))))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang")).join(F.broadcast(drawn), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("text", "lang", "toxic")).alias("row")).select("doc_id", "row.*").toArrow().sort_by("doc_id")
    texts = [t or "" for t in rows["text"].to_pylist()]
    return train(texts, (rows["toxic"].to_numpy() > 0).astype(np.float32), rows["lang"].to_pylist())


def score(docs: DataFrame, net: Net, threshold: float = 0.3) -> DataFrame:
    """doc_id, lang, score (0 to 1), predicted (score >= threshold) and flagged (score >= the language's own threshold).

    The whole text is read; null and empty texts are scored as texts without words. Rows of languages without a
    threshold of their own (null too) use the common one. Repeated rows are scored alike; extra columns are not read.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        net, index = shared.value, WordIndex(200_000)
        table = np.zeros((1, BLOCKS * FILTERS), np.float32)
        room = 0
        for batch in batches:
            rows, lengths = _flat([words_of(t) for t in batch.column(2).to_pylist()], index)
            if index.fresh:
                need = len(index)
                if need >= len(table):
                    table = np.concatenate((table, np.zeros((max(need + 1 - len(table), len(table) // 2, 50_000), table.shape[1]), np.float32)))
                table[room:need] = net.project(slots_of(index.fresh))
                room = need
                index.fresh.clear()
            p = net.scores(net.pooled(rows, lengths, table)).astype(np.float64)
            langs = batch.column(1).to_pylist()
            own = np.array([net.thresholds.get(x, threshold) for x in langs])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array((p >= own).astype(np.int32))], ["doc_id", "lang", "score", "predicted", "flagged"])
            if index.full:
                index.clear()
                table, room = np.zeros((1, table.shape[1]), np.float32), 0

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long"), lang.alias("lang"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang string, score double, predicted int, flagged int")
