"""Coordinates that keep neighbours: a graph of fuzzy neighbourhoods, laid out from its spectrum by forces."""

from __future__ import annotations

import numpy as np

#: Most rows that are laid out together; others find their places among them.
LANDMARKS = 500
EPOCHS = 40
#: Rows that take their places at a time, so that what is computed for them stays small.
ROWS = 128
#: The curve 1 / (1 + A d^(2 B)) that forces follow, for a least distance of 0.1, and pushes for each pull.
A, B, PUSHES = 1.577, 0.895, 5


def _gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine distances."""
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    return np.maximum(1 - unit(x) @ unit(y).T, 0.0)


def _degrees(gaps: np.ndarray) -> np.ndarray:
    """How far each neighbour belongs to a row's neighbourhood: the nearest fully, all together log2 of their number."""
    near = np.where(gaps > 1e-12, gaps, np.inf).min(axis=1, keepdims=True)
    over = np.maximum(gaps - np.where(np.isfinite(near), near, 0.0), 0.0)
    goal, low, high = np.log2(gaps.shape[1] + 1e-9), np.zeros((len(gaps), 1)), np.full((len(gaps), 1), np.inf)
    width = np.ones((len(gaps), 1))
    for _ in range(48):
        much = np.exp(-over / width).sum(axis=1, keepdims=True) > goal
        high, low = np.where(much, width, high), np.where(much, low, width)
        width = np.where(np.isfinite(high), (low + high) / 2, width * 2)
    return np.exp(-over / np.maximum(width, 1e-3 * gaps.mean() + 1e-12))


def _shares(gaps: np.ndarray, least: float) -> np.ndarray:
    """The same as _degrees up to rounding, with a least width, by few steps: Newton's, or half an interval where they leave it."""
    near = np.where(gaps > 1e-12, gaps, np.inf).min(axis=1, keepdims=True)
    over = np.maximum(gaps - np.where(np.isfinite(near), near, 0.0), 0.0)
    goal, width = np.log2(gaps.shape[1] + 1e-9), np.full((len(gaps), 1), least)
    now = np.flatnonzero(np.exp(-over / least).sum(axis=1) < goal)  # the others' width is the least
    low, high, at = np.full((len(now), 1), least), np.full((len(now), 1), np.inf), np.maximum(over[now].mean(axis=1, keepdims=True), least)
    for _ in range(60):
        if not len(now):
            break
        e = np.exp(-over[now] / at)
        off = e.sum(axis=1, keepdims=True) - goal
        low, high = np.where(off > 0, low, at), np.where(off > 0, at, high)
        step = at - off * at * at / np.maximum((e * over[now]).sum(axis=1, keepdims=True), 1e-300)
        after = np.where((step > low) & (step < high), step, np.where(np.isfinite(high), (low + high) / 2, at * 2))
        moved = (np.abs(after - at) > 1e-13 * at)[:, 0] & (off != 0)[:, 0]
        width[now] = np.where(off != 0, after, at)
        now, low, high, at = now[moved], low[moved], high[moved], after[moved]
    return np.exp(-over / width)


def graph(x: np.ndarray, neighbours: int) -> np.ndarray:
    """Symmetric weights from 0 to 1 of the pairs in either's neighbourhood."""
    n = len(x)
    gaps = _gaps(x, x)
    np.fill_diagonal(gaps, np.inf)
    near = np.argsort(gaps, axis=1, kind="stable")[:, :neighbours]
    w = np.zeros((n, n))
    np.put_along_axis(w, near, _degrees(np.take_along_axis(gaps, near, axis=1)), axis=1)
    return w + w.T - w * w.T


def lay_out(x: np.ndarray, dim: int, neighbours: int) -> np.ndarray:
    """dim coordinates for each row of x, of which there are at most some LANDMARKS: time and memory are quadratic.

    It starts from the leading eigenvectors of the normalised graph; then neighbours pull each other by their weights and
    all rows push each other, less from round to round. Without chance: equal input gives equal output. Up to two rows
    keep their first numbers.
    """
    n = len(x)
    if n <= 2:
        return x[:, :dim].astype(np.float64)
    w = graph(x, max(2, min(neighbours, n - 1)))
    dim = min(dim, n - 1)
    root = 1 / np.sqrt(np.maximum(w.sum(axis=1), 1e-12))
    vectors = np.linalg.eigh(root[:, None] * w * root[None, :])[1][:, ::-1][:, 1 : dim + 1]
    y = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(dim)])
    y = 10 * y / max(np.abs(y).max(), 1e-12)
    push = PUSHES * w.sum(axis=1, keepdims=True) / n
    # powers are the dear part: they are taken once a pair, pulls only where there is a weight, and all in the same memory
    pairs = np.triu_indices(n, 1)
    upper, lower = pairs[0] * n + pairs[1], pairs[1] * n + pairs[0]
    pulled = np.flatnonzero(w)
    weight, square, power, c = w.ravel()[pulled], np.empty((n, n)), np.ones((n, n)), np.empty((n, n))
    for epoch in range(EPOCHS):
        own = (y * y).sum(axis=1)
        np.add(own[:, None], own[None, :], out=square)
        np.subtract(square, np.matmul(2 * y, y.T, out=c), out=square)
        np.maximum(square, 0.0, out=square)
        half = np.maximum(square.ravel()[upper], 1e-4) ** B
        power.ravel()[upper], power.ravel()[lower] = half, half
        pull = 2 * A * B * power.ravel()[pulled] / np.maximum(square.ravel()[pulled], 1e-4) * weight
        square += 0.001
        np.divide(2 * B, square, out=c)
        c *= push
        c.ravel()[pulled] -= pull
        np.multiply(power, A, out=square)
        square += 1
        c /= square
        np.fill_diagonal(c, 0.0)
        y = y + (1 - epoch / EPOCHS) * 0.2 * np.clip(c.sum(axis=1, keepdims=True) * y - c @ y, -4, 4)
    return y


def place(x: np.ndarray, marks: np.ndarray, at: np.ndarray, neighbours: int) -> np.ndarray:
    """Coordinates of any rows: the mean of their nearest landmarks' (marks at at), by their degrees of neighbourhood."""
    if len(marks) <= 2:
        return x[:, : at.shape[1]].astype(np.float64)
    k = max(2, min(neighbours, len(marks)))
    parts = [slice(s, s + ROWS) for s in range(0, len(x), ROWS)]
    near, gaps, out = np.empty((len(x), k), np.int32), np.empty((len(x), k)), np.empty((len(x), at.shape[1]))
    for p in parts:
        own = _gaps(x[p], marks)
        near[p] = np.arange(k) if k == len(marks) else np.argsort(own, axis=1, kind="stable")[:, :k]
        gaps[p] = np.take_along_axis(own, near[p], axis=1)
    least = 1e-3 * gaps.mean() + 1e-12 if len(x) else 0.0
    for p in parts:
        w = _shares(gaps[p], least)
        out[p] = (w[:, None, :] @ at[near[p]])[:, 0] / w.sum(axis=1, keepdims=True)
    return out


def preserved(x: np.ndarray, y: np.ndarray, k: int = 10) -> float:
    """The share of each row's k nearest in x that are among its k nearest in y."""
    gaps, own = _gaps(x, x), ((y[:, None] - y[None]) ** 2).sum(axis=2)
    for g in (gaps, own):
        np.fill_diagonal(g, np.inf)
    a, b = (np.argsort(g, axis=1, kind="stable")[:, :k] for g in (gaps, own))
    return float(np.mean([len(np.intersect1d(p, q)) / k for p, q in zip(a, b, strict=True)]))
