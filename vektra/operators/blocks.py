"""Distances of blocks of queries and points, in memory that does not grow with the tables.

A matrix product finds the few pairs that may count, and only these are summed exactly:
component by component, in order, as a sequential sum does, so that equal vectors have
equal distances whatever block they are in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ..functions.vectors import EPSILON

#: Pairs whose rough distances are held at a time, pairs that are summed exactly at a time, points of a block, and rows of a batch given out.
CELLS, PAIRS, POINTS, ROWS = 1 << 20, 1 << 15, 8192, 1 << 16
NONE = np.iinfo(np.int64).max


def in_order(parts: np.ndarray) -> np.ndarray:
    """Sums of rows, from the first component to the last."""
    return np.cumsum(parts, axis=1)[:, -1] if parts.shape[1] else np.zeros(len(parts))


def exact_distances(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of pairs of rows."""
    if metric == "l2":
        return in_order((q - x) ** 2)
    dots = in_order(q * x)
    return -dots if metric == "ip" else 1 - dots / (np.sqrt(in_order(q * q)) * np.sqrt(in_order(x * x)) + EPSILON)


def rough_distances(metric: str, q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray | float]:
    """(queries, points) distances by a matrix product, and by how much they may be off, for each query."""
    qq, xx = (q * q).sum(1), (x * x).sum(1)
    few = 4e-16 * (q.shape[1] + 64)
    if metric == "cosine":
        return 1 - (q @ x.T) / (np.sqrt(qq)[:, None] * np.sqrt(xx)[None] + EPSILON), few
    off = few * (qq + (xx.max() if len(xx) else 0))
    if metric == "ip":
        return q @ -x.T, off
    d = q @ (-2 * x.T)
    d += xx[None]
    d += qq[:, None]
    return d, 4 * off


def every_distance(metrics, q: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
    """(queries, points) distances by each metric, of all pairs, exactly."""
    shape, (qt, xt) = (len(q), len(x)), (np.ascontiguousarray(v.T) for v in (q, x))
    l2, dots, term = (np.zeros(shape) for _ in range(3))
    for a, b in zip(qt, xt):
        if "l2" in metrics:
            np.subtract(a[:, None], b[None], out=term)
            np.multiply(term, term, out=term)
            l2 += term
        if "ip" in metrics or "cosine" in metrics:
            np.multiply(a[:, None], b[None], out=term)
            dots += term
    norms = [np.sqrt(in_order(v * v)) for v in (q, x)] if "cosine" in metrics else None
    return [l2 if m == "l2" else -dots if m == "ip" else 1 - dots / (norms[0][:, None] * norms[1][None] + EPSILON) for m in metrics]


class Nearest:
    """The k nearest (distance, id) of each query so far, ties to the smaller id; holds k rows a query.

    ``also``: one value more a row, such as a distance by another metric. NaN comes last.
    ``cap``: the largest distance that counts.
    """

    def __init__(self, queries: int, k: int, also: bool = False, cap: float = np.inf):
        self.k, self.cap = k, cap
        self.d = np.full((queries, k), np.nan)
        self.ids = np.full((queries, k), NONE)
        self.also = np.full((queries, k), np.nan) if also else None

    def bounds(self, rows: np.ndarray, rough: np.ndarray, off) -> np.ndarray:
        """The rough distance up to which a pair may still count, for each query."""
        most = self.d[rows, -1]
        unfilled = np.isnan(most)
        if rough.shape[1] > self.k and unfilled.any():
            most[unfilled] = np.partition(rough[unfilled], self.k - 1, axis=1)[:, self.k - 1] + np.broadcast_to(off, len(rows))[unfilled]
        return np.minimum(np.where(np.isnan(most), np.inf, most + off), self.cap)

    def take(self, rows: np.ndarray, ids: np.ndarray, rough: np.ndarray, off, exact=None, also=None) -> None:
        """A block of pairs of the queries ``rows`` and points ``ids``.

        ``exact(r, c)`` gives the distances of pairs, by their places in the block; None
        where rough ones are exact. ``also(r, c)`` gives their further values.
        """
        with np.errstate(invalid="ignore"):
            at = np.flatnonzero(~(rough > self.bounds(rows, rough, off)[:, None]).ravel())
        for i in range(0, len(at), PAIRS):
            r, c = np.divmod(at[i : i + PAIRS], rough.shape[1])
            d = rough[r, c] if exact is None else exact(r, c)
            last = self.d[rows[r], -1]
            fits = ~(d > last) & ~((d == last) & (ids[c] > self.ids[rows[r], -1]))
            r, c, d = r[fits], c[fits], d[fits]
            if len(r):
                self._add(rows[r], ids[c], d, None if also is None else also(r, c))

    def _add(self, r, ids, d, also) -> None:
        own, at = np.unique(r, return_inverse=True)
        place = np.concatenate([np.repeat(np.arange(len(own)), self.k), at])
        d, ids = np.concatenate([self.d[own].ravel(), d]), np.concatenate([self.ids[own].ravel(), ids])
        order = np.lexsort((ids, d, place))
        place = place[order]
        order = order[np.arange(len(place)) - np.searchsorted(place, place) < self.k]
        self.d[own], self.ids[own] = d[order].reshape(-1, self.k), ids[order].reshape(-1, self.k)
        if also is not None:
            self.also[own] = np.concatenate([self.also[own].ravel(), also])[order].reshape(-1, self.k)

    def block(self, metric: str, q: np.ndarray, ids: np.ndarray, x: np.ndarray, rows: np.ndarray | None = None, exact=None, also=None, plus: np.ndarray | None = None) -> None:
        """All pairs of the queries ``rows`` (all, if None), of vectors ``q``, and the points, some at a time.

        ``exact(r, c)``: pairs' distances by their places in ``q`` and ``x``, those of
        the metric if None. ``plus``: added to the distances of each point.
        """
        rows = np.arange(len(q)) if rows is None else rows

        def pairs(r, c):
            d = exact_distances(metric, q[r], x[c]) if exact is None else exact(r, c)
            return d if plus is None else d + plus[c]

        for low in range(0, len(x), POINTS):
            part = slice(low, low + POINTS)
            step = max(1, CELLS // len(x[part]))
            for at in range(0, len(q), step):
                rough, off = rough_distances(metric, q[at : at + step], x[part])
                if plus is not None:
                    rough += plus[None, part]
                    off = off + 1e-15 * np.nanmax(np.abs(plus[part]), initial=0)
                shifted = [None if f is None else (lambda r, c, f=f, at=at, low=low: f(r + at, c + low)) for f in (pairs, also)]
                self.take(rows[at : at + step], ids[part], rough, off, *shifted)

    def batches(self, qids: np.ndarray, names, more=()):
        """What was found, as record batches (query id, ``more``'s constants, id, distance, also)."""
        step = max(1, ROWS // self.k)
        for at in range(0, len(qids), step):
            r, c = np.nonzero(self.ids[at : at + step] != NONE)
            r += at
            columns = [qids[r], *(np.full(len(r), v) for v in more), self.ids[r, c], self.d[r, c]]
            if self.also is not None:
                columns.append(self.also[r, c])
            if len(r):
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names=names)
