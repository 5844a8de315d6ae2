"""Projections to three dimensions: principal components, and a learnt encoder."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .knn import knn_graph

PCA_SCALE, UMAP_SCALE = 50.0, 16.0
#: Rows that the encoder is fitted on, its layers, and Adam epochs before and during the graph loss.
SAMPLE, LAYERS, WARM, EPOCHS = 1500, (48, 24, 3), 16, 22
#: Fixed values of the low-dimensional curve 1 / (1 + a d^2b).
A, B = 1.577, 0.895


def pca_fit(points: DataFrame, k: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Mean and components over all points, each component's largest entry positive.

    Sums and cross products are added up by tasks (a d by d matrix from each), so the
    number of points does not reach the driver.
    """

    def moments(batches):
        s = c = None
        n = 0
        for pdf in batches:
            x = np.array(pdf["embedding"].tolist(), np.float64)
            if len(x):
                s, c, n = (x.sum(0), x.T @ x, len(x)) if s is None else (s + x.sum(0), c + x.T @ x, n + len(x))
        if n:
            yield pd.DataFrame({"pos": np.arange(s.size + c.size), "v": np.concatenate([s, c.ravel()]), "n": n})

    rows = points.select("embedding").mapInPandas(moments, "pos long, v double, n long").groupBy("pos").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).orderBy("pos").toPandas()
    if rows.empty:
        raise ValueError("no points")
    total, n = rows["v"].to_numpy(), rows["n"].iat[0]
    d = int((np.sqrt(1 + 4 * len(total)) - 1) / 2)
    mean = total[:d] / n
    _, vectors = np.linalg.eigh(total[d:].reshape(d, d) / n - np.outer(mean, mean))
    parts = vectors[:, ::-1][:, :k].T
    return mean, parts * np.sign(parts[np.arange(len(parts)), np.abs(parts).argmax(1)])[:, None]


def _project(points: DataFrame, act) -> DataFrame:
    def run(batches):
        for pdf in batches:
            if len(pdf):
                y = act(np.array(pdf["embedding"].tolist(), np.float64))
                yield pd.DataFrame({"id": pdf["id"], "x": y[:, 0], "y": y[:, 1], "z": y[:, 2]})

    return points.select("id", "embedding").mapInPandas(run, "id long, x double, y double, z double")


def pca_project(points: DataFrame, mean: np.ndarray, parts: np.ndarray, scale: float = PCA_SCALE) -> DataFrame:
    """(id, x, y, z)."""
    return _project(points, lambda x: (x - mean) @ parts.T * scale)


def fuzzy_edges(points: DataFrame, k: int = 15, least: float = 1e-3) -> DataFrame:
    """(a, b, weight) with a < b: memberships in neighbour graphs, joined as a + b - ab.

    A point's spread is found by 24 bisections so that its memberships sum to log2 k.
    """

    def smooth(batches):
        """Each row is a point with the lists of its neighbours and distances; all of a batch are bisected at once."""
        for b in batches:
            if not b.num_rows:
                continue
            flat = np.asarray(b.column(2).flatten(), np.float64)
            size = np.diff(np.append(b.column(2).offsets.to_numpy()[: b.num_rows] - b.column(2).offsets[0].as_py(), len(flat)))
            place = np.arange(size.max()) < size[:, None]
            d = np.full(place.shape, np.inf)
            d[place] = flat
            near = d.min(1)
            low, high, s = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
            for _ in range(24):
                total = np.exp(-np.maximum(d - near[:, None], 0) / s[:, None]).sum(1)
                more = total > np.log2(max(k, 2))
                low, high = np.where(more, low, s), np.where(more, s, high)
                s = np.where(np.isfinite(high), (low + high) / 2, s * 2)
            w = np.exp(-np.maximum(d - near[:, None], 0) / np.maximum(s, 1e-9)[:, None])[place]
            ids = np.repeat(b.column(0).to_numpy(), size)
            yield pa.RecordBatch.from_arrays([pa.array(ids), b.column(1).flatten(), pa.array(w)], names=["id", "neighbour", "w"])

    lists = knn_graph(points, k).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour", "distance"))).alias("n"))
    one_way = lists.select("id", F.col("n.neighbour").alias("neighbours"), F.col("n.distance").alias("distances")).mapInArrow(smooth, "id long, neighbour long, w double")
    pair = one_way.select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b"), "w")
    joined = pair.groupBy("a", "b").agg((F.sum("w") - F.when(F.count(F.lit(1)) > 1, F.product("w")).otherwise(0.0)).alias("weight"))
    return joined.where(F.col("weight") > least)


def _net(dim: int, seed: int):
    rng, out = np.random.default_rng(seed), []
    for a, b in zip((dim, *LAYERS), LAYERS):
        out.append([rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)])
    return out


def _through(net, x, keep=False):
    acts = [x]
    for i, (w, b) in enumerate(net):
        x = x @ w + b
        if i < len(net) - 1:
            x = np.maximum(x, 0)
        acts.append(x)
    return acts if keep else x


def _back(net, acts, grad):
    out = [None] * len(net)
    for i in range(len(net) - 1, -1, -1):
        out[i] = [acts[i].T @ grad, grad.sum(0)]
        grad = (grad @ net[i][0].T) * (acts[i] > 0 if i else 1)
    return out


def umap_fit(points: DataFrame, k: int = 15, seed: int = 42, sample: int = SAMPLE):
    """Mean and layers of an encoder, fitted on a bounded sample of ``sample`` points.

    Warm start towards the principal components, then the fuzzy graph's cross entropy
    with three negatives for each edge, gradients clipped to 2. Under 8 points the
    network stays untrained.
    """
    some = points.select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(sample)
    got = some.toPandas().sort_values("id")
    x, ids = np.array(got["embedding"].tolist(), np.float64), got["id"].to_numpy()
    mean = x.mean(0)
    x = x - mean
    rng, net = np.random.default_rng(seed), _net(x.shape[1], seed)
    if len(x) < 8:
        return mean, net
    state = [[[np.zeros_like(p), np.zeros_like(p)] for p in layer] for layer in net]
    t = 0

    def step(grads, rate):
        nonlocal t
        t += 1
        for layer, own, g in zip(net, state, grads):
            for j in range(2):
                own[j][0] = 0.9 * own[j][0] + 0.1 * g[j]
                own[j][1] = 0.999 * own[j][1] + 0.001 * g[j] ** 2
                layer[j] -= rate * (own[j][0] / (1 - 0.9**t)) / (np.sqrt(own[j][1] / (1 - 0.999**t)) + 1e-8)

    _, _, vt = np.linalg.svd(x, full_matrices=False)
    goal = x @ vt[:3].T
    goal = np.pad(goal, ((0, 0), (0, 3 - goal.shape[1]))) / max(np.abs(goal).max(), 1e-9)
    for _ in range(WARM):
        for at in range(0, len(x), 64):
            acts = _through(net, x[at : at + 64], True)
            step(_back(net, acts, 2 * (acts[-1] - goal[at : at + 64]) / len(acts[0])), 0.025)
    edges = fuzzy_edges(some, min(k, len(x) - 1)).toPandas().sort_values(["a", "b"])
    a, b, w = np.searchsorted(ids, edges["a"]), np.searchsorted(ids, edges["b"]), edges["weight"].to_numpy()
    for _ in range(EPOCHS):
        order = rng.permutation(len(a))[:640]
        for at in range(0, len(order), 64):
            e = order[at : at + 64]
            far = rng.integers(0, len(x), (len(e), 3)).ravel()
            rows = np.concatenate([a[e], b[e], far])
            acts = _through(net, x[rows], True)
            y, n = acts[-1], len(e)
            grad = np.zeros_like(y)
            diff = y[:n] - y[n : 2 * n]
            d2 = np.maximum((diff**2).sum(1), 1e-9)
            pull = np.clip((2 * A * B * d2 ** (B - 1) / (1 + A * d2**B) * w[e])[:, None] * diff, -2, 2)
            grad[:n] += pull
            grad[n : 2 * n] -= pull
            diff = np.repeat(y[:n], 3, axis=0) - y[2 * n :]
            d2 = (diff**2).sum(1)
            push = np.clip((-2 * B / ((0.001 + d2) * (1 + A * d2**B)))[:, None] * diff, -2, 2)
            grad[:n] += push.reshape(n, 3, 3).sum(1)
            grad[2 * n :] -= push
            step(_back(net, acts, grad / n), 0.015)
    return mean, net


def umap_project(points: DataFrame, model, scale: float = UMAP_SCALE) -> DataFrame:
    """(id, x, y, z)."""
    mean, net = model
    return _project(points, lambda x: _through(net, x - mean) * scale)
