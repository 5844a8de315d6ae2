"""Proximity graphs: built and searched shard by shard, merged by top-k.

A shard holds a bounded number of points, so a graph is one task's work; a search goes
to every shard, and the best of all shards win. Graphs follow squared L2 whatever the
metric; search distances follow the metric.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import EPSILON, check_k, metric_name
from .knn import list_matrix, top_k
from .lineage import settle

SHARD_ROWS = 20_000
#: Rows from which a search gives out what it holds.
GIVEN = 16_384
MOST_BEAM, MOST_SEEDS = 256, 32
EDGES = "shard int, id long, embedding array<double>, neighbours array<long>, entry boolean, seed boolean"


def distances(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of a query's steps, of few pairs each."""
    if metric == "l2":
        return ((q - x) ** 2).sum(1)
    dots = (q * x).sum(1)
    return -dots if metric == "ip" else 1 - dots / (np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1)) + EPSILON)


def sharded(points: DataFrame, rows: int = SHARD_ROWS) -> DataFrame:
    """Points with a ``shard`` by a hash of the id, about ``rows`` points in each."""
    n = max(1, -(-points.count() // rows))
    return points.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("shard"), F.col("id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))


def select_neighbours(x: np.ndarray, base: int, candidates: np.ndarray, near: np.ndarray, most: int, backfill: bool = True) -> list[int]:
    """Candidates (nearest first) that no kept one is strictly closer to than the base; then nearest rejected ones."""
    kept, left = [], []
    for c, d in zip(candidates, near):
        if len(kept) == most:
            break
        if kept and (((x[kept] - x[c]) ** 2).sum(1) < d).any():
            left.append(int(c))
        else:
            kept.append(int(c))
    return kept + left[: most - len(kept)] if backfill else kept


def _nearest(x: np.ndarray, rows: np.ndarray, k: int, before_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of all points (of those before a row) for each row, as numbers and distances; inf where there are fewer."""
    sq = (x * x).sum(1)
    d = np.maximum(sq[rows][:, None] + sq[None] - 2 * x[rows] @ x.T, 0)
    d[np.arange(len(rows)), rows] = np.inf
    if before_only:
        d[np.arange(len(x))[None] > rows[:, None]] = np.inf
    k = min(k, len(x) - 1)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return order, np.take_along_axis(d, order, axis=1)


def _link_back(x, adjacency: list[list[int]], node: int, most: int) -> None:
    for other in list(adjacency[node]):
        if node in adjacency[other]:
            continue
        adjacency[other].append(node)
        if len(adjacency[other]) > most:
            cand = np.array(adjacency[other])
            d = ((x[cand] - x[other]) ** 2).sum(1)
            order = np.argsort(d, kind="stable")
            adjacency[other] = select_neighbours(x, other, cand[order], d[order], most, backfill=False)


def build_navigable(x: np.ndarray, m: int, ef: int) -> list[list[int]]:
    """Single-layer graph: each node links to a diverse choice of its nearest earlier nodes, and they back."""
    adjacency: list[list[int]] = [[] for _ in range(len(x))]
    for at in range(1, len(x), 512):
        rows = np.arange(at, min(at + 512, len(x)))
        near, d = _nearest(x, rows, max(ef, m + 1), True)
        for i, node in enumerate(rows):
            fine = np.isfinite(d[i])
            adjacency[node] = select_neighbours(x, int(node), near[i][fine], d[i][fine], m)
            _link_back(x, adjacency, int(node), 2 * m)
    return adjacency


def build_fixed_degree(x: np.ndarray, degree: int, base: list[list[int]]) -> list[list[int]]:
    """Fixed-degree graph from nearest-neighbour lists joined with ``base``'s edges.

    A quarter of the places (two at least) is kept for the farthest base edges as
    bridges; reverse edges replace the farthest where they are closer.
    """
    n, adjacency = len(x), []
    bridges = max(2, degree // 4)
    for at in range(0, n, 512):
        rows = np.arange(at, min(at + 512, n))
        near, _ = _nearest(x, rows, min(2 * degree, max(n - 1, 1)), False)
        for i, node in enumerate(rows):
            cand = np.array(list(dict.fromkeys([*near[i].tolist(), *base[node]])), np.int64)
            d = ((x[cand] - x[node]) ** 2).sum(1)
            order = np.argsort(d, kind="stable")
            kept = select_neighbours(x, int(node), cand[order], d[order], degree)
            far = [c for c in sorted(base[node], key=lambda c: -((x[c] - x[node]) ** 2).sum()) if c not in kept[: degree - bridges]][:bridges]
            if len(kept) > degree - bridges and far:
                kept = kept[: degree - len(far)] + far
            adjacency.append(kept)
    for node in range(n):
        for other in list(adjacency[node]):
            if node not in adjacency[other]:
                if len(adjacency[other]) < degree:
                    adjacency[other].append(node)
                else:
                    d = ((x[adjacency[other]] - x[other]) ** 2).sum(1)
                    worst = int(d.argmax())
                    if ((x[node] - x[other]) ** 2).sum() < d[worst]:
                        adjacency[other][worst] = node
    return adjacency


def build(points: DataFrame, kind: str = "hnsw", m: int = 32, ef_construction: int = 128, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Graph rows (shard, id, embedding, neighbours, entry, seed), written once.

    ``hnsw``: a navigable graph of up to twice ``m`` links. ``cagra``: a graph of fixed
    degree, the next power of two from ``m`` within 16 and 64, with up to 32 seeds.
    """
    degree = min(max(1 << (m - 1).bit_length(), 16), 64)

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        x, ids = np.array(pdf["embedding"].tolist(), np.float64), pdf["id"].to_numpy()
        adjacency = build_navigable(x, max(m, 4), ef_construction)
        if kind == "cagra":
            adjacency = build_fixed_degree(x, degree, adjacency)
        entry = int(((x - x.mean(0)) ** 2).sum(1).argmin())
        seed = np.zeros(len(x), bool)
        seed[:: max(1, len(x) // min(len(x), MOST_SEEDS))] = True
        seed[entry] = True
        return pdf.assign(neighbours=[ids[a].tolist() for a in adjacency], entry=np.arange(len(x)) == entry, seed=seed)

    return settle(sharded(points, shard_rows).groupBy("shard").applyInPandas(make, EDGES))


def beam(x, adjacency, starts, q, metric, k, ef, allowed=None, trace=None):
    """Numbers and distances of the k best nodes that a beam of width ``ef`` finds.

    Expands the best unvisited entry, twice ``ef`` times at most. With ``allowed``, a
    second list keeps the best allowed nodes; others are only walked through.
    """
    dist = lambda rows: distances(metric, np.broadcast_to(q, (len(rows), len(q))), x[rows])
    rows = np.array(starts)
    queue = sorted(zip(dist(rows).tolist(), rows.tolist()))[:ef]
    seen, done = set(rows.tolist()), set()
    valid = [e for e in queue if allowed is None or allowed[e[1]]]
    for step in range(2 * ef):
        nxt = next((e for e in queue if e[1] not in done), None)
        if nxt is None:
            break
        done.add(nxt[1])
        fresh = [n for n in adjacency[nxt[1]] if n not in seen]
        seen.update(fresh)
        if fresh:
            found = list(zip(dist(np.array(fresh)).tolist(), fresh))
            queue = sorted(queue + found)[:ef]
            if allowed is None:
                valid = queue
            else:
                valid = sorted(valid + [e for e in found if allowed[e[1]]])[:ef]
            if trace is not None:
                trace += [(step, nxt[1], n, d) for d, n in found]
        if trace is not None:
            trace.append((step, nxt[1], -1, nxt[0]))
    return valid[:k]


def search(graph: DataFrame, queries: DataFrame, k: int = 10, ef: int = 64, metric: str = "l2", kind: str = "hnsw", allowed: DataFrame | None = None, trace: bool = False) -> DataFrame:
    """(query_id, rank, id, distance), or trace rows (query_id, shard, step, from_id, to_id, distance).

    ``ef`` is raised to k and held within 256. ``allowed``: ids (column ``id``) that may
    be results. Every shard meets every query: a task reads a shard's graph, then its
    queries one batch after another, and gives out what it found as it goes, so it holds
    one graph and a bounded number of rows. A trace row with ``to_id`` null marks an expansion.
    """
    metric, k = metric_name(metric), check_k(k)
    ef = min(max(ef, k, 1), MOST_BEAM)
    rows = graph
    if allowed is not None:
        marks = allowed.select(F.col("id").cast("long").alias("_a")).distinct()
        rows = graph.join(marks, F.col("id") == F.col("_a"), "left").withColumn("ok", F.col("_a").isNotNull()).drop("_a")
    else:
        rows = graph.withColumn("ok", F.lit(True))
    asked = graph.select("shard").distinct().join(queries.select(F.col("query_id").cast("long").alias("id"), F.col("q").cast("array<double>").alias("embedding")))
    names = ["query_id", "shard", "step", "from_id", "to_id", "distance"] if trace else ["query_id", "id", "distance"]
    kinds = {"shard": pa.int32(), "step": pa.int32(), "distance": pa.float64()}

    def given(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, zip(*out))], names=names)

    def read(shard):
        g = pa.Table.from_batches(shard).combine_chunks()
        ids, x = g["id"].to_numpy(), list_matrix(g["embedding"].combine_chunks())
        adjacency = [np.searchsorted(ids, a).tolist() for a in g["neighbours"].to_numpy()]
        starts = np.flatnonzero(g["seed" if kind == "cagra" else "entry"].to_numpy())
        ok = g["ok"].to_numpy()
        return ids, x, adjacency, starts, None if ok.all() else ok

    def run(batches):
        number, parts, ready, out = None, [], None, []
        for batch in batches:
            key = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
            edges = np.flatnonzero(np.diff(key)) + 1
            for low, high in zip([0, *edges], [*edges, len(key)] if len(key) else []):
                shard, query = divmod(int(key[low]), 2)
                part = batch.slice(low, high - low)
                if shard != number:
                    number, parts, ready = shard, [], None
                if not query:
                    parts.append(part)
                    continue
                ready = ready or (read(parts) if parts else None)
                if ready is None:
                    continue
                parts, (ids, x, adjacency, starts, ok) = [], ready
                for qid, q in zip(part.column(2).to_pylist(), list_matrix(part.column(3))):
                    walked = [] if trace else None
                    found = beam(x, adjacency, starts, q, metric, k, ef, ok, walked)
                    if trace:
                        out += [(qid, number, s, int(ids[a]), int(ids[b]) if b >= 0 else None, d) for s, a, b, d in walked]
                    else:
                        out += [(qid, int(ids[n]), d) for d, n in found]
                    if len(out) >= GIVEN:
                        yield given(out)
                        out = []
        if out:
            yield given(out)

    columns = ["shard", "side", "id", "embedding", "neighbours", "entry", "seed", "ok"]
    both = rows.withColumn("side", F.lit(0)).select(*columns).unionByName(asked.withColumn("side", F.lit(1)), allowMissingColumns=True)
    met = both.repartition("shard").sortWithinPartitions("shard", "side", "id").select(*columns)
    found = met.mapInArrow(run, "query_id long, shard int, step int, from_id long, to_id long, distance double" if trace else "query_id long, id long, distance double")
    return found if trace else top_k(found, k).select("query_id", "rank", "id", "distance")


def steps_until(trace: DataFrame, step: int) -> DataFrame:
    """What a trace shows up to a step."""
    return trace.where(F.col("step") <= step)
