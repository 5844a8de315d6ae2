"""Inverted-file search: coarse probe, three compressed scans, exact reranking, telemetry.

Stage one ranks by squared L2 whatever the metric (binary codes convert their
estimate); unless ``rerank_k`` is 1, the shortlist is rescored with full vectors.

Queries, centroids and the cells that each query probes are broadcast in blocks of a
bounded size. Codes are dealt over the tasks, full vectors beside them; a task meets
each cell's codes with the queries that probe it and hands on its own shortlist of each
query, with real distances, so neither pairs nor vectors travel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import check_k, distance, metric_name, squared_l2
from . import train
from .blocks import CELLS, POINTS, Nearest, exact_distances, in_order
from .knn import BLOCK_BYTES, dealt, in_blocks, list_matrix, permitted, shared_queries, top_k
from .lineage import settle

MOST_SHORTLIST = 10_240


def shortlist_size(k: int, rerank_k: int | None, most: int = MOST_SHORTLIST) -> int | None:
    """Rows that stage one hands on: 0 stands for k, fewer than k become k, more than ``most`` become that; None stands for all."""
    return None if rerank_k is None else min(max(rerank_k or k, k), most)


def ivf_probe(queries: DataFrame, centroids: DataFrame, nprobe: int) -> DataFrame:
    """(query_id, q, cluster_id, centroid, probe, centroid_distance): the nearest cells, by squared L2 always."""
    pairs = in_blocks(queries, lambda q: train.small(centroids, train.MOST_LISTS).join(q).withColumn("centroid_distance", squared_l2(F.col("q"), F.col("centroid"))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("centroid_distance", "cluster_id"))
    return pairs.withColumn("probe", rank).where(F.col("probe") <= max(nprobe, 1)).select("query_id", "q", "cluster_id", "centroid", "probe", "centroid_distance")


def rerank_exact(shortlist: DataFrame, points: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """Rescores (query_id, id) with full vectors and the real metric.

    A shortlist within BLOCK_BYTES goes to the points, which then do not move; a larger
    one meets them by id. The vectors that are left meet their queries.
    """
    short = settle(shortlist.select("query_id", "id"))
    near = F.broadcast(short) if short.count() * 64 <= BLOCK_BYTES else short
    full = points.select("id", "embedding").join(near, "id").join(queries, "query_id")
    return top_k(full.select("query_id", "id", distance(metric, F.col("q"), F.col("embedding")).alias("distance")), k).select("query_id", "rank", "id", "distance")


class _Cell:
    """What stage one does with a cell's codes and the queries that probe it: squared L2 of query residuals and decoded ones."""

    def __init__(self, decode, exact=None):
        self.decode, self.exact = decode, exact

    def block(self, best: Nearest, rows, q, centroid, ids, columns, also) -> None:
        res, back = q[rows] - centroid, self.decode(columns)
        own = None if self.exact is None else lambda r, c: self.exact(res[r], back[c])
        best.block("l2", res, ids, back, rows, own, also)


class _Exact:
    """In place of stage one where all that is probed is rescored: what codes estimate would decide nothing."""

    def __init__(self, metric: str):
        self.metric = metric

    def block(self, best: Nearest, rows, q, centroid, ids, x, also) -> None:
        best.block(self.metric, q[rows], ids, x, rows)


def cell_scan(rows: DataFrame, queries: DataFrame, centroids: DataFrame, nprobe: int, k: int, stage, columns=(), metric: str | None = None) -> DataFrame:
    """(query_id, id, distance[, real]): the k nearest of each task among the probed cells' rows (id, cluster_id, ``columns``, embedding).

    ``stage.block`` scans a cell's rows; it gets ``columns`` as Arrow arrays, or the
    vectors where there are none. With ``metric``, ``real`` is a pair's distance by full vectors.
    """
    spark = rows.sparkSession
    cells = spark.sparkContext.broadcast(train.centroid_matrix(centroids))
    names = ["query_id", "id", "distance", *(["real"] if metric else [])]
    full = bool(metric) or not columns

    def act(block: DataFrame) -> DataFrame:
        shared = shared_queries(block)
        probes = ivf_probe(block, centroids, nprobe).select(F.col("query_id").cast("long"), F.col("cluster_id").cast("int")).toArrow()
        probed = spark.sparkContext.broadcast(tuple(probes.column(i).to_numpy() for i in (0, 1)))

        def run(batches):
            (qids, q), (numbers, centres), (by, to) = shared.value, cells.value, probed.value
            best = Nearest(len(qids), k, bool(metric))
            by = np.searchsorted(qids, by)
            order = np.argsort(to, kind="stable")
            by, to = by[order], to[order]
            for batch in batches:
                if not batch.num_rows or not len(qids):
                    continue
                of = batch.column(1).to_numpy()
                for cell in np.unique(of).tolist():
                    asking = by[np.searchsorted(to, cell) : np.searchsorted(to, cell, side="right")]
                    if not len(asking):
                        continue
                    part = batch.filter(pa.array(of == cell))
                    ids, x = part.column(0).to_numpy(), list_matrix(part.column(part.num_columns - 1)) if full else None
                    also = (lambda r, c, rows=asking, x=x: exact_distances(metric, q[rows[r]], x[c])) if metric else None
                    stage.block(best, asking, q, centres[np.searchsorted(numbers, cell)], ids, [part.column(2 + i) for i in range(len(columns))] or x, also)
            yield from best.batches(qids, names)

        own = [F.col("id").cast("long").alias("id"), F.col("cluster_id").cast("int").alias("cluster_id"), *columns, *([F.col("embedding").cast("array<double>").alias("embedding")] if full else [])]
        return dealt(rows.select(*own), "cluster_id").mapInArrow(run, "query_id long, id long, distance double" + (", real double" if metric else ""))

    return in_blocks(queries, act, more=16 + 24 * k + 12 * nprobe)


# In the three searches ``allowed`` holds the ids (column ``id``) that may be results, None for all: codes of others are
# not scanned. ``rerank_k`` None reranks all that is scanned.


def _search(points, queries, centroids, codes, columns, stage, k, nprobe, rerank_k, metric, allowed) -> DataFrame:
    codes, metric, k, nprobe = permitted(codes, allowed), metric_name(metric), check_k(k), max(nprobe, 1)
    vectors = points.select("id", "embedding")
    if rerank_k == 1:
        found = cell_scan(codes, queries, centroids, nprobe, k, stage(), columns)
        return top_k(found, k).select("query_id", "rank", "id", "distance")
    size = shortlist_size(k, rerank_k)
    if size is None:
        return probed_knn(points, codes, queries, centroids, k, nprobe, metric)
    found = cell_scan(codes.join(vectors, "id"), queries, centroids, nprobe, size, stage(), columns, metric)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    short = found.withColumn("_r", rank).where(F.col("_r") <= size)
    return top_k(short.select("query_id", "id", F.col("real").alias("distance")), k).select("query_id", "rank", "id", "distance")


def probed_knn(points: DataFrame, assigned: DataFrame, queries: DataFrame, centroids: DataFrame, k: int = 10, nprobe: int = 8, metric: str = "l2") -> DataFrame:
    """(query_id, rank, id, distance): the nearest of all points of the probed cells, by full vectors. ``assigned``: (id, cluster_id)."""
    rows = assigned.select("id", "cluster_id").join(points.select("id", "embedding"), "id")
    found = cell_scan(rows, queries, centroids, nprobe, check_k(k), _Exact(metric_name(metric)))
    return top_k(found, k).select("query_id", "rank", "id", "distance")


def search_pq(points, queries, centroids, codes, codebook, m, k=10, nprobe=8, rerank_k=32, metric="l2", allowed=None) -> DataFrame:
    """Product-quantised search: the parts of a probe's residual against the words that a code stands for."""

    def stage():
        words = train.code_words(codebook, m)
        width = max((w.shape[1] for _, w in words if len(w)), default=1)
        table = np.full((m, max((int(c.max()) + 1 for c, _ in words if len(c)), default=1), width), np.inf)
        for i, (c, w) in enumerate(words):
            table[i, c] = w
        shared = points.sparkSession.sparkContext.broadcast(table)

        def decode(columns):
            codes = list_matrix(columns[0]).astype(np.int64)
            return shared.value[np.arange(m)[None], codes].reshape(len(codes), -1)

        return _Cell(decode, lambda q, x: in_order(np.cumsum(((q - x) ** 2).reshape(len(q), m, -1), axis=2)[:, :, -1]))

    return _search(points, queries, centroids, codes, ["codes"], stage, k, nprobe, rerank_k, metric, allowed)


def search_sq8(points, queries, centroids, codes, params, k=10, nprobe=8, rerank_k=32, metric="l2", allowed=None) -> DataFrame:
    """Search over 8-bit scalar codes."""

    def stage():
        low, scale = (np.array(v, np.float64) for v in train.packed(params).first())
        return _Cell(lambda columns: list_matrix(columns[0]) * scale + low)

    return _search(points, queries, centroids, codes, ["codes"], stage, k, nprobe, rerank_k, metric, allowed)


class _Binary:
    """Squared L2 estimated from sign bits and query residuals of 4 bits a component, converted by the metric."""

    def __init__(self, dim: int, metric: str):
        self.signs, self.metric = train.rotation_signs(dim), metric

    def block(self, best: Nearest, rows, q, centroid, ids, columns, also) -> None:
        p, q = self.signs.shape[1], q[rows]
        bits = np.unpackbits(np.frombuffer(b"".join(columns[0].to_pylist()), np.uint8).reshape(len(ids), -1), axis=1)[:, :p].astype(np.float32)
        norm, rescale, pop, whole = (np.asarray(c.to_numpy(zero_copy_only=False), np.float64) for c in columns[1:])
        v = train.rotate(q, self.signs) - train.rotate(centroid[None], self.signs)
        low, high = v.min(1), v.max(1)
        step = np.where(high - low <= 1e-12, 0.0, (high - low) / 15)
        u = np.clip(np.rint((v - low[:, None]) / np.where(step > 0, step, 1)[:, None]), 0, 15).astype(np.float32)
        apart, q_norm, total = ((q - centroid) ** 2).sum(1), (q * q).sum(1), u.sum(1, dtype=np.float64)
        for at in range(0, len(ids), POINTS):
            part = slice(at, at + POINTS)
            tile = max(1, CELLS // len(ids[part]))
            for i in range(0, len(q), tile):
                r = slice(i, i + tile)
                # Products of small whole numbers, which single precision holds exactly.
                inner = step[r, None] * (2.0 * (u[r] @ bits[part].T).astype(np.float64) - total[r, None]) + low[r, None] * (2 * pop[part] - p)[None]
                est = apart[r, None] + norm[None, part] - 2 * (rescale[None, part] * inner)
                if self.metric == "ip":
                    est = -0.5 * (q_norm[r, None] + whole[None, part] - est)
                elif self.metric == "cosine":
                    est = 0.5 * est
                best.take(rows[r], ids[part], est, 0.0, None, None if also is None else lambda a, b, i=i, at=at: also(a + i, b + at))


def search_rabitq(points, queries, centroids, codes, k=10, nprobe=8, rerank_k=32, metric="l2", allowed=None) -> DataFrame:
    """Search over rotated sign bits."""

    def stage():
        first = centroids.select(F.size("centroid")).first()
        return _Binary(first[0] if first else 1, metric_name(metric))

    return _search(points, queries, centroids, codes, ["bits", "res_norm_sq", "rescale", "popcount", "vec_norm_sq"], stage, k, nprobe, rerank_k, metric, allowed)


def probe_telemetry(result: DataFrame, probes: DataFrame, assigned: DataFrame) -> DataFrame:
    """For each probed cell: rank, distance, list length, and which results it gave."""
    length = assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("list_len"))
    hits = result.join(assigned.select("id", "cluster_id"), "id").groupBy("query_id", "cluster_id").agg(F.min("distance").alias("best_distance"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda e: e["id"]).alias("result_ids"))
    rows = probes.select("query_id", "probe", "cluster_id", "centroid_distance").join(length, "cluster_id", "left").join(hits, ["query_id", "cluster_id"], "left")
    return rows.select("query_id", "probe", "cluster_id", "centroid_distance", F.coalesce("list_len", F.lit(0)).cast("long").alias("list_len"), "best_distance", F.coalesce("result_ids", F.expr("cast(array() as array<bigint>)")).alias("result_ids"))


def pq_distortion(res: DataFrame, points: DataFrame, codes: DataFrame, codebook: DataFrame, m: int, centroids: DataFrame, limit: int = 1000) -> DataFrame:
    """(cluster_id, samples, distortion): mean squared error over squared norm, over every n-th member of a cell.

    The step makes ``limit`` samples of a cell at most; empty cells have distortion 0.
    """
    sizes = res.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("_n"))
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy("id")) - 1
    some = res.select("id", "cluster_id").withColumn("_r", place).join(sizes, "cluster_id").where(F.col("_r") % F.ceil(F.col("_n") / limit) == 0).select("id")
    word = codebook.select("m", "code", F.col("sub").alias("word"))
    parts = train.sub_vectors(res.join(some, "id", "left_semi"), m).join(train.coded(codes).select("id", "m", "code"), ["id", "m"]).join(word, ["m", "code"])
    error = parts.groupBy("id", "cluster_id").agg(F.sum(squared_l2(F.col("sub"), F.col("word"))).alias("e"))
    norm = points.select("id", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")).alias("n"))
    each = error.join(norm, "id").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("samples"), F.avg(F.col("e") / F.greatest("n", F.lit(1e-12))).alias("distortion"))
    return centroids.select("cluster_id").join(each, "cluster_id", "left").select("cluster_id", F.coalesce("samples", F.lit(0)).cast("long").alias("samples"), F.coalesce("distortion", F.lit(0.0)).alias("distortion"))
