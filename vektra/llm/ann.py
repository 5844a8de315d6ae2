"""Approximate nearest neighbours: multiprobe p-stable hashing, exact reranking.

Unit vectors are projected on random directions and cut into slots; the slots of a
table's projections are a row's bucket. A query looks into its own bucket and into
perturbed ones, in the order of their estimated success; the rows of all tables'
buckets are merged and scored exactly. Cosine and Euclidean nearness order unit vectors
alike. Rows are dealt out once, by their id, whatever the number of tables; a part's
tables are built where its rows are, and queries come to every part.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .shared import cut, matrix, usable

#: Hash tables, projections of each, width of a slot, buckets that a query probes in a table.
TABLES, PROJECTIONS, WIDTH, PROBES = 8, 8, 2.4, 40
#: Rows of a part, rows of it whose tables are built at a time, queries of a block.
PART, CHUNK, BLOCK = 200_000, 50_000, 16_384
#: Rough scores, in single precision, are off by less than this.
ROUGH = 1e-5
#: Share of the rows met from which rough scores of some queries come from one matrix product, of which only those of rows met count.
DENSE = 0.1
SEED = 11


def directions(dim: int, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, seed: int = SEED):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(dim, tables * projections)), rng.random(tables * projections) * width


def slots(unit: np.ndarray, a: np.ndarray, b: np.ndarray, width: float, tables: int) -> np.ndarray:
    """Places of unit vectors on each table's projections, in slots: (row, table, projection)."""
    return ((unit @ a + b) / width).reshape(len(unit), tables, -1)


def keys_of(slot: np.ndarray) -> np.ndarray:
    """One long for the slots of a bucket, along the last axis."""
    mix = np.uint64(0x9E3779B97F4A7C15)
    out = np.zeros(slot.shape[:-1], np.uint64)
    for j in range(slot.shape[-1]):
        out = (out ^ (slot[..., j].astype(np.int64).view(np.uint64) + np.uint64(j + 1))) * mix
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


@lru_cache(maxsize=8)
def perturbation_sets(m: int, count: int) -> np.ndarray:
    """The ``count`` sets of steps with the least expected cost: a row of 0 and 1 for each, over the 2m steps.

    Steps are numbered by their cost, cheapest first. Of a projection's two steps one is
    as far from the cheap end as the other from the dear one, and only one can be taken.
    Sets come off a heap by shifting and expanding the best so far.
    """
    j = np.arange(1, m + 1)
    near = j * (j + 1) / (4 * (m + 1) * (m + 2))
    cost = np.concatenate([near, (1 - j / (m + 1) + j * (j + 1) / (4 * (m + 1) * (m + 2)))[::-1]])
    out, heap = [np.zeros(2 * m)], [(cost[0], (0,))]
    while heap and len(out) < count:
        total, chosen = heapq.heappop(heap)
        if not {2 * m - 1 - i for i in chosen} & set(chosen):
            out.append(np.isin(np.arange(2 * m), chosen).astype(float))
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
    return np.array(out)


def perturbations(near: np.ndarray, probes: int) -> np.ndarray:
    """Steps (-1, 0, 1 for each projection) of the likeliest ``probes`` buckets of each row, best first.

    ``near`` (row, projection): how far above its slot's lower border each projection
    lies, 0 to 1. A set of steps scores the sum of squared distances to the borders it
    crosses. Sets are drawn from 16 times as many of the least expected cost and
    ordered by their own.
    """
    n, m = near.shape
    sets = perturbation_sets(m, 16 * probes)
    both = np.concatenate([near**2, (1 - near) ** 2], axis=1)
    order = np.argsort(both, axis=1, kind="stable")
    cost = np.take_along_axis(both, order, axis=1)
    best = np.argsort(cost @ sets.T, axis=1, kind="stable")[:, :probes]
    one = np.zeros((n, 2 * m, m))  # what each step, in order of cost, changes
    one[np.arange(n)[:, None], np.arange(2 * m)[None], order % m] = np.where(order < m, -1, 1)
    return (sets[best] @ one).astype(np.int64)


class Index:
    """The tables of some rows: rows ordered by bucket, table after table."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, hashing):
        a, b, width, tables = hashing
        self.ids, self.x, self.norm = ids, x, np.sqrt((x * x).sum(axis=1))
        unit = x / self.norm[:, None]
        keys = keys_of(np.floor(slots(unit, a, b, width, tables)))
        self.order = np.ascontiguousarray(np.argsort(keys, axis=0, kind="stable").T)  # (table, row)
        self.keys = np.take_along_axis(keys.T, self.order, axis=1)
        self.unit = unit.astype(np.float32)
        _, times = np.unique(ids, return_counts=True)
        self.repeats = int(times.max()) if len(ids) else 0
        self.met = np.zeros(len(ids), bool)

    def ranges(self, probed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the probed buckets of each query (query, table, probe) begin and end in ``order``, as one line."""
        first, last = np.empty(probed.shape, np.int64), np.empty(probed.shape, np.int64)
        for t, keys in enumerate(self.keys):
            first[:, t] = np.searchsorted(keys, probed[:, t]) + t * len(keys)
            last[:, t] = np.searchsorted(keys, probed[:, t], side="right") + t * len(keys)
        return first.reshape(len(probed), -1), last.reshape(len(probed), -1)

    def candidates(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The rows of all buckets of one query, each once, ascending."""
        size = last - first
        end = np.cumsum(size)
        at = np.arange(end[-1]) + np.repeat(first - (end - size), size)
        self.met[self.order.ravel()[at]] = True
        found = np.flatnonzero(self.met)
        self.met[found] = False
        return found

    def rough(self, q: np.ndarray, met: float) -> list[np.ndarray | None]:
        """Rough scores of all rows for each unit query, where enough of them are met; else None."""
        return list(q.astype(np.float32) @ self.unit.T) if met > DENSE * len(self.ids) else [None] * len(q)

    def best(self, qid: int, q: np.ndarray, rows: np.ndarray, k: int, scored: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` nearest of ``rows`` but those of the query's id, ties to the smaller id."""
        rows = rows[self.ids[rows] != qid]
        norm = np.sqrt((q * q).sum())
        most = k * self.repeats
        if len(rows) > most:
            rough = self.unit[rows] @ (q / norm).astype(np.float32) if scored is None else scored[rows]
            rows = rows[rough >= np.partition(rough, len(rough) - most)[len(rough) - most] - 2 * ROUGH]
        score = (self.x[rows] * q).sum(axis=1) / (self.norm[rows] * norm)
        order = np.lexsort((self.ids[rows], -score))
        ids, score = self.ids[rows][order], score[order]
        if self.repeats > 1:
            _, once = np.unique(ids, return_index=True)
            once.sort()
            ids, score = ids[once], score[once]
        return ids[:k], score[:k]


def _search(k: int, hashing, probes: int | None, chunk: int):
    """Over rows sorted by (part, block, kind): the best of each part for the queries (kind 0) among its rows (kind 1).

    ``probes`` None: every row of the part is a candidate. A task holds the queries of
    one block and ``chunk`` rows with their tables at a time.
    """
    a, b, width, tables = hashing

    def found(index, qid, q):
        out = []
        for at in range(0, len(qid), 256):
            ids, x = qid[at : at + 256], q[at : at + 256]
            unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
            if probes is None:
                met = [np.arange(len(index.ids))] * len(ids)
                scored = index.rough(unit, len(index.ids))
            else:
                place = slots(unit, a, b, width, tables)
                base = np.floor(place)
                steps = perturbations((place - base).reshape(-1, place.shape[2]), probes).reshape(*place.shape[:2], -1, place.shape[2])
                first, last = index.ranges(keys_of(base[:, :, None] + steps))
                met = (index.candidates(f, e) for f, e in zip(first, last))
                scored = index.rough(unit, (last - first).sum(axis=1).mean())
            got = [index.best(i, v, rows, k, s) for i, v, rows, s in zip(ids, x, met, scored)]
            out += [(np.full(len(g), i), g, s) for i, (g, s) in zip(ids, got)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query_id", "vec_id", "score"])

    def run(batches):
        group, asked, rows, n = None, [], [], 0

        def flush():
            nonlocal rows, n
            if rows and asked:
                ids, x = (np.concatenate(c) for c in zip(*rows))
                qid, q = (np.concatenate(c) for c in zip(*asked))
                yield found(Index(ids, x, hashing), qid, q)
            rows, n = [], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            which = np.stack([batch.column(i).to_numpy() for i in range(3)])
            ids, x = batch.column(3).to_numpy(), matrix(batch.column(4), batch.num_rows)
            edges = [0, *(np.flatnonzero((which[:, 1:] != which[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for s, e in zip(edges, edges[1:]):
                here = (int(which[0, s]), int(which[1, s]))
                if here != group:
                    yield from flush()
                    group, asked = here, []
                if which[2, s] == 0:
                    asked.append((ids[s:e], x[s:e]))
                    continue
                while s < e:
                    take = min(e - s, chunk - n)
                    rows.append((ids[s : s + take], x[s : s + take]))
                    s, n = s + take, n + take
                    if n == chunk:
                        yield from flush()
        yield from flush()

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, probes: int = PROBES, part: int = PART, chunk: int = CHUNK, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query its ``k`` nearest rows found, by cosine.

    A query is never its own answer (rows of its id are left out); ties go to the
    smaller id; scores are of the original components, in double precision. Rows whose
    id or vector is null, or whose vector is zero, holds components that are null or not
    finite, or has another length than most usable rows have (of lengths as frequent the
    smallest), take no part. Ids are cast to long; ids that are no numbers are an error
    or null, as the session casts. An id counts once for a query, by its nearest vector.
    Other columns are not read.

    Rows are shuffled once for each block of ``block`` queries, queries once for each
    part of about ``part`` rows; a task builds tables over ``chunk`` rows at a time, so
    its memory is bounded, and copies, large groups and repeated ids are spread like any
    other rows. Queries that met fewer than ``k`` ids are compared with all rows.
    """
    kind = "float" if isinstance(vectors.schema[vector_col].dataType.elementType, FloatType) else "double"
    pick = lambda df: df.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    spark = vectors.sparkSession
    usual = pick(vectors).groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if usual is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total = usual
    rows = pick(vectors).where(F.size("v") == dim)
    asked = pick(queries).where(F.size("v") == dim).dropDuplicates()
    blocks = max(1, -(-asked.count() // block))
    parts = max(-(-total // part), min(spark.sparkContext.defaultParallelism, -(-total // 2048)))
    hashing = (*directions(dim, tables, projections, width, seed), width, tables)

    def met(some: DataFrame, blocks: int, probes: int | None) -> DataFrame:
        # The input's partition spreads rows of one id; each row has one place, however often a task runs.
        spread = F.pmod(F.xxhash64("vec_id") + 7919 * F.spark_partition_id(), F.lit(parts))
        stored = rows.select(spread.cast("int").alias("part"), "vec_id", "v").select("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "vec_id", "v")
        probed = some.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "vec_id", "v")
        dealt = stored.unionByName(probed).repartition(4 * parts * blocks, "part", "block").sortWithinPartitions("part", "block", "kind")
        return _merged(dealt.mapInArrow(_search(k, hashing, probes, chunk), "query_id long, vec_id long, score double"), k)

    found = cut(met(asked, blocks, probes))
    enough = found.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("_q"))
    few = cut(asked.join(enough, F.col("vec_id") == F.col("_q"), "left_anti"))
    n_few = few.count()
    if n_few:
        more = met(few, max(1, -(-n_few // block)), None)
        found = found.join(few.select(F.col("vec_id").alias("_q")).distinct(), F.col("query_id") == F.col("_q"), "left_anti").unionByName(more)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _merged(found: DataFrame, k: int) -> DataFrame:
    """Candidates of all parts, each id once, ranked."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k)
