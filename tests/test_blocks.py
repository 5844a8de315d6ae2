"""Exact scans hold a bounded number of pairs, hand on k rows a task and query, and do not depend on blocks."""

from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from vektra.operators import knn, project3d
from vektra.plans import catalogue

VEC = "id long, embedding array<double>"


def frame(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], VEC)


def asked(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "query_id long, q array<double>")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_few_pairs_are_held(monkeypatch):
    """A block of many queries and points is worked off in parts, with the results of brute force; ties go to the smaller id."""
    from vektra.operators import blocks

    monkeypatch.setattr(blocks, "CELLS", 500)
    monkeypatch.setattr(blocks, "PAIRS", 64)
    seen, rough = [], blocks.rough_distances

    def spied(*args):
        seen.append(len(args[1]) * len(args[2]))
        return rough(*args)

    monkeypatch.setattr(blocks, "rough_distances", spied)
    x = np.random.default_rng(1).integers(0, 3, (400, 3)).astype(float)  # 27 vectors, some 15 copies of each
    for metric in ("l2", "ip", "cosine"):
        best = blocks.Nearest(50, 7)
        for at in (200, 0):
            best.block(metric, x[:50], np.arange(at, at + 200), x[at : at + 200])
        d = blocks.every_distance([metric], x[:50], x)[0]
        order = np.lexsort((np.broadcast_to(np.arange(400), d.shape), d), axis=1)[:, :7]
        assert (best.ids == order).all() and (best.d == np.take_along_axis(d, order, axis=1)).all()
    assert max(seen) <= 500


@pytest.fixture()
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("search", [knn.knn, knn.search_fp16])
def test_a_task_hands_on_its_best_only(spark, small_batches, monkeypatch, search):
    """Not those of each of its batches."""
    x = np.random.default_rng(2).normal(size=(600, 8))
    counted, top_k = [], knn.top_k
    monkeypatch.setattr(knn, "top_k", lambda rows, *a, **o: counted.append(rows.count()) or top_k(rows, *a, **o))
    search(frame(spark, x).coalesce(1), asked(spark, x[:5]), 4).collect()
    assert max(counted) <= spark.sparkContext.defaultParallelism * 5 * 4


def test_searches_make_no_row_a_pair(spark):
    """The registered exact searches cut each task's rows before they leave Python."""
    for name in ("knn_exact_l2", "knn_exact_cosine", "knn_exact_ip", "knn_filtered", "score_threshold", "sharded_merge", "merge_topk_dedup"):
        assert "Join Inner" not in plan(catalogue.queries()[name](spark, "/root/testdata/sf0.001")), name


def test_pairs_come_from_blocks(spark):
    """All pairs are needed; they come from blocks, with no expression evaluated for each component of each pair."""
    for name in ("distance_matrix", "score_similarity", "score_client", "score_relevance", "score_retriever"):
        assert "Join" not in plan(catalogue.queries()[name](spark, "/root/testdata/sf0.001")), name
    x = np.random.default_rng(3).normal(size=(40, 8))
    got = {(r.query_id, r.id): r.distance for r in knn.pairs(frame(spark, x), asked(spark, x[:6])).collect()}
    assert got == {(i, j): reduce(float.__add__, ((x[i] - x[j]) ** 2).tolist()) for i in range(6) for j in range(40)}


def test_added_column(spark):
    x = np.random.default_rng(4).normal(size=(60, 4))
    points = frame(spark, x).withColumn("more", F.col("id") % 3)
    got = {(r.query_id, r["rank"]): r.id for r in knn.knn(points, asked(spark, x[:5]), 4, plus="more").collect()}
    d = ((x[:5, None] - x[None]) ** 2).sum(2) + np.arange(60) % 3
    assert got == {(i, j + 1): int(n) for i in range(5) for j, n in enumerate(d[i].argsort()[:4])}


def test_fuzzy_graph_in_batches(spark):
    """Spreads are found for all points of a batch at once: no Python group for each point."""
    points = frame(spark, np.random.default_rng(5).normal(size=(60, 4)))
    edges = project3d.fuzzy_edges(points, 5)
    assert "FlatMapGroupsInPandas" not in plan(edges)
    assert edges.where("weight > 0.999999").count() >= 30  # each point's nearest
