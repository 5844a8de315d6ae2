"""Inverted-file scans make no row a pair, and what they find is right whatever the blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vektra.operators import ivf, knn, train
from vektra.operators.lineage import settle
from vektra.plans import catalogue

DIR = "/root/testdata/sf0.001"
QUERIES = ["adc_search", "rerank_exact", "sq8_search", "ivf_pq_exhaustive", "ivf_sq8_exhaustive", "ivf_rabitq_exhaustive", "ivf_pq_filtered", "ivf_sq8_filtered", "ivf_rabitq_filtered", "rabitq_search", "ivf_pq_search"]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", QUERIES)
def test_codes_meet_probes_in_blocks(spark, name):
    """The scan's rows go to the ranking windows at once: no join of codes and probes, none of a shortlist and vectors, comes between."""
    lines = plan(catalogue.queries()[name](spark, DIR)).splitlines()
    scan = next(i for i, line in enumerate(lines) if "MapInArrow run" in line)
    assert not any("Join" in line for line in lines[:scan])


@pytest.fixture(scope="module")
def index(spark):
    x = np.random.default_rng(7).normal(size=(400, 8)) * (1 + np.arange(400) % 3)[:, None]
    x[100:130] = x[5]  # copies
    points = spark.createDataFrame([(i, r.tolist(), i % 4) for i, r in enumerate(x)], "id long, embedding array<double>, label int")
    centroids = settle(train.fixed_centroids(points))
    return x, points, centroids, settle(train.kmeans_assign(points, centroids))


def asked(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "query_id long, q array<double>")


def test_probed_cells_by_brute_force(spark, index, monkeypatch):
    """Blocks of a few pairs and query blocks of a few bytes give what brute force over the probed cells gives, ties by id."""
    x, points, centroids, assigned = index
    monkeypatch.setattr(ivf, "in_blocks", lambda queries, act, **o: knn.in_blocks(queries, act, 600))
    q = asked(spark, x[:12])
    got = {(r.query_id, r["rank"]): (r.id, r.distance) for r in ivf.probed_knn(points, assigned, q, centroids, 6, 2).collect()}
    c = np.array([r.centroid for r in centroids.orderBy("cluster_id").collect()])
    cell = np.array([r.cluster_id for r in assigned.orderBy("id").collect()])
    for i in range(12):
        near = np.argsort(((x[i] - c) ** 2).sum(1), kind="stable")[:2]
        d = np.where(np.isin(cell, near), np.cumsum((x[i] - x) ** 2, axis=1)[:, -1], np.inf)
        best = np.lexsort((np.arange(400), d))[:6]
        assert [got[i, j + 1] for j in range(6)] == [(int(b), d[b]) for b in best]


def test_shortlist_is_of_all_tasks(spark, index):
    """Only rows of the global shortlist are reranked, however many tasks there are."""
    x, points, centroids, assigned = index
    res = settle(train.residuals(points, assigned, centroids))
    params = train.sq8_fit(res)
    codes, q = settle(train.sq8_encode(res, params)), asked(spark, x[:6])
    first = ivf.search_sq8(points, q, centroids, codes, params, 20, 3, 1).select("query_id", "id")
    short = ivf.search_sq8(points, q, centroids, codes, params, 20, 3, 20, "cosine").select("query_id", "id")
    assert first.count() == short.count() == 120 and first.exceptAll(short).count() == 0


def test_estimates_by_bits(spark, index):
    """Estimates from sign bits are those of the formula, pair by pair."""
    x, points, centroids, assigned = index
    codes = settle(train.rabitq_encode(settle(train.residuals(points, assigned, centroids)), points))
    got = {(r.query_id, r.id): r.distance for r in ivf.search_rabitq(points, asked(spark, x[:3]), centroids, codes, 256, 4, 1).collect()}
    c = {r.cluster_id: np.array(r.centroid) for r in centroids.collect()}
    signs = train.rotation_signs(8)
    p = signs.shape[1]
    for r in codes.where(F.col("id") % 7 == 0).collect():
        for i in range(3):
            v = (train.rotate(x[i : i + 1], signs) - train.rotate(c[r.cluster_id][None], signs))[0]
            step = (v.max() - v.min()) / 15
            u = np.clip(np.rint((v - v.min()) / step), 0, 15)
            bits = np.unpackbits(np.frombuffer(r.bits, np.uint8))[:p]
            inner = r.rescale * (v.min() * (2 * r.popcount - p) + step * (2 * (u * bits).sum() - u.sum()))
            if (i, r.id) in got:
                assert abs(got[i, r.id] - (((x[i] - c[r.cluster_id]) ** 2).sum() + r.res_norm_sq - 2 * inner)) < 1e-9
