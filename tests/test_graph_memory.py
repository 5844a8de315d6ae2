"""Graph searches give out what they found as they go: a task holds no shard's whole trace."""

import numpy as np
import pytest

from vektra.operators import graph


@pytest.mark.parametrize("kind", ["hnsw", "cagra"])
def test_traces_come_in_small_batches(spark, monkeypatch, kind):
    monkeypatch.setattr(graph, "GIVEN", 200)
    x = np.random.default_rng(4).normal(size=(300, 8))
    points = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<double>")
    queries = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x[:30])], "query_id long, q array<double>")
    made = graph.build(points, kind, 8, 40, shard_rows=150)
    steps = graph.search(made, queries, 5, 16, kind=kind, trace=True)
    monkeypatch.setattr(graph, "GIVEN", 10**9)
    whole = graph.search(made, queries, 5, 16, kind=kind, trace=True)
    assert steps.count() > 3000 and steps.select("query_id", "shard").distinct().count() == 60
    assert steps.exceptAll(whole).count() == whole.exceptAll(steps).count() == 0
    found = graph.search(made, queries, 1, 64, kind=kind).collect()
    assert sum(r.query_id == r.id for r in found) >= 28


def test_no_pandas_group_a_shard(spark):
    x = np.random.default_rng(5).normal(size=(60, 4))
    points = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<double>")
    queries = points.selectExpr("id as query_id", "embedding as q")
    plan = graph.search(graph.build(points, "hnsw", 8, 40), queries, 3, trace=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroups" not in plan
