"""Collections with indexes, versions of snapshots, string ids, masks and plans."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vektra.functions.filters import from_triples
from vektra.operators import collection, indexed, ivf, knn, sparse, train
from vektra.operators.facade import Collections
from vektra.sources import snapshot


def cloud(n=240, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(6, dim))[np.arange(n) % 6] + rng.normal(0, 0.4, (n, dim))


def points(spark, x):
    return spark.createDataFrame([(i, v.tolist(), i % 4) for i, v in enumerate(x)], "id long, embedding array<double>, colour int")


def asked(spark, x, ids):
    return spark.createDataFrame([(i, x[i].tolist()) for i in ids], "query_id long, q array<double>")


def answers(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, {})[r["rank"]] = r.id
    return {q: [ids[i] for i in sorted(ids)] for q, ids in out.items()}


def test_indexed_collection_lives(spark, tmp_path):
    """Every family, with deletes, inserts, a payload filter and a mask, against brute force; saved, loaded and compacted."""
    x = cloud()
    ix = indexed.build(points(spark, x[:200]), "l2", indexed.FAMILIES, lists=4, links=16, ef_construction=64)
    assert ix.families() == list(indexed.FAMILIES)
    rows = spark.createDataFrame([(x[i].tolist(), i % 4) for i in range(200, 240)], "embedding array<double>, colour int").coalesce(1)
    ix = indexed.add(ix, rows)
    ix, dead = indexed.delete(ix, spark.range(0, 240, 7).select("id"))
    assert dead == 35
    live = [i for i in range(240) if i % 7 and i % 4 < 3 and i % 5]
    queries = asked(spark, x, (3, 50, 77, 210))
    allowed = spark.range(240).where("id % 5 <> 0")
    far = ((x[:, None] - x[None]) ** 2).sum(2)
    want = {q: sorted(live, key=lambda i: (far[q, i], i))[:5] for q in (3, 50, 77, 210)}

    def look(one, name):
        return answers(indexed.search(one, queries, 5, name, {"colour": {"$lt": 3}}, allowed, nprobe=4, rerank_k=None, ef=200))

    for name in ("exact", "pq", "ivf-sq8", "ivf-rabitq", "hnsw", "cagra"):
        assert look(ix, name) == want
    path = str(tmp_path / "ix")
    assert indexed.save(ix, path) == 1 and any(f.startswith("cluster_id=") for f in os.listdir(f"{path}/v1/index_sq8_codes"))
    back = indexed.load(spark, path)
    assert back.families() == ix.families() and look(back, "sq8") == want
    small = indexed.compact(back)
    assert small.points.sizes() == {"live": 205, "delta": 0, "tombstones": 0, "next_id": 240}
    for name in ("ivf_pq", "hnsw"):
        assert look(small, name) == want
    assert indexed.compact(small) is small
    with pytest.raises(ValueError):
        indexed.search(indexed.build(points(spark, x[:50]), families=("hnsw",)), queries, 5, "cagra")
    with pytest.raises(ValueError):
        indexed.build(points(spark, x[:50]), families=("tree",))


def test_every_algorithm_has_a_strategy(spark):
    names = {"cagra": "cagra", "ivf_pq": "ivf_pq", "ivf-pq": "ivf_pq", "ivf": "ivf_pq", " PQ ": "ivf_pq", "ivf_sq8": "ivf_sq8", "ivf-sq8": "ivf_sq8", "sq8": "ivf_sq8", "ivf_rabitq": "ivf_rabitq", "ivf-rabitq": "ivf_rabitq", "rabitq": "ivf_rabitq", "other": "hnsw"}
    assert {n: collection.algorithm(n) for n in names} == names
    assert set(collection.ALGORITHMS.values()) <= set(collection.STRATEGIES)
    x = cloud(90)
    c = collection.build(points(spark, x))
    queries = asked(spark, x, (4, 11))
    exact = answers(collection.search(c, queries, 3))
    for name in ("ivf-pq", "hnsw"):
        assert answers(collection.search(c, queries, 3, strategy=collection.STRATEGIES[collection.algorithm(name)])) == exact


def test_snapshots_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "s")
    c = collection.build(points(spark, cloud(20)))
    assert snapshot.save(c, path) == 1
    back, _ = snapshot.load(spark, path)
    more, _ = collection.delete(back, spark.range(5).select("id"))
    assert snapshot.save(more, path) == 2  # to the path that it reads from
    assert snapshot.load(spark, path)[0].count() == 15 and snapshot.load(spark, path, 1)[0].count() == 20 and back.count() == 20
    # A save that died midway: parts without a manifest.
    more.main.write.parquet(f"{path}/v3/main")
    assert snapshot.versions(spark, path) == [1, 2] and snapshot.load(spark, path)[0].count() == 15
    assert snapshot.save(c, path) == 4 and snapshot.load(spark, path)[0].count() == 20
    assert snapshot.prune(spark, path, 1) == [1, 2, 3] and snapshot.versions(spark, path) == [4]
    for version in (None, 9):
        with pytest.raises(ValueError):
            snapshot.load(spark, str(tmp_path / "none") if version is None else path, version)


def test_arrays_as_vectors(spark):
    x = cloud(5).astype(np.float32)
    rows = snapshot.from_arrays(spark, x, [3, 4, 5, 6, 7]).orderBy("id").collect()
    assert [r.id for r in rows] == [3, 4, 5, 6, 7] and np.allclose([r.embedding for r in rows], x)
    assert snapshot.from_arrays(spark, pa.array([[1.0, 2.0], [3.0, 4.0]]), id_col="query_id", vector_col="q").columns == ["query_id", "q"]
    assert snapshot.from_arrays(spark, np.empty((0, 4))).count() == 0
    for bad in ([[1.0], [2.0, 3.0]], np.zeros((2, 2, 2))):
        with pytest.raises(ValueError):
            snapshot.from_arrays(spark, bad)
    with pytest.raises(ValueError):
        snapshot.from_arrays(spark, x, [1])


def test_string_ids(spark):
    store = Collections(spark, "tag int", string_ids=True)
    store.create("c", 4, "l2")
    rows = lambda *r: spark.createDataFrame(list(r), "id string, embedding array<double>, tag int").coalesce(1)
    store.upsert("c", rows(("a", [1.0, 0.0, 0.0, 0.0], 1), ("b", [0.0, 1.0, 0.0, 0.0], 2), ("a", [0.9, 0.0, 0.0, 0.0], 3), (None, [0.0, 0.0, 1.0, 0.0], 4)))
    assert store.count("c") == 3
    store.upsert("c", rows(("b", [0.0, 2.0, 0.0, 0.0], 5), ("d", [0.0, 0.0, 0.0, 1.0], 6)))
    assert store.count("c") == 4
    found = store.search("c", spark.createDataFrame([(1, [0.0, 2.0, 0.0, 0.0])], "query_id long, q array<double>"), 4, with_vectors=True).collect()
    by = {r.id: r for r in found}
    assert by["b"]["rank"] == 1 and by["b"].tag == 5 and by["a"].tag == 3 and {len(i) for i in by if i not in "abd"} == {36}
    assert store.count("c", {"must": [{"has_id": ["a", "d", "x"]}]}) == 2
    got = store.retrieve("c", spark.createDataFrame([(0, "d"), (1, "x"), (2, "a")], "pos int, id string")).collect()
    assert [r.id for r in got] == ["d", "a"]
    page, after = store.scroll("c", 2)
    assert [r.id for r in page.orderBy("seq").collect()][0] == "a" and after is not None
    rest, end = store.scroll("c", 10, after)
    assert rest.count() == 2 and end is None
    assert store.delete("c", spark.createDataFrame([("a",), ("x",)], "id string")) == 1 and store.count("c") == 3


def test_translators():
    assert from_triples([("a", "any", "x"), ("b", "eq", 1), ("c", "gte", 2), ("d", "lt", 3)]) == {"$and": [{"a": {"$contains": "x"}}, {"b": {"$eq": 1}}, {"c": {"$gte": 2}}, {"d": {"$lt": 3}}]}


def test_no_silent_cap(spark):
    with pytest.raises(ValueError):
        knn.knn_graph(points(spark, cloud(10)), 300)


def test_plans_leave_points_where_they_are(spark):
    """A shortlist and a query's terms go to the vectors and inverted lists, not the other way."""
    x = cloud(60)
    rows, queries = points(spark, x), asked(spark, x, (1, 2))
    shortlist = spark.createDataFrame([(1, 5), (2, 7), (1, 1)], "query_id long, id long")
    plan = ivf.rerank_exact(shortlist, rows, queries, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    matrix = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (2, "b", 1.0)], "id long, term string, weight double")
    terms = spark.createDataFrame([(7, "a", 1.0), (7, "a", 1.0), (7, "z", 1.0)], "query_id long, term string, weight double")
    found = sparse.search_sparse(matrix, terms)
    assert "strategy=broadcast" in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.id, r.score) for r in found.orderBy("rank").collect()] == [(2, 4.0), (1, 2.0)]


def test_masks_hold_in_compressed_scans(spark):
    x = cloud(120)
    rows, queries = points(spark, x), asked(spark, x, (3, 8))
    centroids = train.fixed_centroids(rows.withColumnRenamed("colour", "label"))
    res = train.residuals(rows, train.kmeans_assign(rows, centroids), centroids)
    params = train.sq8_fit(res)
    allowed = spark.range(0, 120, 3).select("id")
    found = ivf.search_sq8(rows, queries, centroids, train.sq8_encode(res, params), params, 4, 4, 32, allowed=allowed)
    assert all(i % 3 == 0 for ids in answers(found).values() for i in ids)
    assert answers(found) == answers(knn.knn(rows.where(F.col("id") % 3 == 0), queries, 4))
    assert all(i % 3 == 0 for ids in answers(knn.search_fp16(rows, queries, 4, allowed=allowed)).values() for i in ids)
