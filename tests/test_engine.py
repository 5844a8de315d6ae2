import numpy as np
import pytest
from pyspark.sql import functions as F

from vektra.functions import scores
from vektra.functions.vectors import distance, metric_name, normalize
from vektra.operators import collection, evaluate, graph, ivf, knn, project3d, sparse, train
from vektra.operators.facade import Collections, Retriever
from vektra.sources import snapshot

VEC = "id long, embedding array<double>"


def clustered(n, dim, clusters, seed, noise=0.18):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-1, 1, (clusters, dim))
    return centres[np.arange(n) % clusters] + rng.normal(0, noise, (n, dim))


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, r.tolist()) for i, r in enumerate(x)], VEC)


def asked(spark, q):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(q)], "query_id long, q array<double>")


def truth(x, q, k):
    d = ((q[:, None] - x[None]) ** 2).sum(2)
    return [set(np.lexsort((np.arange(len(x)), r))[:k].tolist()) for r in d]


def recall(found, real):
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, set()).add(r.id)
    return sum(len(got.get(i, set()) & t) for i, t in enumerate(real)) / sum(map(len, real))


def test_metrics(spark):
    assert metric_name("Euclidean") == "l2" and metric_name("dot") == "ip"
    with pytest.raises(ValueError):
        metric_name("hamming")
    with pytest.raises(ValueError):
        knn.check_k(0)
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>").select(
        distance("l2", F.col("a"), F.col("b")), distance("cosine", F.col("a"), F.col("b")), distance("ip", F.col("a"), F.col("a")), normalize(F.col("a")), normalize(F.col("b"))
    ).first()
    assert row[0] == 25 and row[1] == 1 and row[2] == -25 and row[3] == [0.6, 0.8] and row[4] == [0, 0]


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_blocks_equal_expression(spark, metric):
    x = clustered(300, 16, 5, 1)
    points, q = frame(spark, x), asked(spark, x[:7] * 2)
    key = lambda df: [(r.query_id, r.rank, r.id, round(r.distance, 9)) for r in df.orderBy("query_id", "rank").collect()]
    assert key(knn.knn(points, q, 9, metric)) == key(knn.knn_expression(points, q, 9, metric))


def test_query_blocks_and_ties(spark):
    x = np.zeros((40, 4))
    points, q = frame(spark, x), asked(spark, np.ones((5, 4)))
    small = knn.in_blocks(q, lambda b: knn.top_k(points.join(F.broadcast(b)).select("query_id", "id", distance("l2", F.col("q"), F.col("embedding")).alias("distance")), 3), 64)
    assert sorted((r.query_id, r.rank, r.id) for r in small.collect()) == [(i, j + 1, j) for i in range(5) for j in range(3)]
    assert knn.knn(points.limit(0), q, 3).count() == 0 and knn.knn(points, q.limit(0), 3).count() == 0


def test_fp16_finds_itself(spark):
    x = clustered(200, 32, 4, 303)
    for metric in ("l2", "cosine"):
        first = knn.search_fp16(frame(spark, x), asked(spark, x[:4]), 5, metric).where("rank = 1").collect()
        assert {(r.query_id, r.id) for r in first} == {(i, i) for i in range(4)}


@pytest.mark.parametrize("kind,least", [("hnsw", 0.9), ("cagra", 0.85)])
def test_graph_recall(spark, kind, least):
    x = clustered(1200, 32, 12, 101)
    q = x[:12] + 0.02
    made = graph.build(frame(spark, x), kind, 16, 100, shard_rows=700)
    assert made.select("shard").distinct().count() == 2
    assert recall(graph.search(made, asked(spark, q), 10, 96, kind=kind), truth(x, q, 10)) >= least
    allowed = spark.range(0, 1200, 3)
    assert all(r.id % 3 == 0 for r in graph.search(made, asked(spark, q), 10, 64, kind=kind, allowed=allowed).collect())
    steps = graph.search(made, asked(spark, q[:2]), 5, 16, kind=kind, trace=True)
    assert graph.steps_until(steps, 0).count() < steps.count()


def test_inverted_files(spark):
    x = clustered(800, 24, 12, 202)
    points, q = frame(spark, x), x[:8]
    centroids = train.settle(train.kmeans_fit(points, 12))
    assigned = train.settle(train.kmeans_assign(points, centroids))
    res = train.settle(train.residuals(points, assigned, centroids))
    book = train.settle(train.pq_train(res, 6, 32))
    params = train.sq8_fit(res)
    real, ask = truth(x, q, 10), asked(spark, q)
    assert recall(ivf.search_pq(points, ask, centroids, train.pq_encode(res, book, 6), book, 6, 10, 6, 200), real) >= 0.8
    assert recall(ivf.search_sq8(points, ask, centroids, train.sq8_encode(res, params), params, 10, 6, 64), real) >= 0.8
    assert recall(ivf.search_rabitq(points, ask, centroids, train.rabitq_encode(res, points), 10, 6, 200), real) >= 0.8
    with pytest.raises(ValueError):
        train.sub_vectors(res, 7)
    low, scale = (np.array(v) for v in train.packed(params).first())
    back = np.array([r.codes for r in train.sq8_encode(res, params).orderBy("id").collect()]) * scale + low
    assert np.abs(back - np.array([r.residual for r in res.orderBy("id").collect()])).max() <= scale.max()
    assert ivf.shortlist_size(10, 0) == 10 and ivf.shortlist_size(10, 4) == 10 and ivf.shortlist_size(10, 10**6) == 10_240


def test_rotation_keeps_products():
    signs = train.rotation_signs(96, 42)
    assert signs.shape == (3, 128) and set(np.unique(signs)) == {-1.0, 1.0}
    a, b = np.sin(np.arange(96.0))[None], np.cos(np.arange(96.0))[None]
    assert abs((train.rotate(a, signs) * train.rotate(b, signs)).sum() - (a * b).sum()) < 1e-9


def test_lloyd_converges(spark):
    x = clustered(200, 4, 3, 5, 0.05)
    start = spark.createDataFrame([(i, x[i].tolist()) for i in range(3)], "cluster_id int, centroid array<double>")
    end = np.array([r.centroid for r in train.lloyd(frame(spark, x), start, 6).orderBy("cluster_id").collect()])
    assert np.allclose(end, [x[i::3].mean(0) for i in range(3)], atol=1e-6)


def test_collection_life(spark, tmp_path):
    x = clustered(60, 8, 4, 7)
    c = collection.build(frame(spark, x))
    c = collection.add(c, spark.createDataFrame([([50.0] * 8,)], "embedding array<double>"))
    assert c.sizes() == {"live": 61, "delta": 1, "tombstones": 0, "next_id": 61}
    c, n = collection.delete(c, spark.createDataFrame([(0,), (0,), (999,)], "id long"))
    assert n == 1 and collection.delete(c, spark.createDataFrame([(0,)], "id long"))[1] == 0 and collection.delete(c)[1] == 0
    first = collection.search(c, asked(spark, np.full((1, 8), 50.0)), 3).where("rank = 1").first()
    assert first.id == 60 and first.distance == 0
    snapshot.save(c, str(tmp_path / "s"), {"extra": spark.range(3)})
    back, more = snapshot.load(spark, str(tmp_path / "s"))
    assert back.sizes() == c.sizes() and more["extra"].count() == 3
    done = collection.compact(back)
    assert done.sizes() == {"live": 60, "delta": 0, "tombstones": 0, "next_id": 61}
    assert collection.compact(done) is done
    late = collection.add(back, spark.createDataFrame([([1.0] * 8,)], "embedding array<double>"))
    late, _ = collection.delete(late, spark.createDataFrame([(5,)], "id long"))
    joined = collection.reconcile(done, late, 61)
    assert joined.sizes()["live"] == 60 and joined.next_id == 62
    with pytest.raises(ValueError):
        snapshot.load(spark, str(tmp_path / "nowhere"))
    with pytest.raises(ValueError):
        collection.add(c, spark.createDataFrame([([1.0],)], "embedding array<double>"))
    with pytest.raises(ValueError):
        collection.build(frame(spark, x).limit(0))


def test_store_calls(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0], i, i % 3) for i in range(7)], "id long, embedding array<double>, seq long, tag int")
    c = collection.build(rows)
    page, nxt = collection.scroll(c.live(), 3)
    assert [r.id for r in page.collect()] == [0, 1, 2] and nxt == 3
    page, nxt = collection.scroll(c.live(), 4, 3)
    assert [r.id for r in page.collect()] == [3, 4, 5, 6] and nxt is None
    with pytest.raises(KeyError):
        collection.scroll(c.live(), 1, 77)
    c = collection.upsert(c, spark.createDataFrame([(2, [9.0, 9.0], 8, 5), (2, [8.0, 8.0], 9, 6), (9, [0.0, 0.0], 10, 5)], rows.schema))
    assert c.count() == 8 and c.where({"tag": 6}).first().embedding == [8.0, 8.0] and c.next_id == 10
    c = collection.set_payload(c, spark.createDataFrame([(1,), (55,)], "id long"), {"tag": 40})
    assert c.count({"tag": 40}) == 1
    asked_ids = spark.createDataFrame([(0, 4), (1, 99), (2, 0)], "pos int, id long")
    assert [(r.id, r.seq) for r in collection.get(c, asked_ids).collect()] == [(4, 4), (99, None), (0, 0)]
    c, n = collection.delete(c, spec={})
    assert n == 8 and c.count() == 0
    assert collection.clear(c).count() == 0 and collection.algorithm("???") == "hnsw" and collection.algorithm(None, True) == "ivf_pq"


def test_shards(spark):
    x = clustered(100, 6, 3, 3)
    sizes = {r.shard: (r.a, r.b, r.n) for r in knn.shard(frame(spark, x), 3).groupBy("shard").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n")).collect()}
    assert sizes == {0: (0, 33, 34), 1: (34, 66, 33), 2: (67, 99, 33)}
    assert recall(knn.sharded_knn(frame(spark, x), asked(spark, x[:5]), 3, 10), truth(x, x[:5], 10)) == 1


def test_sparse_and_fusion(spark):
    rows = spark.createDataFrame([(0, 10, 0.5), (0, 2, 1.0), (0, 10, 0.25), (1, 3, 0.0), (1, 7, 2.0), (1, 9, 1.0), (1, 9, -1.0)], "id long, term long, weight double")
    built = {(r.id, r.term): r.weight for r in sparse.build_sparse(rows).collect()}
    assert built == {(0, 10): 0.75, (0, 2): 1.0, (1, 7): 2.0, (1, 9): 0.0}
    found = sparse.search_sparse(sparse.build_sparse(rows), spark.createDataFrame([(0, 10, 1.0), (0, 10, 1.0), (0, 9, 4.0)], "query_id long, term long, weight double"), 5).collect()
    assert [(r.id, r.score) for r in found] == [(0, 1.5)]
    ranked = lambda ids: spark.createDataFrame([(0, i, r + 1) for r, i in enumerate(ids)], "query_id long, id long, rank int")
    assert sparse.rrf_fuse([(ranked([5, 2]), 1.0), (ranked([2, 9]), 1.0)], 3, 60).first().id == 2


def test_mmr(spark):
    q = [1.0, 0.0]
    rows = [(0, 1, q, [1.0, 0.01]), (0, 2, q, [1.0, 0.0]), (0, 3, q, [0.7, 0.7]), (0, 4, q, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "query_id long, id long, q array<double>, embedding array<double>")
    assert [r.id for r in sparse.mmr(df, 2, 0.3).orderBy("rank").collect()] == [2, 4]
    assert [r.id for r in sparse.mmr(df, 2, 1.0).orderBy("rank").collect()] == [2, 1]


def test_scores(spark):
    row = spark.createDataFrame([(0.5,)], "d double").select(
        scores.similarity("l2", F.col("d")), scores.client_score("l2", F.col("d")), scores.relevance("l2", F.col("d")), scores.retriever_score("cosine", F.col("d")), scores.retriever_score("ip", F.col("d"))
    ).first()
    assert np.allclose(row, [1 / 1.5, 0.5**0.5, 0.5, 0.75, 1 / (1 + np.exp(0.5))])


def test_figures(spark):
    samples = spark.createDataFrame([(float(i),) for i in range(1, 101)], "us double")
    r = evaluate.latency_stats(samples).first()
    assert (r["count"], r.p50, r.p90, r.p99, r.p999, r["min"], r["max"], r["mean"]) == (100, 51, 91, 100, 100, 1, 100, 50.5)
    b = evaluate.batch_stats(spark.createDataFrame([(3,), (5,)], "size int")).first()
    assert (b.requests, b.batches, b.mean_size) == (8, 2, 4)


def test_projections(spark):
    x = clustered(90, 16, 3, 42)
    points = frame(spark, x)
    spread = lambda y: (np.mean([np.linalg.norm(y[i::3] - y[i::3].mean(0), axis=1).mean() for i in range(3)]), np.mean([np.linalg.norm(y[i::3].mean(0) - y[j::3].mean(0)) for i in range(3) for j in range(i)]))
    for made in (project3d.pca_project(points, *project3d.pca_fit(points)), project3d.umap_project(points, project3d.umap_fit(points, 8))):
        y = np.array([(r.x, r.y, r.z) for r in made.orderBy("id").collect()])
        inner, outer = spread(y)
        assert inner < outer
    mean, parts = project3d.pca_fit(points)
    _, _, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(parts @ vt[:3].T), np.eye(3), atol=1e-6)


def test_named_collections(spark):
    client = Collections(spark, "tenant string, year int")
    client.create("a", 2, "Euclid")
    with pytest.raises(ValueError):
        client.create("a", 2)
    with pytest.raises(KeyError):
        client.count("b")
    rows = spark.createDataFrame([(1, [3.0, 4.0], 1, "x", 2020), (2, [0.0, 1.0], 2, "y", 2021)], "id long, embedding array<double>, seq long, tenant string, year int")
    client.upsert("a", rows)
    q = asked(spark, np.zeros((1, 2)))
    got = [(r.id, r.score) for r in client.search("a", q, 5).orderBy("rank").collect()]
    assert got == [(2, 1.0), (1, 5.0)]
    assert [r.id for r in client.search("a", q, 5, threshold=3.0).collect()] == [2]
    assert client.count("a", {"must": [{"key": "year", "range": {"gte": 2021}}]}) == 1
    assert client.delete("a", clauses={"must_not": [{"key": "tenant", "match": {"value": "x"}}]}) == 1
    assert client.get_collection("a") == {"metric": "l2", "dim": 2, "points": 1} and client.drop("a") and not client.exists("a")


def test_retriever(spark):
    embed = lambda t: F.array(*[F.length(t) - F.length(F.replace(t, F.lit(c), F.lit(""))) + F.lit(0.001) for c in "abc"])
    texts = spark.createDataFrame([(1, "aaa", "d1", "en"), (2, "bbb", "d2", "de"), (3, "aab", "d1", "en")], "id long, text string, ref string, lang string")
    store = Retriever.from_texts(texts, embed, 3, metadata="lang string")
    ask = spark.createDataFrame([(0, "aa")], "query_id long, text string")
    assert [r.id for r in store.similarity_search(ask, 2).orderBy("rank").collect()] == [1, 3]
    assert [r.id for r in store.similarity_search(ask, 2, [("lang", "==", "de")]).collect()] == [2]
    assert [r.id for r in store.max_marginal_relevance(ask, 2, 3, 0.1).orderBy("rank").collect()] == [1, 2]
    assert store.delete(ref="d1") == 2 and store.delete() == 1


def test_synthetic_and_fvecs(spark, tmp_path):
    made = train.synthetic(spark, 200, 8, 4)
    x = np.array([r.embedding for r in made.orderBy("id").collect()])
    assert np.linalg.norm(x[0::4] - x[0::4].mean(0), axis=1).mean() < np.linalg.norm(x[0::4].mean(0) - x[1::4].mean(0))
    raw = b"".join(np.array([3], "<i4").tobytes() + np.array([i, i + 0.5, -i], "<f4").tobytes() for i in range(5))
    (tmp_path / "v.fvecs").write_bytes(raw)
    assert [(r.id, r.embedding) for r in snapshot.read_fvecs(spark, str(tmp_path / "v.fvecs"), 3).orderBy("id").collect()][2] == (2, [2.0, 2.5, -2.0])
    assert train.choose_parts(24) == 8 and train.choose_parts(7) == 1
