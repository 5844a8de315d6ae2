from pyspark.sql import functions as F

from vektra.operators import knn
from vektra.streaming import serve

REQUEST = "query_id long, q array<double>, algorithm string, top_k int, ef_or_nprobe int, rerank_k int"


def test_requests_are_grouped_and_answered(spark, tmp_path):
    points = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(20)], "id long, embedding array<double>")
    rows = [(i, [float(i), 0.0], "flat", 2 if i % 2 else 3, None, None) for i in range(8)]
    spark.createDataFrame(rows, REQUEST).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(REQUEST).parquet(str(tmp_path / "in"))
    logs = []
    q = serve.serve(
        stream,
        lambda qs, p: knn.knn(points, qs, p["top_k"]),
        lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={n}")),
        str(tmp_path / "ck"),
        lambda groups, n: logs.extend(groups),
    )
    q.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("query_id").agg(F.count("*").alias("n"), F.min("distance").alias("d")).collect()
    assert {(r.query_id, r.n, r.d) for r in got} == {(i, 2 if i % 2 else 3, 0.0) for i in range(8)}
    assert sorted(g["count"] for g in logs) == [4, 4]


def test_mutations(spark, tmp_path):
    schema = "id long, seq long, op string, embedding array<double>"
    rows = [(1, 1, "upsert", [1.0]), (2, 2, "upsert", [2.0]), (1, 3, "upsert", [5.0]), (2, 4, "delete", None), (3, 5, "upsert", [3.0])]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    serve.apply_mutations(stream, str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination(60)
    assert {(r.id, r.embedding[0]) for r in serve.live(spark, str(tmp_path / "log")).collect()} == {(1, 5.0), (3, 3.0)}
