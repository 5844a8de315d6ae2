"""The registered queries and the pipeline's stages."""

import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from vektra.llm import pii, queries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


def test_registered():
    names = set(queries.queries())
    assert {re.match(r"op(\d+)_", n)[1] for n in names if n != "pipeline"} == {str(i) for i in range(1, 11)}
    assert names <= set(__spark_entry__.queries())
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_stages_keep_columns_and_whole_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").withColumn("node", F.lit(1))
    columns, frames = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, DIR).cache()
        if name != "packing":
            assert docs.columns == columns
            assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0 and docs.count() > 0
        frames.append(docs)
    poor, toxic, single, hidden, packed = frames
    for kept, earlier in ((toxic, poor), (single, toxic)):
        assert kept.join(earlier, ["doc_id", "text"], "left_anti").count() == 0
    assert hidden.count() == single.count() and hidden.where(F.length("text") != F.col("n_chars")).count() == 0
    again = pii.pseudonymise(single, corpus_pipeline.KEY).select("doc_id", F.col("text").alias("t"))
    assert hidden.join(again, "doc_id").where("text <> t").count() == 0
    assert packed.select("doc_id").distinct().count() == hidden.count()


def test_op4_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    theirs = con.execute(queries.oracle_sql()["op4_url_reputation"]).fetchall()
    ours = [tuple(r) for r in queries.queries()["op4_url_reputation"](spark, DIR).collect()]
    assert sorted(map(repr, theirs)) == sorted(map(repr, ours))


@pytest.mark.parametrize("name", sorted(n for n in queries.queries() if n not in ("pipeline", "op4_url_reputation")))
def test_queries_run(spark, name):
    assert queries.queries()[name](spark, DIR).count() > 0
