"""Streams: queries answered in micro-batches, and live inserts and deletes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.collection import algorithm

#: What a request's fields default to.
DEFAULTS = {"algorithm": "hnsw", "top_k": 10, "ef_or_nprobe": 64, "rerank_k": 32}
KEY = ["algorithm", "top_k", "ef_or_nprobe", "rerank_k"]


def grouped(batch: DataFrame) -> list[dict]:
    """The distinct parameter sets of a micro-batch and how many requests each has; few, as callers name them."""
    filled = batch.select("query_id", "q", *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in DEFAULTS.items()])
    return [r.asDict() for r in filled.groupBy(*KEY).count().orderBy(*KEY).collect()]


def answer(batch: DataFrame, execute: Callable[[DataFrame, dict], DataFrame]) -> DataFrame | None:
    """One ``execute(queries, parameters)`` for each parameter set, results together."""
    out = None
    for key in grouped(batch):
        same = batch
        for c in KEY:
            same = same.where(F.coalesce(F.col(c), F.lit(DEFAULTS[c])) == key[c])
        found = execute(same.select("query_id", "q"), key | {"strategy": algorithm(key["algorithm"])})
        out = found if out is None else out.unionByName(found)
    return out


def serve(requests: DataFrame, execute: Callable[[DataFrame, dict], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, log: Callable[[list[dict], int], None] | None = None, **trigger) -> StreamingQuery:
    """Answers a stream of (query_id, q, algorithm, top_k, ef_or_nprobe, rerank_k).

    ``sink`` gets each micro-batch's results and number; a batch that is run again after
    a failure has the same number, so a sink that overwrites by number is exactly-once.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            found = answer(batch, execute)
            if log:
                log(grouped(batch), number)
            if found is not None:
                sink(found, number)
        finally:
            batch.unpersist()

    return requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def apply_mutations(mutations: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends a stream of (id, seq, op, embedding) to a log, one directory for each batch number.

    Writing a batch again overwrites its own directory. ``live`` reads the log.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return mutations.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def live(spark: SparkSession, path: str) -> DataFrame:
    """(id, embedding) as the log has them: the last operation of an id counts, deletes remove it."""
    rows = spark.read.parquet(path)
    last = rows.groupBy("id").agg(F.max(F.struct("seq", "op", "embedding")).alias("m"))
    return last.where(F.col("m.op") != "delete").select("id", F.col("m.embedding").alias("embedding"))
