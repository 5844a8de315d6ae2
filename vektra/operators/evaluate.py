"""Recall, latency and batch figures as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settle

QUANTILES = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999}


def recall_at_k(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, recall): share of each query's true ids that were found; 0 where nothing was."""
    hits = truth.select("query_id", "id").distinct().join(found.select("query_id", "id", F.lit(1).alias("_hit")).distinct(), ["query_id", "id"], "left")
    return hits.groupBy("query_id").agg((F.coalesce(F.sum("_hit"), F.lit(0)) / F.count(F.lit(1))).alias("recall"))


def latency_stats(samples: DataFrame, value: str = "us") -> DataFrame:
    """One row: count, percentiles at place floor(n * p) of the sorted samples, min, max and mean.

    The places are read off running counts: values are dealt out by range, each range
    counts its own, and only the ranges' sizes go to the driver.
    """
    counts = samples.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    ranged = settle(counts.repartitionByRange("v").withColumn("_p", F.spark_partition_id()))
    before, total = {}, 0
    for p, n in sorted((r["_p"], r["n"]) for r in ranged.groupBy("_p").agg(F.sum("c").alias("n")).collect()):
        before[p], total = total, total + n
    start = F.element_at(F.create_map(*[F.lit(x) for kv in (before or {0: 0}).items() for x in kv]), F.col("_p"))
    running = ranged.withColumn("_below", start + F.sum("c").over(Window.partitionBy("_p").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    place = lambda p: min(int(total * p), total - 1) + 1
    marks = [F.min(F.when(F.col("_below") >= place(p), F.col("v"))).alias(name) for name, p in QUANTILES.items()]
    return running.agg(F.lit(total).cast("long").alias("count"), *marks, F.min("v").alias("min"), F.max("v").alias("max"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"))


def batch_stats(batches: DataFrame, size: str = "size") -> DataFrame:
    """One row: requests, batches and mean batch size of a batch log."""
    return batches.agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("requests"), F.count(F.lit(1)).alias("batches"), F.coalesce(F.avg(size), F.lit(0.0)).alias("mean_size"))


def queries_per_second(queries: int, seconds: float) -> float:
    return queries / seconds if seconds > 0 else 0.0
