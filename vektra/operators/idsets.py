"""Sets of ids as relations, and as bitmaps for exchange.

A bitmap set is (bucket, bitmap): one bitmap of 4 KiB for each bucket of 32,768 ids, so
a dense set is small and a union or intersection is a join of buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_range(spark: SparkSession, start: int, end: int) -> DataFrame:
    """Ids from start up to, not including, end."""
    return spark.range(start, end)


def from_flags(rows: DataFrame, flag: str, id_col: str = "id") -> DataFrame:
    """Ids of the rows whose flag is true."""
    return rows.where(F.coalesce(F.col(flag), F.lit(False))).select(F.col(id_col).alias("id"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").union(b.select("id")).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").distinct().join(b.select("id"), "id", "left_semi")


def allowed(points: DataFrame, ids: DataFrame | None, tombstones: DataFrame | None = None) -> DataFrame:
    """Points of the id set that are not deleted; without a set, all that are not."""
    out = points if ids is None else points.join(ids.select("id"), "id", "left_semi")
    return out if tombstones is None else out.join(tombstones.select("id"), "id", "left_anti")


def to_bitmaps(ids: DataFrame) -> DataFrame:
    """(bucket, bitmap); built up in each task before the exchange."""
    return ids.groupBy(F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bitmap"))


def bitmap_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def bitmap_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Buckets of both sets, and-ed; a bucket that only one set has is left out."""
    both = a.unionByName(b).groupBy("bucket").agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count(F.lit(1)).alias("_n"))
    return both.where((F.col("_n") == 2) & (F.bitmap_count("bitmap") > 0)).select("bucket", "bitmap")


def size(bitmaps: DataFrame) -> int:
    return bitmaps.agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0))).first()[0]


def to_ids(bitmaps: DataFrame) -> DataFrame:
    """The ids of a bitmap set, by the bits of each byte."""
    bytes_ = F.transform(F.sequence(F.lit(1), F.octet_length("bitmap")), lambda i: F.conv(F.hex(F.substring(F.col("bitmap"), i, 1)), 16, 10).cast("int"))
    long = bitmaps.select("bucket", F.posexplode(bytes_).alias("at", "byte")).where("byte <> 0")
    masks = F.array(*[F.lit(1 << k) for k in range(8)])
    bits = long.select("bucket", "at", F.explode(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda j: F.col("byte").bitwiseAND(F.get(masks, j)) != 0)).alias("bit"))
    place = F.col("at") * 8 + F.col("bit")
    above = (F.col("bucket") - 1) * 32_768 + place + 1  # ids from 1 on; 0 and below lie in buckets of their own
    return bits.select(F.when(F.col("bucket") > 0, above).otherwise(F.col("bucket") * 32_768 - place).cast("long").alias("id"))
