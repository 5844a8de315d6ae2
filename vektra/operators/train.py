"""Training and encoding: k-means, residuals, product, scalar and binary quantisers.

Centroids are (cluster_id, centroid), codebooks (m, code, sub); both are bounded by
their configuration (nlist, 256 codes), which is checked before they are broadcast.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import dot, squared_l2, subtract
from .knn import list_matrix
from .lineage import settle

MOST_LISTS, CODES = 65_536, 256
#: Seed of the rotation's signs and the constants of its generator.
ROTATION_SEED = 0x5F3759DFCAFEBABE
GOLDEN, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def small(table: DataFrame, most: int) -> DataFrame:
    """Broadcast hint for a table whose number of rows is checked to be within ``most``; else the table as it is."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def kmeans_fit(points: DataFrame, k: int, rounds: int = 25, seed: int = 42) -> DataFrame:
    """Centroids (cluster_id, centroid) of a seeded k-means over all points."""
    spark = points.sparkSession
    rows = points.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    centers = KMeans(k=k, maxIter=rounds, seed=seed, tol=1e-4).fit(rows).clusterCenters()
    return spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centers)], "cluster_id int, centroid array<double>")


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the row of ``c`` nearest to each row of ``x``; the lowest on ties.

    A matrix product finds the three likeliest, which are then summed exactly.
    """
    rough = (c * c).sum(1)[None] - 2 * (x @ c.T)
    few = np.argpartition(rough, min(3, len(c)) - 1, axis=1)[:, : min(3, len(c))] if len(c) > 3 else np.broadcast_to(np.arange(len(c)), (len(x), len(c)))
    few = np.sort(few, axis=1)
    exact = ((x[:, None] - c[few]) ** 2).sum(2)
    best = exact.argmin(1)
    rows = np.arange(len(x))
    return few[rows, best], exact[rows, best]


def centroid_matrix(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and vectors of all centroids, in order; raises beyond MOST_LISTS of them."""
    got = centroids.select("cluster_id", "centroid").limit(MOST_LISTS + 1).collect()
    if len(got) > MOST_LISTS:
        raise ValueError(f"more than {MOST_LISTS} centroids")
    got.sort(key=lambda r: r[0])
    return np.array([r[0] for r in got], np.int32), np.array([r[1] for r in got], np.float64)


def kmeans_assign(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """(id, cluster_id, distance): the nearest centroid, lowest number on ties. No exchange: centroids go to the points."""
    shared = points.sparkSession.sparkContext.broadcast(centroid_matrix(centroids))

    def run(batches):
        numbers, c = shared.value
        for b in batches:
            if b.num_rows and len(c):
                at, d = nearest(list_matrix(b.column(1)), c)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(numbers[at]), pa.array(d)], names=["id", "cluster_id", "distance"])

    return points.select(F.col("id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "id long, cluster_id int, distance double")


def lloyd_step(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """Centroids after one round: means of the points nearest to each; empty cells keep theirs."""
    near = points.join(kmeans_assign(points, centroids).select("id", "cluster_id"), "id")
    long = near.select("cluster_id", F.posexplode("embedding").alias("pos", "x"))
    means = long.groupBy("cluster_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    lists = means.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("c")).select("cluster_id", F.transform("c", lambda e: e["x"]).alias("mean"))
    return centroids.join(lists, "cluster_id", "left").select("cluster_id", F.coalesce("mean", F.col("centroid").cast("array<double>")).alias("centroid"))


def lloyd(points: DataFrame, centroids: DataFrame, rounds: int = 25, tol: float = 1e-4) -> DataFrame:
    """Rounds of ``lloyd_step`` until no centroid moves by ``tol`` (squared), each cut from its lineage."""
    for _ in range(rounds):
        new = settle(lloyd_step(points, centroids))
        moved = new.join(centroids.withColumnRenamed("centroid", "old"), "cluster_id").agg(F.max(squared_l2(F.col("centroid"), F.col("old")))).first()[0]
        centroids = new
        if moved is None or moved < tol:
            break
    return centroids


def residuals(points: DataFrame, assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """(id, cluster_id, residual)."""
    own = assigned.select("id", "cluster_id").join(small(centroids, MOST_LISTS), "cluster_id")
    return points.join(own, "id").select("id", "cluster_id", subtract(F.col("embedding"), F.col("centroid")).alias("residual"))


def sub_vectors(rows: DataFrame, m: int, column: str = "residual") -> DataFrame:
    """(id, ..., m, sub): ``column`` cut into m parts of one length; raises if the length is not divisible."""
    first = rows.select(F.size(column)).first()
    if first and first[0] % m:
        raise ValueError("the dimension must be divisible by m_pq")
    width = (F.size(column) / m).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.slice(F.col(column), i * width + 1, width))
    keep = [c for c in rows.columns if c != column]
    return rows.select(*keep, F.posexplode(parts).alias("m", "sub"))


def pq_train(res: DataFrame, m: int, codes: int = CODES, rounds: int = 15, seed: int = 42) -> DataFrame:
    """Codebook (m, code, sub): k-means in each subspace, over a bounded sample of 64 rows for each code.

    The sample is the first rows by a hash of the id; every subspace is one group.
    """
    sample = res.orderBy(F.xxhash64("id"), "id").limit(64 * codes)

    def fit(key, pdf):
        x = np.array(pdf["sub"].tolist(), np.float64)
        rng = np.random.default_rng(seed + int(key[0]))
        c = x[rng.permutation(len(x))[: min(codes, len(x))]]
        for _ in range(rounds):
            near = ((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)
            count = np.bincount(near, minlength=len(c))[:, None]
            total = np.zeros_like(c)
            np.add.at(total, near, x)
            c = np.where(count > 0, total / np.maximum(count, 1), c)
        return type(pdf)({"m": int(key[0]), "code": range(len(c)), "sub": c.tolist()})

    return sub_vectors(sample, m).groupBy("m").applyInPandas(fit, "m int, code int, sub array<double>")


def code_words(codebook: DataFrame, m: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each part its codes and their words, in order; ``m`` times CODES rows at most."""
    got = codebook.select("m", "code", "sub").limit(m * CODES + 1).collect()
    if len(got) > m * CODES:
        raise ValueError("too many codewords")
    parts = [sorted((r[1], r[2]) for r in got if r[0] == i) for i in range(m)]
    return [(np.array([c for c, _ in p], np.int32), np.array([w for _, w in p], np.float64)) for p in parts]


def pq_encode(res: DataFrame, codebook: DataFrame, m: int) -> DataFrame:
    """(id, cluster_id, codes): the nearest codeword of each part, lowest code on ties. No exchange."""
    shared = res.sparkSession.sparkContext.broadcast(code_words(codebook, m))

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = list_matrix(b.column(2)).reshape(b.num_rows, m, -1)
                codes = np.stack([numbers[nearest(x[:, i], words)[0]] for i, (numbers, words) in enumerate(shared.value)], axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes.tolist(), pa.list_(pa.int32()))], names=["id", "cluster_id", "codes"])

    return res.select("id", "cluster_id", "residual").mapInArrow(run, "id long, cluster_id int, codes array<int>")


def coded(codes: DataFrame) -> DataFrame:
    """(id, cluster_id, m, code): one row for each part."""
    return codes.select("id", "cluster_id", F.posexplode("codes").alias("m", "code"))


def sq8_fit(res: DataFrame) -> DataFrame:
    """(pos, low, scale) over all residuals; scale 0 where the range is at most 1e-12."""
    long = res.select(F.posexplode("residual").alias("pos", "r"))
    span = F.max("r") - F.min("r")
    return long.groupBy("pos").agg(F.min("r").alias("low"), F.when(span <= 1e-12, F.lit(0.0)).otherwise(span / 255).alias("scale"))


def packed(params: DataFrame) -> DataFrame:
    """One row (low, scale) of arrays, by position; as long as the dimension."""
    rows = params.groupBy().agg(F.array_sort(F.collect_list(F.struct("pos", "low", "scale"))).alias("p"))
    return rows.select(F.transform("p", lambda e: e["low"]).alias("low"), F.transform("p", lambda e: e["scale"]).alias("scale"))


def sq8_encode(res: DataFrame, params: DataFrame) -> DataFrame:
    """(id, cluster_id, codes): 0 to 255 for each component, 0 where the scale is 0."""
    joined = res.join(F.broadcast(packed(params)))  # one row
    parts = F.arrays_zip("residual", "low", "scale")
    code = lambda e: F.when(e["scale"] == 0, 0).otherwise(F.least(F.greatest(F.round((e["residual"] - e["low"]) / e["scale"]), F.lit(0)), F.lit(255))).cast("int")
    return joined.select("id", "cluster_id", F.transform(parts, code).alias("codes"))


def sq8_decode(codes: Column, low: Column, scale: Column) -> Column:
    return F.transform(F.arrays_zip(codes.alias("c"), low.alias("l"), scale.alias("s")), lambda e: e["c"] * e["s"] + e["l"])


def padded_dim(dim: int) -> int:
    return max(32, 1 << (dim - 1).bit_length())


def rotation_signs(dim: int, seed: int = ROTATION_SEED) -> np.ndarray:
    """Three rows of +1 and -1 from a 64-bit mixing generator; +1 where its lowest bit is 0."""
    wrap, state, out = (1 << 64) - 1, seed ^ GOLDEN, []
    for _ in range(3 * padded_dim(dim)):
        state = (state + GOLDEN) & wrap
        z = state
        z = ((z ^ (z >> 30)) * MIX1) & wrap
        z = ((z ^ (z >> 27)) * MIX2) & wrap
        out.append(-1.0 if (z ^ (z >> 31)) & 1 else 1.0)
    return np.array(out).reshape(3, -1)


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Three signed Walsh-Hadamard transforms of padded rows, each scaled to keep lengths."""
    p = signs.shape[1]
    y = np.zeros((len(x), p))
    y[:, : x.shape[1]] = x
    for s in signs:
        y = y * s
        step = 1
        while step < p:
            y = y.reshape(len(x), -1, 2, step)
            y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), p)
            step *= 2
        y = y / np.sqrt(p)
    return y


def rabitq_encode(res: DataFrame, points: DataFrame) -> DataFrame:
    """(id, cluster_id, bits, res_norm_sq, rescale, popcount, vec_norm_sq) of rotated residuals.

    ``bits`` are sign bits, most significant first, packed into bytes.
    """
    rows = res.join(points.select("id", dot(F.col("embedding"), F.col("embedding")).alias("vec_norm_sq")), "id").select("id", "cluster_id", "residual", "vec_norm_sq")
    first = rows.select(F.size("residual")).first()
    signs = rotation_signs(first[0] if first else 1)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            r = list_matrix(b.column(2))
            y = rotate(r, signs)
            norm, total = (r * r).sum(1), np.abs(y).sum(1)
            fine = (np.sqrt(norm) > 1e-12) & (total > 1e-12)
            bits = y >= 0
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x.tobytes() for x in np.packbits(bits, axis=1)]), pa.array(norm), pa.array(np.where(fine, norm / np.where(fine, total, 1), 0.0)), pa.array(bits.sum(1).astype(np.int32)), b.column(3)],
                names=["id", "cluster_id", "bits", "res_norm_sq", "rescale", "popcount", "vec_norm_sq"],
            )

    return rows.mapInArrow(run, "id long, cluster_id int, bits binary, res_norm_sq double, rescale double, popcount int, vec_norm_sq double")


def fp16_encode(points: DataFrame) -> DataFrame:
    """(id, half, norm_sq): components rounded to half precision, and the squared norm before that."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = list_matrix(b.column(1)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x.astype(np.float16).astype(np.float32).tolist(), pa.list_(pa.float32())), pa.array((x.astype(np.float64) ** 2).sum(1))], names=["id", "half", "norm_sq"])

    return points.select("id", "embedding").mapInArrow(run, "id long, half array<float>, norm_sq double")


def fixed_centroids(points: DataFrame, label: str = "label") -> DataFrame:
    """Mean vector of each label, as centroids."""
    long = points.select(F.col(label).cast("int").alias("cluster_id"), F.posexplode("embedding").alias("pos", "x"))
    means = long.groupBy("cluster_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("c")).select("cluster_id", F.transform("c", lambda e: e["x"]).alias("centroid"))


def fixed_codebook(points: DataFrame, m: int = 8, codes: int = 16) -> DataFrame:
    """Codebook whose words are the parts of the vectors with the smallest ids."""
    rows = points.where(F.col("id") < codes).select(F.col("id").cast("int").alias("code"), F.col("embedding").cast("array<double>").alias("residual"))
    return sub_vectors(rows, m).select("m", "code", "sub")


def choose_parts(dim: int) -> int:
    """The largest of 16, 8, 4, 2, 1 parts that divides the dimension."""
    return next(m for m in (16, 8, 4, 2, 1) if dim % m == 0)


def synthetic(spark: SparkSession, n: int, dim: int, clusters: int, seed: int = 42, spread: float = 1.5, noise: float = 0.15) -> DataFrame:
    """(id, embedding, cluster): point i near centre i mod clusters, the same for any partitioning."""
    uniform = lambda *key: (F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    centre = lambda j: (uniform(F.lit(1), F.col("cluster"), j) * 2 - 1) * spread
    normal = lambda j: F.sqrt(-2 * F.log(uniform(F.lit(2), F.col("id"), j))) * F.cos(2 * np.pi * uniform(F.lit(3), F.col("id"), j))
    rows = spark.range(n).withColumn("cluster", (F.col("id") % clusters).cast("int"))
    return rows.withColumn("embedding", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: (centre(j) + normal(j) * noise).cast("float")))


