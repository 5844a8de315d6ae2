"""Snapshots: a directory of immutable versions, each of Parquet parts and a manifest; and vector files.

``path/v<n>/<part>`` holds a part of version n and ``path/v<n>/manifest`` what belongs
to it. The manifest is written last, so a version that a save did not finish has none
and is never read. A save writes a new version and touches no older one: a collection
may be saved to the very path that it was loaded from.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

from ..operators.collection import Collection

FORMAT = "vektra-2"
PARTS = ("main", "delta", "tombstones")
#: Parts that are read by cell: files are laid out by this column where a part has it.
CELL = "cluster_id"
#: Bytes of a vector file that one task reads at a time.
SPLIT = 64 << 20


def _folder(spark: SparkSession, path: str):
    """The Hadoop path and its file system, whatever store it is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Versions that are there, whole or not, ascending."""
    at, fs = _folder(spark, path)
    if not fs.exists(at):
        return []
    found = (re.fullmatch(r"v(\d+)", entry.getPath().getName()) for entry in fs.listStatus(at))
    return sorted(int(m[1]) for m in found if m)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions that a save has finished, ascending."""
    out = []
    for n in _numbers(spark, path):
        at, fs = _folder(spark, f"{path}/v{n}/manifest/_SUCCESS")
        if fs.exists(at):
            out.append(n)
    return out


def save(c: Collection, path: str, extra: dict[str, DataFrame] | None = None) -> int:
    """Writes a new version and gives its number; parts with a cell column are laid out by cell."""
    spark = c.main.sparkSession
    number = max(_numbers(spark, path), default=0) + 1
    parts = {p: getattr(c, p) for p in PARTS} | (extra or {})
    for name, rows in parts.items():
        out = rows.repartition(CELL).write.partitionBy(CELL) if CELL in rows.columns and len(rows.columns) > 1 else rows.write
        out.parquet(f"{path}/v{number}/{name}")
    schemas = {name: rows.schema.jsonValue() for name, rows in parts.items()}
    manifest = {"format": FORMAT, "parts": sorted(parts), "schemas": schemas, "next_id": c.next_id, "next_seq": c.next_seq, "metric": c.metric, "dim": c.dim}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/v{number}/manifest")
    return number


def load(spark: SparkSession, path: str, version: int | None = None) -> tuple[Collection, dict[str, DataFrame]]:
    """The collection and the extra parts of a version, the newest whole one by default.

    Raises ValueError where there is none, on another format, or if a part is missing.
    """
    from pyspark.sql.types import StructType

    there = versions(spark, path)
    number = version if version is not None else max(there, default=None)
    if number not in there:
        raise ValueError(f"no snapshot at {path}" if version is None else f"no version {version} at {path}")
    manifest = json.loads("".join(r[0] for r in spark.read.text(f"{path}/v{number}/manifest").collect()))
    if manifest.get("format") != FORMAT:
        raise ValueError(f"unknown snapshot format {manifest.get('format')!r}")
    parts = {}
    for name in manifest["parts"]:
        at, fs = _folder(spark, f"{path}/v{number}/{name}")
        if not fs.exists(at):
            raise ValueError(f"snapshot at {path} lacks the part {name}")
        schema = StructType.fromJson(manifest["schemas"][name])
        parts[name] = spark.read.schema(schema).parquet(f"{path}/v{number}/{name}").select(*schema.names)
    c = Collection(*(parts.pop(p) for p in PARTS), manifest["next_id"], manifest["next_seq"], manifest["metric"], manifest["dim"])
    return c, parts


def prune(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Deletes all but the newest ``keep`` whole versions, and older unfinished ones; gives the numbers that are gone.

    What was loaded from a deleted version can no longer be read.
    """
    whole = versions(spark, path)
    kept = set(whole[-keep:]) if keep > 0 else set()
    gone = [n for n in _numbers(spark, path) if n not in kept and whole and n <= whole[-1]]
    for n in gone:
        at, fs = _folder(spark, f"{path}/v{n}")
        fs.delete(at, True)
    return gone


def read_fvecs(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(id, embedding) of a file of rows, each a little-endian length and as many 32-bit floats.

    Records have a fixed size, so a row's number follows from its place: the file is read
    as records by Hadoop's splits, counted by split, and decoded a split at a time.
    """
    import numpy as np

    size = 4 + 4 * dim
    records = spark.sparkContext.binaryRecords(path, size)
    counts = records.mapPartitionsWithIndex(lambda p, rows: [(p, sum(1 for _ in rows))]).collect()
    first, total = {}, 0
    for p, n in sorted(counts):
        first[p], total = total, total + n

    def decode(p, rows):
        held, number = [], first[p]

        def given():
            x = np.frombuffer(b"".join(held), "<u4").reshape(-1, dim + 1)
            if (x[:, 0] != dim).any():
                raise ValueError("a row has another dimension")
            return x[:, 1:].view("<f4")

        for row in rows:
            held.append(row)
            if len(held) * size >= SPLIT:
                for x in given().tolist():
                    yield number, x
                    number += 1
                held = []
        if held:
            for x in given().tolist():
                yield number, x
                number += 1

    return spark.createDataFrame(records.mapPartitionsWithIndex(decode), "id long, embedding array<float>")


def from_arrays(spark: SparkSession, vectors, ids=None, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(id, embedding) of a 2-D array of numbers, an Arrow table or array, or what gives such an array.

    For queries and points that a program holds in memory; ids are the rows' numbers by
    default. Raises ValueError for another number of dimensions or of ids.
    """
    import numpy as np
    import pyarrow as pa

    if isinstance(vectors, (pa.Array, pa.ChunkedArray)):
        vectors = vectors.to_pylist()
    x = np.asarray(vectors)
    x = x[None] if x.ndim == 1 and x.dtype != object and x.size else x
    if x.size == 0:
        x = x.reshape(0, 0)
    if x.ndim != 2 or x.dtype == object:
        raise ValueError("vectors must be the rows of one matrix")
    kind = pa.float32() if x.dtype == np.float32 else pa.float64()
    ids = np.arange(len(x)) if ids is None else np.asarray(ids)
    if len(ids) != len(x):
        raise ValueError("there must be one id for each vector")
    offsets = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] if len(x) else 0)
    rows = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(x).ravel(), kind))
    return spark.createDataFrame(pa.table({id_col: pa.array(ids, pa.int64()), vector_col: rows}))
