"""A collection: main points, an append-only delta, tombstones, payloads.

State is three DataFrames; an operation gives a new collection and leaves the old one as
it was. Points are (id, embedding, seq, ... payload columns); ``seq`` is the order of
insertion. Reads see live rows: main and delta without tombstones.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import Fields, compile_filter
from ..functions.vectors import metric_name, normalize
from .knn import knn
from .lineage import settle


@dataclass(frozen=True)
class Collection:
    main: DataFrame
    delta: DataFrame
    tombstones: DataFrame
    next_id: int
    next_seq: int
    metric: str = "l2"
    dim: int | None = None

    def live(self) -> DataFrame:
        """Main and delta rows that are not deleted."""
        return self.main.unionByName(self.delta).join(self.tombstones, "id", "left_anti")

    def count(self, spec: Mapping[str, Any] | None = None) -> int:
        return self.where(spec).count()

    def sizes(self) -> dict[str, int]:
        return {"live": self.live().count(), "delta": self.delta.count(), "tombstones": self.tombstones.count(), "next_id": self.next_id}

    def where(self, spec: Mapping[str, Any] | None) -> DataFrame:
        live = self.live()
        return live if not spec else live.where(compile_filter(spec, Fields(live.schema)))


def normalized(rows: DataFrame, metric: str) -> DataFrame:
    """Under cosine, vectors are kept as unit vectors."""
    return rows.withColumn("embedding", normalize(F.col("embedding"))) if metric_name(metric) == "cosine" else rows


def check_dim(rows: DataFrame, dim: int | None) -> int | None:
    """The one length of all vectors; raises ValueError on null, empty or mixed lengths."""
    got = rows.agg(F.min(F.coalesce(F.size("embedding"), F.lit(-1))), F.max(F.coalesce(F.size("embedding"), F.lit(-1)))).first()
    if got[0] is None:
        return dim
    if got[0] != got[1] or got[0] < 1 or got[0] > 4096 or (dim is not None and got[0] != dim):
        raise ValueError(f"vectors must have one length within 1 and 4096{'' if dim is None else f', here {dim}'}")
    return got[0]


def build(points: DataFrame, metric: str = "l2") -> Collection:
    """A collection of all points; raises ValueError if there are none."""
    rows = points if "seq" in points.columns else points.withColumn("seq", F.col("id"))
    dim = check_dim(rows, None)
    if dim is None:
        raise ValueError("cannot build from no points")
    rows = normalized(rows.withColumn("embedding", F.col("embedding").cast("array<double>")), metric)
    top = rows.agg(F.max("id"), F.max("seq")).first()
    return Collection(rows, rows.limit(0), rows.select("id").limit(0), top[0] + 1, top[1] + 1, metric_name(metric), dim)


def _numbered(rows: DataFrame, first: int, name: str) -> DataFrame:
    """Consecutive numbers from ``first``, by partition: counts of partitions go to the driver, rows do not move."""
    rows = settle(rows.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    before, total = {}, first
    for p, n in sorted((r["_p"], r["count"]) for r in rows.groupBy("_p").count().collect()):
        before[p], total = total, total + n
    if not before:
        return rows.drop("_p", "_i").withColumn(name, F.lit(first).cast("long"))
    start = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])
    place = F.row_number().over(Window.partitionBy("_p").orderBy("_i")) - 1
    return rows.withColumn(name, (F.element_at(start, F.col("_p")) + place).cast("long")).drop("_p", "_i")


def add(c: Collection, vectors: DataFrame) -> Collection:
    """Appends vectors with ids from ``next_id`` on; they are found by the next search."""
    check_dim(vectors, c.dim)
    n = vectors.count()
    rows = _numbered(vectors, c.next_id, "id").withColumn("seq", F.col("id") - c.next_id + c.next_seq)
    for f in c.main.schema:
        if f.name not in rows.columns:
            rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
    rows = normalized(rows.withColumn("embedding", F.col("embedding").cast("array<double>")), c.metric).select(*c.main.columns)
    return replace(c, delta=c.delta.unionByName(rows), next_id=c.next_id + n, next_seq=c.next_seq + n)


def delete(c: Collection, ids: DataFrame | None = None, spec: Mapping[str, Any] | None = None) -> tuple[Collection, int]:
    """Marks live points of the ids and of the filter; how many newly died. ``{}`` is a filter that all pass; nothing given, nothing dies."""
    doomed = c.main.select("id").limit(0)
    if ids is not None:
        doomed = doomed.union(c.live().join(ids.select("id").distinct(), "id", "left_semi").select("id"))
    if spec is not None:
        doomed = doomed.union(c.where(spec).select("id"))
    doomed = settle(doomed.distinct())
    return replace(c, tombstones=c.tombstones.union(doomed)), doomed.count()


def latest(rows: DataFrame) -> DataFrame:
    """The last row of each id, by seq."""
    newest = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("seq")))
    return rows.withColumn("_r", newest).where("_r = 1").drop("_r")


def upsert(c: Collection, rows: DataFrame) -> Collection:
    """Replaces or adds points; within ``rows`` the last of an id wins, by seq."""
    check_dim(rows, c.dim)
    new = settle(normalized(latest(rows).withColumn("embedding", F.col("embedding").cast("array<double>")), c.metric))
    for f in c.main.schema:
        if f.name not in new.columns:
            new = new.withColumn(f.name, F.lit(None).cast(f.dataType))
    new = new.select(*c.main.columns)
    gone = new.select("id")
    top = new.agg(F.max("id"), F.max("seq")).first()
    return replace(
        c,
        main=c.main.join(gone, "id", "left_anti"),
        delta=c.delta.join(gone, "id", "left_anti").unionByName(new),
        tombstones=c.tombstones.join(gone, "id", "left_anti"),
        next_id=max(c.next_id, (top[0] if top[0] is not None else -1) + 1),
        next_seq=max(c.next_seq, (top[1] if top[1] is not None else -1) + 1),
    )


def set_payload(c: Collection, ids: DataFrame, values: Mapping[str, Any], overwrite: bool = False) -> Collection:
    """Sets payload columns of the ids' points; with ``overwrite`` the others become null. Unknown ids are skipped."""
    marks = ids.select("id", F.lit(True).alias("_hit")).distinct()

    def put(rows: DataFrame) -> DataFrame:
        rows = rows.join(marks, "id", "left")
        out = []
        for f in c.main.schema:
            column = F.col(f.name)
            if f.name in values:
                column = F.when(F.col("_hit"), F.lit(values[f.name]).cast(f.dataType)).otherwise(column)
            elif overwrite and f.name not in ("id", "embedding", "seq"):
                column = F.when(F.col("_hit"), F.lit(None)).otherwise(column)
            out.append(column.alias(f.name))
        return rows.select(*out)

    return replace(c, main=put(c.main), delta=put(c.delta))


def get(c: Collection, ids: DataFrame) -> DataFrame:
    """(pos, id, ...) in the order asked for; unknown ids have null in the other columns."""
    return ids.select("pos", "id").join(c.live(), "id", "left").orderBy("pos")


def scroll(live: DataFrame, limit: int, offset: int | None = None) -> tuple[DataFrame, int | None]:
    """A page in the order of insertion from the point ``offset`` on, and the id that the next page starts with."""
    rows = live
    if offset is not None:
        at = live.where(F.col("id") == offset).select("seq").first()
        if at is None:
            raise KeyError(offset)
        rows = live.where(F.col("seq") >= at[0])
    page = rows.orderBy("seq").limit(limit + 1)
    more = page.select("id", "seq").orderBy("seq").collect()
    return rows.orderBy("seq").limit(limit), more[limit]["id"] if len(more) > limit else None


def clear(c: Collection) -> Collection:
    return replace(c, main=c.main.limit(0), delta=c.delta.limit(0), tombstones=c.tombstones.limit(0))


def compact(c: Collection) -> Collection:
    """Main rebuilt from what lives, with ids kept; the same collection if there is nothing to do."""
    if c.delta.isEmpty() and c.tombstones.isEmpty():
        return c
    rows = settle(c.live())
    return replace(c, main=rows, delta=rows.limit(0), tombstones=c.tombstones.limit(0))


def reconcile(rebuilt: Collection, now: Collection, watermark: int) -> Collection:
    """A compaction that ran aside joined with what happened meanwhile: inserts from the watermark on, and deletes."""
    tail = now.delta.where(F.col("id") >= watermark)
    known = rebuilt.main.select("id").union(tail.select("id"))
    return replace(rebuilt, delta=tail, tombstones=now.tombstones.join(known, "id", "left_semi"), next_id=max(rebuilt.next_id, now.next_id, watermark), next_seq=max(rebuilt.next_seq, now.next_seq))


def search(c: Collection, queries: DataFrame, k: int = 10, spec: Mapping[str, Any] | None = None, strategy=knn) -> DataFrame:
    """k nearest live points that pass the filter, with their payload columns.

    The filter is a column, so it runs before any distance; ``strategy`` is any search
    with the interface of ``knn``.
    """
    allowed = c.where(spec)
    asked = queries.withColumn("q", normalize(F.col("q"))) if c.metric == "cosine" else queries
    found = strategy(allowed.select("id", "embedding"), asked, k, c.metric)
    return found.join(allowed, "id")


STRATEGIES = {"exact": knn}


def register(name: str, strategy) -> None:
    """Adds a search strategy, a function (points, queries, k, metric) to a result DataFrame."""
    STRATEGIES[name] = strategy


#: What callers name an algorithm, and the strategy it stands for; a hyphen is as good as an underscore, other names are a graph search.
ALGORITHMS = {"exact": "exact", "flat": "exact", "brute": "exact", "ivf": "ivf_pq", "pq": "ivf_pq", "ivf_pq": "ivf_pq", "ivfpq": "ivf_pq", "ivf_sq8": "ivf_sq8", "sq8": "ivf_sq8", "ivf_rabitq": "ivf_rabitq", "rabitq": "ivf_rabitq", "fp16": "fp16", "cagra": "cagra", "hnsw": "hnsw"}


def algorithm(name: str | None, use_ivf: bool = False) -> str:
    if name is None:
        return "ivf_pq" if use_ivf else "hnsw"
    return ALGORITHMS.get(name.strip().lower().replace("-", "_"), "hnsw")
