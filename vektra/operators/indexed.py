"""A collection that owns its indexes: trained at build, stored with snapshots, kept up with inserts and deletes.

An index covers the main points. Inserts lie in the delta and are searched exactly;
deletes are tombstones. Both lists are merged, so a search sees what lives at once.
Compaction encodes the delta with the trained quantisers or, on demand, trains anew.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.filters import Fields, compile_filter
from ..functions.vectors import normalize
from . import collection as col
from . import graph, ivf, train
from .knn import knn, merge_topk, search_fp16
from .lineage import settle

IVF = ("ivf_pq", "ivf_sq8", "ivf_rabitq")
GRAPHS = ("hnsw", "cagra")
FAMILIES = IVF + GRAPHS


@dataclass(frozen=True)
class Indexed:
    """A collection and the parts of its indexes, by name: cells and codes of inverted files, graphs."""

    points: col.Collection
    parts: dict[str, DataFrame] = field(default_factory=dict)

    def families(self) -> list[str]:
        has = {"ivf_pq": "pq_codes", "ivf_sq8": "sq8_codes", "ivf_rabitq": "rabitq_codes", "hnsw": "hnsw", "cagra": "cagra"}
        return [f for f in FAMILIES if has[f] in self.parts]


def _codes(points: DataFrame, parts: Mapping[str, DataFrame], families) -> dict[str, DataFrame]:
    """Codes of points by the trained parts."""
    out = {}
    if not any(f in families for f in IVF):
        return out
    assigned = settle(train.kmeans_assign(points, parts["centroids"]))
    res = settle(train.residuals(points, assigned, parts["centroids"]))
    if "ivf_pq" in families:
        m = parts["codebook"].agg(F.max("m") + 1).first()[0]
        out["pq_codes"] = settle(train.pq_encode(res, parts["codebook"], m))
    if "ivf_sq8" in families:
        out["sq8_codes"] = settle(train.sq8_encode(res, parts["sq8_params"]))
    if "ivf_rabitq" in families:
        out["rabitq_codes"] = settle(train.rabitq_encode(res, points))
    return out


def _trained(points: DataFrame, families, lists: int, m: int | None, links: int, ef_construction: int, shard_rows: int) -> dict[str, DataFrame]:
    unknown = set(families) - set(FAMILIES)
    if unknown:
        raise ValueError(f"unknown index families {sorted(unknown)}")
    parts, rows = {}, points.select("id", "embedding")
    if any(f in families for f in IVF):
        parts["centroids"] = settle(train.kmeans_fit(rows, lists))
        assigned = settle(train.kmeans_assign(rows, parts["centroids"]))
        res = settle(train.residuals(rows, assigned, parts["centroids"]))
        if "ivf_pq" in families:
            dim = res.select(F.size("residual")).first()[0]
            parts["codebook"] = settle(train.pq_train(res, m or train.choose_parts(dim)))
        if "ivf_sq8" in families:
            parts["sq8_params"] = settle(train.sq8_fit(res))
        parts |= _codes(rows, parts, families)
    for kind in GRAPHS:
        if kind in families:
            parts[kind] = graph.build(rows, kind, links, ef_construction, shard_rows)
    return parts


def build(points: DataFrame, metric: str = "l2", families=("ivf_pq", "hnsw"), lists: int = 16, m: int | None = None, links: int = 32, ef_construction: int = 128, shard_rows: int = graph.SHARD_ROWS) -> Indexed:
    """A collection of all points with the named indexes trained and stored."""
    c = col.build(points, metric)
    c = replace(c, main=settle(c.main))
    return Indexed(c, _trained(c.main, families, lists, m, links, ef_construction, shard_rows))


def add(ix: Indexed, vectors: DataFrame) -> Indexed:
    return replace(ix, points=col.add(ix.points, vectors))


def delete(ix: Indexed, ids: DataFrame | None = None, spec: Mapping[str, Any] | None = None) -> tuple[Indexed, int]:
    points, n = col.delete(ix.points, ids, spec)
    return replace(ix, points=points), n


def upsert(ix: Indexed, rows: DataFrame) -> Indexed:
    """Replaces or adds points. What the index still holds of a replaced one is masked, as it left the main points."""
    return replace(ix, points=col.upsert(ix.points, rows))


def compact(ix: Indexed, retrain: bool = False, **options) -> Indexed:
    """Main rebuilt from what lives. Inverted files keep their quantisers unless ``retrain``; graphs are built anew."""
    families = ix.families()
    points = col.compact(ix.points)
    if points is ix.points and not retrain:
        return ix
    rows = points.main.select("id", "embedding")
    if retrain or not any(f in families for f in IVF):
        defaults = {"lists": 16, "m": None, "links": 32, "ef_construction": 128, "shard_rows": graph.SHARD_ROWS}
        return Indexed(points, _trained(rows, families, **defaults | options))
    parts = {p: ix.parts[p] for p in ("centroids", "codebook", "sq8_params") if p in ix.parts} | _codes(rows, ix.parts, families)
    for kind in GRAPHS:
        if kind in families:
            parts[kind] = graph.build(rows, kind, options.get("links", 32), options.get("ef_construction", 128), options.get("shard_rows", graph.SHARD_ROWS))
    return Indexed(points, parts)


def search(ix: Indexed, queries: DataFrame, k: int = 10, algorithm: str | None = None, spec: Mapping[str, Any] | None = None, allowed: DataFrame | None = None, nprobe: int = 8, rerank_k: int = 32, ef: int = 64) -> DataFrame:
    """(query_id, rank, id, distance) by the named algorithm over main points, exactly over the delta.

    ``spec`` filters by payload, ``allowed`` by ids (column ``id``); both hold for every
    algorithm, before any result is chosen. A name that the collection has no index for is an error.
    """
    c = ix.points
    name = "exact" if algorithm in ("exact", "flat", "brute") else "fp16" if algorithm == "fp16" else col.algorithm(algorithm)
    asked = queries.withColumn("q", normalize(F.col("q"))) if c.metric == "cosine" else queries
    dead = c.tombstones.select("id").distinct()

    def alive(rows: DataFrame) -> DataFrame:
        rows = rows.join(dead, "id", "left_anti")
        rows = rows.where(compile_filter(spec, Fields(rows.schema))) if spec else rows
        return rows if allowed is None else rows.join(allowed.select("id").distinct(), "id", "left_semi")

    main, delta = alive(c.main).select("id", "embedding"), alive(c.delta).select("id", "embedding")
    if name in ("exact", "fp16"):
        return (knn if name == "exact" else search_fp16)(main.unionByName(delta), asked, k, c.metric)
    if name not in ix.families():
        raise ValueError(f"the collection has no index for {name}")
    mask = main.select("id")  # replaced points are no longer in main
    if name in GRAPHS:
        found = graph.search(ix.parts[name], asked, k, ef, c.metric, name, mask)
    else:
        p = ix.parts
        options = {"k": k, "nprobe": nprobe, "rerank_k": rerank_k, "metric": c.metric, "allowed": mask}
        if name == "ivf_pq":
            m = p["codebook"].agg(F.max("m") + 1).first()[0]
            found = ivf.search_pq(main, asked, p["centroids"], p["pq_codes"], p["codebook"], m, **options)
        elif name == "ivf_sq8":
            found = ivf.search_sq8(main, asked, p["centroids"], p["sq8_codes"], p["sq8_params"], **options)
        else:
            found = ivf.search_rabitq(main, asked, p["centroids"], p["rabitq_codes"], **options)
    both = found.select("query_id", "id", "distance").unionByName(knn(delta, asked, k, c.metric).select("query_id", "id", "distance"))
    return merge_topk(both, k).select("query_id", "rank", "id", "distance")


def save(ix: Indexed, path: str) -> int:
    """A new version of collection and indexes; codes are laid out by cell."""
    from ..sources import snapshot

    return snapshot.save(ix.points, path, {f"index_{name}": rows for name, rows in ix.parts.items()})


def load(spark: SparkSession, path: str, version: int | None = None) -> Indexed:
    from ..sources import snapshot

    points, extra = snapshot.load(spark, path, version)
    return Indexed(points, {name.removeprefix("index_"): rows for name, rows in extra.items() if name.startswith("index_")})


def _once(family: str):
    """A strategy that trains an index for one search; a collection's own index saves that."""

    def run(points: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2") -> DataFrame:
        ix = build(points, metric, [family], lists=max(1, min(16, points.count() // 32)))
        return search(ix, queries, k, family, nprobe=16, rerank_k=max(256, 8 * k), ef=256)

    return run


for _family in FAMILIES:
    col.register(_family, _once(_family))
col.register("fp16", search_fp16)
