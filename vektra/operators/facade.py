"""Client-style calls over collections: named collections, a text retriever, a node store."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.filters import from_clauses, from_triples
from ..functions.vectors import metric_name
from . import collection as col
from .lineage import settle
from .sparse import mmr


#: Where string ids are kept; points have numbers of their own beside them.
KEY = "external_id"


def _by_key(spec: Any) -> Any:
    """A filter with ``$id`` read as the string id."""
    if isinstance(spec, Mapping):
        return {KEY if k == "$id" else k: _by_key(v) for k, v in spec.items()}
    return [_by_key(s) for s in spec] if isinstance(spec, (list, tuple)) else spec


class Collections:
    """Named collections with create, upsert, search, scroll and the rest of a client's calls.

    With ``string_ids`` callers' ids are strings, and points that come with none get a
    random one; numbers are given within, and results name points by their strings.
    """

    def __init__(self, spark: SparkSession, payload: str = "", string_ids: bool = False):
        self.spark, self.named, self.string_ids = spark, {}, string_ids
        self.payload = ", ".join(p for p in (f"{KEY} string" if string_ids else "", payload) if p)

    def _spec(self, clauses: Mapping | None) -> dict:
        spec = from_clauses(clauses)
        return _by_key(spec) if self.string_ids else spec

    def _numbers(self, name: str, ids: DataFrame) -> DataFrame:
        """``ids`` with the points' own numbers; unknown strings have none."""
        if not self.string_ids:
            return ids
        known = self[name].live().select(F.col(KEY).alias("_key"), F.col("id").alias("_number"))
        return ids.join(known, F.col("id") == F.col("_key"), "left").withColumn("id", F.col("_number")).drop("_key", "_number")

    def _named(self, rows: DataFrame) -> DataFrame:
        """Points by their strings."""
        return rows.withColumn("id", F.col(KEY)).drop(KEY) if self.string_ids else rows

    def _numbered(self, c: col.Collection, rows: DataFrame) -> DataFrame:
        """Points with numbers: those that their strings have already, or new ones. Of a string the last row counts."""
        rows = settle(rows.withColumn(KEY, F.coalesce(F.col("id").cast("string"), F.expr("uuid()"))))
        newest = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("seq")))
        rows = rows.withColumn("_r", newest).where("_r = 1").drop("_r", "id")
        known = c.live().select(F.col(KEY).alias("_key"), "id")
        met = settle(rows.join(known, F.col(KEY) == F.col("_key"), "left").drop("_key"))
        new = col._numbered(met.where("id is null").drop("id"), c.next_id, "id")
        return met.where("id is not null").unionByName(new)

    def create(self, name: str, dim: int, metric: str = "cosine") -> None:
        if name in self.named:
            raise ValueError(f"collection {name!r} exists")
        schema = "id long, embedding array<double>, seq long" + (f", {self.payload}" if self.payload else "")
        none = self.spark.createDataFrame([], schema)
        self.named[name] = col.Collection(none, none, none.select("id"), 0, 0, metric_name(metric), dim)

    def recreate(self, name: str, dim: int, metric: str = "cosine") -> None:
        self.named.pop(name, None)
        self.create(name, dim, metric)

    def drop(self, name: str) -> bool:
        return self.named.pop(name, None) is not None

    def exists(self, name: str) -> bool:
        return name in self.named

    def get_collection(self, name: str) -> dict[str, Any]:
        c = self[name]
        return {"metric": c.metric, "dim": c.dim, "points": c.count()}

    def __getitem__(self, name: str) -> col.Collection:
        return self.named[name]

    def upsert(self, name: str, points: DataFrame) -> None:
        c = self[name]
        rows = points if "seq" in points.columns else col._numbered(points, c.next_seq, "seq")
        self.named[name] = col.upsert(c, self._numbered(c, rows) if self.string_ids else rows)

    def delete(self, name: str, ids: DataFrame | None = None, clauses: Mapping | None = None) -> int:
        ids = None if ids is None else self._numbers(name, ids).where("id is not null")
        self.named[name], n = col.delete(self[name], ids, None if clauses is None else self._spec(clauses))
        return n

    def retrieve(self, name: str, ids: DataFrame) -> DataFrame:
        return self._named(col.get(self[name], self._numbers(name, ids)).where(F.col("seq").isNotNull()))

    def count(self, name: str, clauses: Mapping | None = None) -> int:
        return self[name].count(self._spec(clauses))

    def scroll(self, name: str, limit: int = 10, offset: int | None = None, clauses: Mapping | None = None):
        """A page and the number that the next page starts with (a point's own number, also with string ids)."""
        page, after = col.scroll(self[name].where(self._spec(clauses)), limit, offset)
        return self._named(page), after

    def search(self, name: str, queries: DataFrame, limit: int = 10, clauses: Mapping | None = None, threshold: float | None = None, with_payload: bool = True, with_vectors: bool = False) -> DataFrame:
        """(query_id, rank, id, score, ...); a threshold applies to the k best, not before."""
        c = self[name]
        found = col.search(c, queries, limit, self._spec(clauses)).withColumn("score", scores.client_score(c.metric, F.col("distance")))
        if threshold is not None:
            found = found.where(scores.passes(c.metric, F.col("score"), threshold))
        payload = [x for x in c.main.columns if x not in ("id", "embedding", "seq", KEY)] if with_payload else []
        return self._named(found).select("query_id", "rank", "id", "score", *payload, *["embedding"] * with_vectors)


class Retriever:
    """Texts in, texts out: ``embed`` gives each text its vector (a column function)."""

    def __init__(self, spark: SparkSession, embed: Callable, dim: int, metric: str = "cosine", metadata: str = ""):
        self.spark, self.embed = spark, embed
        self.store = Collections(spark, "text string, ref string" + (f", {metadata}" if metadata else ""))
        self.store.create("texts", dim, metric)

    @property
    def collection(self) -> col.Collection:
        return self.store["texts"]

    @classmethod
    def from_texts(cls, texts: DataFrame, embed: Callable, dim: int, **options) -> Retriever:
        out = cls(texts.sparkSession, embed, dim, **options)
        out.add_texts(texts)
        return out

    def add_texts(self, texts: DataFrame) -> None:
        """Rows (id, text, metadata ...); embeds and upserts them."""
        self.store.upsert("texts", texts.withColumn("embedding", self.embed(F.col("text"))))

    def delete(self, ids: DataFrame | None = None, ref: str | None = None) -> int:
        """By ids or by the document they refer to; neither clears everything."""
        if ids is None and ref is None:
            n = self.collection.count()
            self.store.named["texts"] = col.clear(self.collection)
            return n
        self.store.named["texts"], n = col.delete(self.collection, ids, None if ref is None else {"ref": ref})
        return n

    def get_by_ids(self, ids: DataFrame) -> DataFrame:
        return self.store.retrieve("texts", ids)

    def _asked(self, questions: DataFrame) -> DataFrame:
        return questions.select("query_id", self.embed(F.col("text")).alias("q"))

    def similarity_search(self, questions: DataFrame, k: int = 4, filters: Sequence | None = None, condition: str = "and") -> DataFrame:
        """(query_id, rank, id, text, score), score within 0 and 1."""
        return self.by_vector(self._asked(questions), k, filters, condition)

    def by_vector(self, queries: DataFrame, k: int = 4, filters: Sequence | None = None, condition: str = "and") -> DataFrame:
        spec = from_triples(filters, condition) if filters else None
        found = col.search(self.collection, queries, k, spec)
        return found.withColumn("score", scores.retriever_score(self.collection.metric, F.col("distance"))).drop("embedding", "seq")

    def max_marginal_relevance(self, questions: DataFrame, k: int = 4, fetch_k: int = 20, balance: float = 0.5) -> DataFrame:
        """(query_id, rank, id, text): k of the ``fetch_k`` nearest, relevant and unlike each other."""
        asked = self._asked(questions)
        near = col.search(self.collection, asked, max(fetch_k, k)).join(asked, "query_id")
        return mmr(near.select("query_id", "id", "q", "embedding"), k, balance).join(self.collection.live().select("id", "text"), "id")
