"""What client libraries make of a distance: similarity, score and relevance columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import metric_name


def _by_metric(metric: str, d: Column, l2: Column, cosine: Column | None = None, ip: Column | None = None) -> Column:
    return {"l2": l2, "cosine": 1 - d if cosine is None else cosine, "ip": -d if ip is None else ip}[metric_name(metric)]


def root(d: Column) -> Column:
    return F.sqrt(F.greatest(d, F.lit(0.0)))


def similarity(metric: str, d: Column) -> Column:
    return _by_metric(metric, d, 1 / (1 + d))


def client_score(metric: str, d: Column) -> Column:
    """Euclidean distance itself under l2, else a similarity."""
    return _by_metric(metric, d, root(d))


def relevance(metric: str, d: Column) -> Column:
    """May be negative under l2."""
    return _by_metric(metric, d, 1 - root(d) / math.sqrt(2))


def retriever_score(metric: str, d: Column) -> Column:
    """Within 0 and 1 for every metric."""
    half = F.least(F.greatest(1 - d / 2, F.lit(0.0)), F.lit(1.0))
    return _by_metric(metric, d, F.greatest(1 - root(d) / math.sqrt(2), F.lit(0.0)), half, 1 / (1 + F.exp(d)))


def passes(metric: str, score: Column, threshold: float) -> Column:
    """Whether a client score passes: at most the threshold under l2, at least it otherwise. Use after top-k."""
    return score <= threshold if metric_name(metric) == "l2" else score >= threshold
