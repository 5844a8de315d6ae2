"""Vector arithmetic as columns: sequential double sums, smaller distance is nearer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to the product of norms under cosine, and the floor of a norm in normalisation.
EPSILON = 1e-8
#: Names of the metrics and what else they are called.
METRICS = {
    "l2": ("l2", "euclid", "euclidean", "squared_l2", "l2sq"),
    "cosine": ("cosine", "cos", "angular"),
    "ip": ("ip", "dot", "inner", "inner_product", "innerproduct", "max_inner_product"),
}
MOST_K = 256


def metric_name(name: str) -> str:
    """The metric an alias stands for; raises on others."""
    plain = str(name).strip().lower().replace("-", "_").replace(" ", "_")
    for metric, aliases in METRICS.items():
        if plain in aliases:
            return metric
    raise ValueError(f"unknown metric {name!r}; one of {', '.join(METRICS)}")


def check_k(k: int) -> int:
    if not 1 <= int(k) <= MOST_K:
        raise ValueError(f"top_k must be 1 to {MOST_K}")
    return int(k)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_l2(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def norm(v: Column) -> Column:
    return F.sqrt(_total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def normalize(v: Column) -> Column:
    """Unit vector, with the norm floored so that a zero vector stays zero."""
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm(v), F.lit(EPSILON)))


def distance(metric: str, a: Column, b: Column) -> Column:
    """l2: squared Euclidean; cosine: 1 - cos (a zero vector is at 1); ip: negated dot product."""
    metric = metric_name(metric)
    if metric == "l2":
        return squared_l2(a, b)
    if metric == "ip":
        return -dot(a, b)
    return 1 - dot(a, b) / (norm(a) * norm(b) + EPSILON)


def scaled(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") * by)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
