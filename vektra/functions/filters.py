"""Filters: engine metadata, and nested dictionaries over payloads, compiled to columns.

A compiled predicate is an ordinary column, so it is pushed into the scan. Fields are
columns, dotted paths into structs, or paths into a VARIANT column. A missing field is
not the same as a null one: where a schema knows a field, it counts as present unless
the caller says which column tells its presence.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def metadata_filter(tenant: str | None = None, acl: Sequence[str] | None = None, since: int | None = None, until: int | None = None, tenant_col: str = "tenant", acl_col: str = "acl", ts_col: str = "ts") -> Column:
    """Tenant equality, any of the ACL tags and an inclusive time range, all that are given. Null never matches."""
    parts = []
    if tenant is not None:
        parts.append(F.col(tenant_col) == tenant)
    if acl:
        parts.append(F.arrays_overlap(F.col(acl_col), F.array(*[F.lit(a) for a in acl])))
    if since is not None:
        parts.append(F.col(ts_col) >= since)
    if until is not None:
        parts.append(F.col(ts_col) <= until)
    return F.coalesce(reduce(lambda a, b: a & b, parts, F.lit(True)), F.lit(False))


class Fields:
    """How a filter reads a field: its column, type and presence.

    ``present`` maps a field to the column that tells whether its key exists.
    """

    def __init__(self, schema: T.StructType, present: Mapping[str, Column] | None = None, id_col: str = "id"):
        self.schema, self.present, self.id_col = schema, dict(present or {}), id_col

    def look(self, path: str) -> tuple[Column | None, T.DataType | None]:
        """Column and type: the literal name first, then a walk into structs; (None, None) if the schema lacks it."""
        if path == "$id":
            path = self.id_col
        if path in self.schema.names:
            return F.col(f"`{path}`"), self.schema[path].dataType
        kind: T.DataType = self.schema
        column = None
        for name in path.split("."):
            if isinstance(kind, T.VariantType):
                rest = path.split(".")[path.split(".").index(name) :]
                return F.try_variant_get(column, F.lit("$." + ".".join(rest)), "variant"), kind
            if not isinstance(kind, T.StructType) or name not in kind.names:
                return None, None
            kind = kind[name].dataType
            column = F.col(f"`{name}`") if column is None else column.getField(name)
        return column, kind

    def exists(self, path: str) -> Column:
        column, kind = self.look(path)
        if column is None:
            return F.lit(False)
        if path in self.present:
            return self.present[path]
        return column.isNotNull() if isinstance(kind, T.VariantType) else F.lit(True)


_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _comparable(kind: T.DataType, value: Any) -> bool:
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(value, (int, float)):
        return isinstance(kind, _NUMERIC)
    if isinstance(value, str):
        return isinstance(kind, T.StringType)
    return isinstance(kind, (T.DateType, T.TimestampType))


def _typed(column: Column, kind: T.DataType, value: Any) -> tuple[Column, T.DataType]:
    """A VARIANT field read as the type that the value asks for."""
    if not isinstance(kind, T.VariantType):
        return column, kind
    name, of = ("boolean", T.BooleanType()) if isinstance(value, bool) else ("double", T.DoubleType()) if isinstance(value, (int, float)) else ("string", T.StringType())
    return F.try_variant_get(column, F.lit("$"), name), of


def _equal(fields: Fields, path: str, value: Any) -> Column:
    column, kind = fields.look(path)
    if column is None:
        return F.lit(False)
    if value is None:
        return fields.exists(path) & column.isNull()
    column, kind = _typed(column, kind, value)
    if isinstance(kind, T.ArrayType):
        hit = F.exists(column, lambda x: x == F.lit(value)) if _comparable(kind.elementType, value) else F.lit(False)
    else:
        hit = column == F.lit(value) if _comparable(kind, value) else F.lit(False)
    return F.coalesce(hit, F.lit(False))


_ORDER = {"$gt": Column.__gt__, "$gte": Column.__ge__, "$lt": Column.__lt__, "$lte": Column.__le__}


def _ordered(fields: Fields, path: str, op: str, value: Any) -> Column:
    column, kind = fields.look(path)
    if column is None or value is None or isinstance(value, bool):
        return F.lit(False)
    column, kind = _typed(column, kind, value)
    if isinstance(kind, T.ArrayType):
        hit = F.exists(column, lambda x: _ORDER[op](x, F.lit(value))) if _comparable(kind.elementType, value) else F.lit(False)
    else:
        hit = _ORDER[op](column, F.lit(value)) if _comparable(kind, value) else F.lit(False)
    return F.coalesce(hit, F.lit(False))


def _many(value: Any) -> list:
    return list(value) if isinstance(value, (list, tuple, set, frozenset)) else [value]


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _empty(fields: Fields, path: str) -> Column:
    column, kind = fields.look(path)
    if column is None:
        return F.lit(True)
    nothing = column.isNull()
    if isinstance(kind, (T.ArrayType, T.MapType)):
        nothing = nothing | (F.size(column) == 0)
    elif isinstance(kind, T.StringType):
        nothing = nothing | (column == "")
    return F.coalesce(nothing, F.lit(True))


def _holds(fields: Fields, path: str, value: Any) -> Column:
    column, kind = fields.look(path)
    if column is None:
        return F.lit(False)
    column, kind = _typed(column, kind, value)
    if isinstance(kind, T.StringType) and isinstance(value, str):
        return F.coalesce(column.contains(value), F.lit(False))
    return _equal(fields, path, value) if isinstance(kind, T.ArrayType) else F.lit(False)


def _condition(fields: Fields, path: str, op: str, value: Any) -> Column:
    if op == "$eq":
        return _equal(fields, path, value)
    if op == "$ne":
        return ~_equal(fields, path, value)
    if op in ("$in", "$nin"):
        hit = _any([_equal(fields, path, v) for v in _many(value)])
        return hit if op == "$in" else ~hit
    if op in _ORDER:
        return _ordered(fields, path, op, value)
    if op == "$exists":
        return fields.exists(path) == F.lit(bool(value))
    if op == "$null":
        column, _ = fields.look(path)
        return (F.lit(False) if column is None else fields.exists(path) & column.isNull()) == F.lit(bool(value))
    if op == "$empty":
        return _empty(fields, path) == F.lit(bool(value))
    if op == "$all":
        _, kind = fields.look(path)
        return _all([_equal(fields, path, v) for v in _many(value)]) if isinstance(kind, T.ArrayType) else F.lit(False)
    if op == "$contains":
        return _holds(fields, path, value)
    raise ValueError(f"unknown filter operator {op!r}")


def compile_filter(spec: Mapping[str, Any] | None, fields: Fields) -> Column:
    """A predicate column from a nested dictionary; None and {} accept every row.

    Keys are and-ed. ``$and $or $not $nor`` take one dictionary or a list of them. A
    field's value is compared for equality or is a dictionary of operators: ``$eq $ne
    $in $nin $gt $gte $lt $lte $exists $null $empty $all $contains``. A condition on a
    missing field is false, and so its negation true. Comparisons across types are
    false. Raises TypeError for what is no dictionary and ValueError for unknown
    operators or operators mixed with plain keys.
    """
    if spec is None:
        return F.lit(True)
    if not isinstance(spec, Mapping):
        raise TypeError("a filter must be a dictionary")
    parts = []
    for key, value in spec.items():
        if key in ("$and", "$or", "$not", "$nor"):
            subs = [compile_filter(s, fields) for s in ([value] if isinstance(value, Mapping) else value)]
            parts.append({"$and": _all, "$or": _any, "$not": lambda s: ~_all(s), "$nor": lambda s: ~_any(s)}[key](subs))
        elif key.startswith("$") and key != "$id":
            raise ValueError(f"unknown filter operator {key!r}")
        elif isinstance(value, Mapping) and any(str(k).startswith("$") for k in value):
            if not all(str(k).startswith("$") for k in value):
                raise ValueError("operators and plain keys cannot be mixed")
            parts.append(_all([_condition(fields, key, op, v) for op, v in value.items()]))
        else:
            parts.append(_equal(fields, key, value))
    return _all(parts)


def prefix_filter(spec: Any, prefix: str) -> Any:
    """The filter with ``prefix`` before every field name; ``$id`` stays."""
    if isinstance(spec, Mapping):
        return {(k if str(k).startswith("$") else prefix + k): (prefix_filter(v, prefix) if k in ("$and", "$or", "$not", "$nor") else v) for k, v in spec.items()}
    return [prefix_filter(s, prefix) for s in spec] if isinstance(spec, (list, tuple)) else spec


def from_clauses(clauses: Mapping[str, Any] | None) -> dict:
    """A filter from ``must``, ``should`` and ``must_not`` lists of conditions.

    A condition is a nested clause dictionary, ``{"has_id": [...]}``, ``{"is_null":
    {"key": k}}``, ``{"is_empty": {"key": k}}`` or ``{"key": k, "match" | "range": ...}``
    with match ``value``, ``any``, ``except`` or ``text`` and range ``gt gte lt lte``.
    """
    out: dict[str, list] = {}
    for name, op in (("must", "$and"), ("should", "$or"), ("must_not", "$nor")):
        got = (clauses or {}).get(name) or []
        got = [got] if isinstance(got, Mapping) else got
        if got:
            out[op] = [_clause(c) for c in got]
    return out


def _clause(c: Mapping[str, Any]) -> dict:
    if any(k in c for k in ("must", "should", "must_not")):
        return from_clauses(c)
    if "has_id" in c:
        return {"$id": {"$in": list(c["has_id"])}}
    if "is_null" in c:
        return {c["is_null"]["key"]: {"$null": True}}
    if "is_empty" in c:
        return {c["is_empty"]["key"]: {"$empty": True}}
    key = c["key"]
    if "range" in c:
        return {key: {f"${k}": v for k, v in c["range"].items() if v is not None}}
    match = c["match"]
    for name, op in (("value", "$eq"), ("any", "$in"), ("except", "$nin"), ("text", "$contains")):
        if name in match:
            return {key: {op: match[name]}}
    raise ValueError(f"unknown condition {c!r}")


#: Comparison signs of retriever filters and what they stand for.
SIGNS = {"==": "$eq", "eq": "$eq", "!=": "$ne", "ne": "$ne", ">": "$gt", "gt": "$gt", ">=": "$gte", "gte": "$gte", "<": "$lt", "lt": "$lt", "<=": "$lte", "lte": "$lte", "in": "$in", "nin": "$nin", "any": "$contains", "all": "$all", "contains": "$contains", "text_match": "$contains", "is_empty": "$empty"}


def from_triples(filters: Sequence, condition: str = "and") -> dict:
    """A filter from (key, sign, value) triples and nested (condition, filters) pairs."""
    parts = []
    for f in filters:
        if len(f) == 2:
            parts.append(from_triples(f[1], f[0]))
        else:
            key, sign, value = f
            if sign not in SIGNS:
                raise ValueError(f"unknown sign {sign!r}")
            parts.append({key: {SIGNS[sign]: True if sign == "is_empty" else value}})
    if condition not in ("and", "or", "not"):
        raise ValueError(f"unknown condition {condition!r}")
    return {f"${condition}": parts} if parts else {}
