import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vektra.functions.filters import Fields, compile_filter, from_clauses, from_triples, metadata_filter, prefix_filter

SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("tag", T.ArrayType(T.StringType())),
        T.StructField("title", T.StringType()),
        T.StructField("archived", T.BooleanType()),
        T.StructField("user", T.StructType([T.StructField("role", T.StringType()), T.StructField("name", T.StringType())])),
        T.StructField("has_title", T.BooleanType()),
    ]
)
ROWS = [
    (1, 2020, ["a", "b"], "spark engine", False, ("admin", "x"), True),
    (2, None, [], "", None, ("guest", None), True),
    (3, 2024, None, None, True, None, True),
    (4, 2022, ["b"], None, True, ("admin", ""), False),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


CASES = [
    (None, {1, 2, 3, 4}),
    ({}, {1, 2, 3, 4}),
    ({"year": 2020}, {1}),
    ({"tag": "b"}, {1, 4}),
    ({"tag": {"$ne": "b"}}, {2, 3}),
    ({"year": {"$in": [2020, 2024]}}, {1, 3}),
    ({"year": {"$in": 2020}}, {1}),
    ({"year": {"$nin": [2020]}}, {2, 3, 4}),
    ({"year": {"$gt": 2020, "$lte": 2024}}, {3, 4}),
    ({"year": {"$gt": True}}, set()),
    ({"year": {"$gt": "2000"}}, set()),
    ({"tag": {"$gte": "b"}}, {1, 4}),
    ({"title": {"$exists": True}}, {1, 2, 3}),
    ({"title": {"$null": True}}, {3}),
    ({"title": {"$null": False}}, {1, 2, 4}),
    ({"title": {"$empty": True}}, {2, 3, 4}),
    ({"tag": {"$empty": False}}, {1, 4}),
    ({"tag": {"$all": ["a", "b"]}}, {1}),
    ({"title": {"$contains": "eng"}}, {1}),
    ({"tag": {"$contains": "a"}}, {1}),
    ({"user.role": "admin"}, {1, 4}),
    ({"user.role": {"$ne": "admin"}}, {2, 3}),
    ({"archived": True, "year": {"$gte": 2023}}, {3}),
    ({"$or": [{"year": 2020}, {"user.role": "guest"}]}, {1, 2}),
    ({"$and": {"year": 2020}}, {1}),
    ({"$not": [{"archived": True}, {"year": 2024}]}, {1, 2, 4}),
    ({"$nor": [{"archived": True}, {"year": 2020}]}, {2}),
    ({"$id": {"$in": [2, 9]}}, {2}),
    ({"nothing": 1}, set()),
    ({"nothing": {"$ne": 1}}, {1, 2, 3, 4}),
    ({"nothing": {"$exists": False}}, {1, 2, 3, 4}),
    ({"year": None}, {2}),
]


@pytest.mark.parametrize("spec,expected", CASES, ids=[str(c[0]) for c in CASES])
def test_truth_table(rows, spec, expected):
    fields = Fields(SCHEMA, {"title": F.col("has_title")})
    assert {r.id for r in rows.where(compile_filter(spec, fields)).collect()} == expected


def test_errors():
    fields = Fields(SCHEMA)
    for bad in ({"$what": 1}, {"year": {"$what": 1}}, {"year": {"$gt": 1, "x": 2}}):
        with pytest.raises(ValueError):
            compile_filter(bad, fields)
    with pytest.raises(TypeError):
        compile_filter([1], fields)


def test_variant_paths(spark):
    rows = spark.createDataFrame([(1, '{"a": {"b": 3, "s": "xy"}, "n": null}'), (2, '{"a": {"s": "z"}}'), (3, "{}")], "id long, j string")
    rows = rows.select("id", F.parse_json("j").alias("p"))
    fields = Fields(rows.schema)
    ids = lambda spec: {r.id for r in rows.where(compile_filter(spec, fields)).collect()}
    assert ids({"p.a.b": {"$gte": 3}}) == {1}
    assert ids({"p.a.s": {"$contains": "x"}}) == {1}
    assert ids({"p.a.b": {"$exists": True}}) == {1}


def test_translators():
    assert from_clauses({"must": [{"key": "t", "match": {"value": 1}}], "must_not": [{"has_id": [3]}]}) == {"$and": [{"t": {"$eq": 1}}], "$nor": [{"$id": {"$in": [3]}}]}
    assert from_clauses({"should": [{"key": "n", "range": {"gt": 1, "lt": None}}, {"is_null": {"key": "z"}}]}) == {"$or": [{"n": {"$gt": 1}}, {"z": {"$null": True}}]}
    assert from_clauses(None) == {}
    assert from_triples([("a", "==", 1), ("or", [("b", ">", 2), ("c", "in", [3])])]) == {"$and": [{"a": {"$eq": 1}}, {"$or": [{"b": {"$gt": 2}}, {"c": {"$in": [3]}}]}]}
    with pytest.raises(ValueError):
        from_triples([("a", "~", 1)])
    assert prefix_filter({"a": 1, "$or": [{"b": 2}]}, "m.") == {"m.a": 1, "$or": [{"m.b": 2}]}


def test_metadata_filter(spark):
    rows = spark.createDataFrame([(0, "acme", 100, ["sales"]), (1, "acme", 200, ["admin"]), (2, "other", 200, ["sales"]), (3, "acme", None, ["admin"])], "id long, tenant string, ts long, acl array<string>")
    assert [r.id for r in rows.where(metadata_filter("acme", ["sales", "admin"], since=150)).collect()] == [1]
    assert rows.where(metadata_filter()).count() == 4


def test_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(10).selectExpr("id", "cast(id as int) as year").write.parquet(path)
    df = spark.read.parquet(path)
    plan = df.where(compile_filter({"year": {"$gt": 5}}, Fields(df.schema)))._jdf.queryExecution().executedPlan().toString()
    assert "year" in plan.split("PushedFilters")[1]
