from vektra.operators import idsets


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def listed(df):
    return sorted(r.id for r in df.collect())


def test_golden_intersection(spark):
    a = ids(spark, [*range(0, 5000, 2), 70000])
    b = ids(spark, [1, 4096, 70000, 70000])
    assert listed(idsets.intersect(a, b)) == [4096, 70000]
    maps = idsets.bitmap_intersect(idsets.to_bitmaps(a), idsets.to_bitmaps(b))
    assert idsets.size(maps) == 2 and listed(idsets.to_ids(maps)) == [4096, 70000]
    both = idsets.bitmap_union(idsets.to_bitmaps(a), idsets.to_bitmaps(b))
    assert idsets.size(both) == 2502 and listed(idsets.to_ids(both)) == listed(idsets.union(a, b))


def test_conversions_and_masks(spark):
    rows = spark.createDataFrame([(1, True), (2, False), (3, None), (32768, True), (32769, True)], "id long, ok boolean")
    assert listed(idsets.from_flags(rows, "ok")) == [1, 32768, 32769]
    assert listed(idsets.from_range(spark, 3, 6)) == [3, 4, 5]
    assert listed(idsets.to_ids(idsets.to_bitmaps(rows.select("id")))) == [1, 2, 3, 32768, 32769]
    assert listed(idsets.allowed(rows, ids(spark, [1, 2, 9]), ids(spark, [2]))) == [1]
    assert listed(idsets.allowed(rows, None, ids(spark, [2]))) == [1, 3, 32768, 32769]
    assert idsets.size(idsets.to_bitmaps(rows.limit(0).select("id"))) == 0
