"""Vector operators against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from vektra.llm import ann, caps

VEC = "vec_id long, embedding array<float>, label int"


def frame(spark, rows):
    df = spark.createDataFrame(rows, VEC)
    return df.withColumns({"v": F.lit(1), "key": F.lit("k"), "node": F.lit(2), "rank": F.lit(3), "copies": F.lit(4), "tab": F.lit(5)})


def unit(x):
    return x / np.sqrt((x * x).sum(-1, keepdims=True))


BAD = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [float("inf")] + [1.0] * 15, 1), (904, [None] + [1.0] * 15, 1), (None, [1.0] * 16, 1), (905, [1.0, 2.0], 1), (950, [0.0] * 16, 1)]


def clean(n=600, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = centres[np.arange(n) % 12] + rng.normal(0, 0.5, (n, dim))
    x[100:140] = x[7]  # a large group of copies
    return x.astype(np.float32)


def test_perturbations_come_in_order_of_cost():
    near = np.array([0.1, 0.45, 0.8])
    cost = lambda s: sum(n**2 if d < 0 else (1 - n) ** 2 if d > 0 else 0 for n, d in zip(near, s))
    got = [tuple(s) for s in ann.perturbations(near[None], 27)[0]]
    every = sorted(itertools.product((-1, 0, 1), repeat=3), key=cost)
    assert sorted(got) == sorted(every) and np.allclose([cost(s) for s in got], [cost(s) for s in every])
    some = np.random.default_rng(4).random((50, 8))
    for row, steps in zip(some, ann.perturbations(some, 40)):
        costs = [sum(row[j] ** 2 if d < 0 else (1 - row[j]) ** 2 if d > 0 else 0 for j, d in enumerate(s)) for s in steps]
        assert len({tuple(s) for s in steps}) == 40 and costs == sorted(costs)
        best = sorted(sum(row[j] ** 2 if d < 0 else (1 - row[j]) ** 2 if d > 0 else 0 for j, d in enumerate(s)) for s in itertools.product((-1, 0, 1), repeat=8))[:40]
        assert np.mean(costs) <= 1.05 * np.mean(best)


@pytest.mark.parametrize("sizes", [{}, {"part": 100, "chunk": 30, "block": 5}])
def test_neighbours(spark, sizes):
    x = clean()
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + BAD + [(5, x[5].tolist(), 0)]
    df = frame(spark, rows)
    got = ann.search(df, df.where("vec_id % 50 = 0"), 5, **sizes).collect()
    y = unit(x.astype(np.float64))
    ids = np.arange(len(x))
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(found) == set(range(0, 600, 50))
    hits = 0
    for q, ranked in found.items():
        assert sorted(ranked) == [1, 2, 3, 4, 5] and q not in {v for v, _ in ranked.values()}
        score = np.round(y @ y[q], 12)
        score[q] = -9
        real = np.lexsort((ids, -score))[:5]
        hits += len(set(real) & {v for v, _ in ranked.values()})
        listed = [ranked[i] for i in range(1, 6)]
        assert all(abs(s - score[v]) < 1e-9 for v, s in listed)
        assert listed == sorted(listed, key=lambda e: (-round(e[1], 12), e[0]))
    assert hits / 60 >= 0.9
    assert [found[100][i][0] for i in range(1, 6)] == [7, 101, 102, 103, 104]


def test_few_rows_are_all_answers(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4, 16)).astype(np.float32)
    df = frame(spark, [(i * 50, v.tolist(), 0) for i, v in enumerate(x)] + BAD)
    got = ann.search(df, df, 5).where("query_id < 900").collect()
    assert sorted((r.query_id, r.vec_id) for r in got) == sorted((a * 50, b * 50) for a in range(4) for b in range(4) if a != b)
    assert ann.search(df.limit(0), df, 5).count() == 0 and ann.search(df, df.limit(0), 5).count() == 0


@pytest.mark.parametrize("full", [4096, 6])
def test_near_duplicates(spark, full):
    rng = np.random.default_rng(2)
    x = unit(rng.normal(size=(150, 16)))
    for i in range(40, 90):  # chains and clusters about a few vectors
        x[i] = unit(x[i % 5] + rng.normal(0, 0.035, 16))
    x[90:110] = x[3]
    x = x.astype(np.float32)
    label = [None if i % 29 == 0 else i % 5 % 2 for i in range(150)]
    rows = [(i, v.tolist(), label[i]) for i, v in enumerate(x)] + BAD + [(3, x[3].tolist(), label[3])]
    got = caps.near_duplicates(frame(spark, rows), full=full).collect()
    assert len(got) == len(rows)
    every = [(i, unit(np.array(v, np.float64)), lab) for i, v, lab in rows if i is not None and i < 900]
    links = {k: 0 for k in range(len(every))}
    parent = list(range(len(every)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(range(len(every)), 2):
        if every[a][2] is not None and every[a][2] == every[b][2] and every[a][1] @ every[b][1] >= 0.98:
            links[a] += 1
            links[b] += 1
            parent[find(a)] = find(b)
    smallest = {}
    for k in range(len(every)):
        smallest[find(k)] = min(smallest.get(find(k), 10**9), every[k][0])
    want = sorted((every[k][0], links[k], smallest[find(k)], every[k][0] == smallest[find(k)]) for k in range(len(every)))
    assert sorted(tuple(r) for r in got if r.vec_id is not None and r.vec_id < 900) == want
    assert all(r.n_links == 0 and r.component_id == r.vec_id and r.kept for r in got if r.vec_id is None or r.vec_id >= 900)


@pytest.mark.parametrize("scale", [np.arange(1, 65) ** -1.0, np.arange(1, 65) ** -1.5, np.where(np.arange(64) < 32, 1.0, 0.1)])
def test_links_where_few_components_are_strong(spark, scale):
    rng = np.random.default_rng(8)
    x = unit(rng.normal(size=(200, 64)) * scale)
    side = rng.normal(size=x.shape) * scale
    side = unit(side - (side * x).sum(1, keepdims=True) * x)
    y = unit(0.9801 * x + np.sqrt(1 - 0.9801**2) * side)
    rows = [(2 * i + j, v.astype(np.float32).tolist(), i) for i in range(200) for j, v in enumerate((x[i], y[i]))]
    assert [r.n_links for r in caps.near_duplicates(frame(spark, rows)).collect()] == [1] * 400


def test_scores_are_of_double_components(spark):
    """Components beyond single precision, and rows of other lengths than most have."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 8)) * 1e60
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(100 + i, [1.0, 2.0], 0) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(7)
    y = unit(x / 1e60)
    for r in ann.search(df, df.where("vec_id % 50 = 0"), 5).collect():
        assert r.vec_id < 100 and abs(r.score - y[r.query_id] @ y[r.vec_id]) < 1e-14
    close = x[:20] * (1 + 1e-13 * np.arange(8))
    twice = df.where("vec_id < 100").union(spark.createDataFrame([(200 + i, v.tolist(), 0) for i, v in enumerate(close)], df.schema))
    got = {r.vec_id: r for r in caps.near_duplicates(twice).collect()}
    assert all(got[200 + i].component_id == i and got[i].n_links == 1 for i in range(20)) and all(got[i].n_links == 0 for i in range(20, 60))


def test_sketches_rule_out_no_link():
    rng = np.random.default_rng(7)
    for scale in (np.ones(64), np.arange(1, 65) ** -1.5):
        x = unit(rng.normal(size=(4000, 64)) * scale)
        y = unit(x + 0.2 * unit(rng.normal(size=x.shape) * scale))
        linked = (x * y).sum(1) >= 0.98
        assert linked.sum() > 500
        for longs in (1, 2, 4):
            a, b = (caps.sketch(v, longs).view(np.int8).astype(np.float32) for v in (x, y))
            near = caps._apart(a, b) <= caps.sketch_limit(0.98, longs)
            assert near[linked].all()
    far = unit(rng.normal(size=(4000, 64)))
    a = caps.sketch(far, 2).view(np.int8).astype(np.float32)
    assert (caps._apart(a[:2000], a[2000:]) <= caps.sketch_limit(0.98, 2)).mean() < 0.01


def test_many_vectors_decode_as_one(monkeypatch):
    x = unit(np.random.default_rng(1).normal(size=(300, 64)))
    x[:20, 3:] = 0
    x = unit(x)
    for code, bound, top in ((caps.codes(64, 2, 64), 0.3, 40), (caps.codes(64, 2, 64), 0.3, 21), (caps.codes(64, 3, 8), 0.3, 40)):
        of, number = caps.decode_all(x, code, bound, top=top)
        for i, v in enumerate(x):
            assert sorted(number[of == i].tolist()) == caps.decode(v, code, bound).tolist()


def test_decoding_finds_all_filters():
    code = caps.codes(16, 2, 20)
    x = unit(np.random.default_rng(1).normal(size=(20, 16)))
    whole = np.array([np.concatenate([a, b]) for a in code[0] for b in code[1]])
    assert np.allclose((whole**2).sum(1), 1)
    for v in x:
        score = whole @ v
        limit = min(0.5, np.sort(score)[-20])
        assert caps.decode(v, code, 0.5).tolist() == np.flatnonzero(score >= limit - 1e-12).tolist()


def test_empty_and_useless_tables(spark):
    assert caps.near_duplicates(frame(spark, BAD).limit(0)).count() == 0
    got = caps.near_duplicates(frame(spark, BAD[:5])).collect()
    assert sorted(tuple(r) for r in got) == [(900 + i, 0, 900 + i, True) for i in range(5)]
