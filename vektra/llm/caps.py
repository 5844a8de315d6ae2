"""Embedding near-duplicates: spherical-cap filters with structured random product codes.

The space is cut into blocks of components, each with a small random code; a filter is
one code word of every block, its direction their concatenation. A vector lies in all
filters whose direction it exceeds a bound with, which list decoding finds block by
block, without looking at every filter. A random rotation comes first, so that it does
not matter how a vector's length is spread over its components.

Vectors meet by (label, filter). Into a filter goes a vector's id and a short sketch of
it, from which a lower bound of two vectors' distance follows; the pairs that it does
not rule out connect candidates. Vectors themselves travel once, to the others that
such pairs connect them with, and are verified there by cosine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .shared import components, cut, group_bounds, matrix, usable, whole_groups

#: Blocks of a code, words of each block, and the bound in standard deviations of a random direction.
BLOCKS, WORDS, BOUND = 2, 512, 3.7
#: Filters that a vector lies in at least: its best ones, where fewer exceed the bound. Of pairs at a
#: cosine of 0.98 in 64 dimensions then none in 1500 was without a common filter.
LEAST = 20
#: Words of a block that are combined for many vectors at once; a vector that needs more is decoded by itself.
TOP = 40
#: Rows of a filter, or vectors that are connected, that one task compares at a time; more go on as pairs of chunks.
FULL = 4096
#: Rows of one filter up to which all its pairs are bounded at once.
TINY = 6
#: Components in each long of a sketch, and steps to a length of 1. Vectors of longer tables get longer sketches.
PACKED, STEPS = 8, 254
SEED = 5


def codes(dim: int, blocks: int = BLOCKS, words: int = WORDS, seed: int = SEED) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    out = []
    for part in np.array_split(np.arange(dim), min(blocks, dim)):
        c = rng.normal(size=(words, len(part)))
        out.append(c / np.sqrt((c * c).sum(axis=1, keepdims=True)) * np.sqrt(len(part) / dim))
    return out


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix: it spreads vectors with a few strong components over all blocks."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def decode(x: np.ndarray, code: list[np.ndarray], bound: float, least: int = LEAST) -> np.ndarray:
    """Numbers of all filters that the unit vector exceeds ``bound`` with, ascending; of the ``least`` best if these are fewer."""
    at, scores, best = 0, [], np.zeros(1)
    for c in code:
        s = c @ x[at : at + c.shape[1]]
        scores.append(s)
        at += c.shape[1]
        best = np.sort((best[:, None] + np.sort(s)[None, -least:]).ravel())[-least:]
    rest = np.cumsum([s.max() for s in scores][::-1])[::-1]
    limit = min(bound, best[0]) - 1e-12
    total, number = np.zeros(1), np.zeros(1, np.int64)
    for i, s in enumerate(scores):
        more = rest[i + 1] if i + 1 < len(scores) else 0.0
        own = np.flatnonzero(s + total.max() + more >= limit)
        total, number = (total[:, None] + s[None, own]).ravel(), (number[:, None] * len(s) + own[None]).ravel()
        ok = total + more >= limit
        total, number = total[ok], number[ok]
    return np.sort(number)


def decode_all(x: np.ndarray, code: list[np.ndarray], bound: float, least: int = LEAST, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """Rows and numbers of the filters of many unit vectors, as ``decode`` finds them.

    With two blocks the ``top`` words of each are combined, a vector that may need
    others is decoded by itself.
    """
    if len(code) != 2 or min(map(len, code)) <= top or least > top:
        alone, of, numbers = np.arange(len(x)), [], []
    else:
        words, values = [], []
        for c, part in zip(code, np.split(x, [code[0].shape[1]], axis=1)):
            s = part @ c.T
            best = np.argpartition(s, len(c) - top, axis=1)[:, -top:]
            value = np.take_along_axis(s, best, axis=1)
            order = np.argsort(-value, axis=1)
            words.append(np.take_along_axis(best, order, axis=1))
            values.append(np.take_along_axis(value, order, axis=1))
        alone, of, numbers = [], [], []
        for at in range(0, len(x), 256):
            p, q = (v[at : at + 256] for v in values)
            sums = (p[:, :, None] + q[:, None, :]).reshape(len(p), -1)
            limit = np.minimum(bound, np.partition(sums, sums.shape[1] - least, axis=1)[:, -least]) - 1e-12
            more = (p[:, -1] + q[:, 0] >= limit) | (p[:, 0] + q[:, -1] >= limit)
            alone.append(np.flatnonzero(more) + at)
            r, c = np.nonzero((sums >= limit[:, None]) & ~more[:, None])
            of.append(r + at)
            numbers.append(words[0][r + at, c // top] * len(code[1]) + words[1][r + at, c % top])
        alone = np.concatenate(alone) if alone else np.empty(0, np.int64)
    for i in alone:
        found = decode(x[i], code, bound, least)
        of.append(np.full(len(found), i))
        numbers.append(found)
    none = np.empty(0, np.int64)
    return np.concatenate([none, *of]).astype(np.int64), np.concatenate([none, *numbers]).astype(np.int64)


def sketch(x: np.ndarray, longs: int) -> np.ndarray:
    """The first components of rotated unit vectors as steps of 1 / STEPS, PACKED to a long; (row, long)."""
    first = np.zeros((len(x), longs * PACKED), np.int8)
    own = x[:, : longs * PACKED]
    first[:, : own.shape[1]] = np.clip(np.rint(own * STEPS), -127, 127)
    return first.view(np.int64)


def sketch_limit(threshold: float, longs: int) -> float:
    """The largest squared distance of the sketches of two unit vectors whose cosine is ``threshold`` or more.

    Leaving out components and cutting off large ones brings vectors nearer, rounding
    parts them by a step for each component at most.
    """
    return (STEPS * np.sqrt(max(2 - 2 * threshold, 0)) + np.sqrt(longs * PACKED) + 1e-6) ** 2


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=1)


def _forest(steps: np.ndarray, node: np.ndarray, split: int | None, limit: float) -> list[np.ndarray]:
    """Links that connect what pairs within ``limit`` connect, each row reached once; with ``split`` pairs across it only."""
    out, todo = [], np.arange(len(node))
    while len(todo):
        queue, todo = [int(todo[0])], todo[1:]
        while queue and len(todo):
            at = queue.pop()
            near = _apart(steps[todo], steps[at]) <= limit
            if split is not None:
                near &= (todo < split) != (at < split)
            if near.any():
                found = todo[near]
                out.append(np.stack([np.full(len(found), node[at]), node[found]]))
                queue += found.tolist()
                todo = todo[~near]
    return out


def _candidates(keys: np.ndarray, node: np.ndarray, sketches: np.ndarray, limit: float) -> np.ndarray:
    """Links of rows sorted by key that their sketches do not rule out, within each key."""
    out = [np.empty((2, 0), np.int64)]
    if len(keys) < 2:
        return out[0]
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    sizes = np.diff(edge)
    size_of = np.repeat(sizes, sizes)
    small = np.flatnonzero((size_of > 1) & (size_of <= TINY))
    steps = np.ascontiguousarray(sketches).view(np.int8).astype(np.float32)
    for step in range(1, TINY):
        a = small[small + step < len(keys)]
        a = a[keys[a] == keys[a + step]]
        a = a[_apart(steps[a], steps[a + step]) <= limit]
        out.append(np.stack([node[a], node[a + step]]))
    for i in np.flatnonzero(sizes > TINY):
        out += _forest(steps[edge[i] : edge[i + 1]], node[edge[i] : edge[i + 1]], None, limit)
    return np.concatenate(out, axis=1)


def _meet(limit: float, longs: int, full: int):
    """Over rows sorted by filter: links (a, b), and the rows of filters over ``full`` rows, numbered by chunk (b null)."""
    names = ["a", "b", "key", "chunk", *[f"s{i}" for i in range(longs)]]

    def links(found):
        n = found.shape[1]
        return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1]), *[pa.nulls(n, pa.int64())] * (2 + longs)], names=names)

    def rest(first, keys, node, sketches):
        n = len(keys)
        return pa.RecordBatch.from_arrays([pa.array(node), pa.nulls(n, pa.int64()), pa.array(keys), pa.array((first + np.arange(n)) // full), *[pa.array(np.ascontiguousarray(sketches[:, i])) for i in range(longs)]], names=names)

    def run(batches):
        held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, longs), np.int64))
        over, passed = None, 0  # the filter whose rows pass through, and how many have
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            keys, node, sketches = columns[0], columns[1], np.stack(columns[2:], axis=1)
            if over is not None:
                n = int(np.argmin(np.append(keys == over, False)))
                if n:
                    yield rest(passed, keys[:n], node[:n], sketches[:n])
                    passed += n
                keys, node, sketches = keys[n:], node[n:], sketches[n:]
                if not len(keys):
                    continue
                over = None
            keys, node, sketches = (np.concatenate(x) for x in zip(held, (keys, node, sketches)))
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1]))
            found = _candidates(keys[:last], node[:last], sketches[:last], limit)
            if found.shape[1]:
                yield links(found)
            held = keys[last:], node[last:], sketches[last:]
            if len(held[0]) > full:
                over, passed = held[0][0], len(held[0])
                yield rest(0, *held)
                held = tuple(x[:0] for x in held)
        found = _candidates(*held, limit)
        if found.shape[1]:
            yield links(found)

    return run


def _verify(threshold: float):
    """Over rows sorted by (component, c1, c2): links of each class, and stars that connect what is linked."""

    def run(batches):
        for table in whole_groups(batches, 3):
            bounds = group_bounds(table, 3)
            c1, c2, chunk, of, label, node, copies = (table.column(i).to_numpy() for i in range(1, 8))
            out = []
            for a, b in zip(bounds, bounds[1:]):
                if b - a < 2:
                    continue
                g = slice(a, b)
                x = matrix(table.column(8).slice(a, b - a), b - a)
                x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                links = (x @ x.T >= threshold) & (label[g][:, None] == label[g][None])
                if c1[a] != c2[a]:
                    links &= chunk[g][:, None] != chunk[g][None]
                np.fill_diagonal(links, False)
                count = links @ copies[g].astype(np.float64)
                star = np.full(b - a, -1)
                for i in np.flatnonzero(count):
                    if star[i] < 0:
                        star[i], front = i, np.array([i])
                        while len(front):
                            front = np.flatnonzero(links[front].any(axis=0) & (star < 0))
                            star[front] = i
                took = np.flatnonzero(star >= 0)
                out.append((of[g][took], node[g][took], count[took].astype(np.int64), node[g][star[took]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["class", "node", "links", "star"])

    return run


def _mixed(label: np.ndarray, number: np.ndarray) -> np.ndarray:
    """One long for a label's hash and a filter's number."""
    out = (label.view(np.uint64) ^ (number.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9E3779B97F4A7C15)
    return (out ^ (out >> np.uint64(31))).view(np.int64)


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", blocks: int = BLOCKS, words: int = WORDS, bound: float = BOUND, least: int = LEAST, full: int = FULL, seed: int = SEED) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``vectors``.

    Rows are compared only if their labels are equal and not null, on their original
    components in double precision. Rows whose id or vector is null, or whose vector is
    zero, holds null or non-finite components or has another length than most usable
    rows have (of lengths as frequent the smallest), link with nothing. Rows of one label
    and one vector are one class (told by 128 bits of hash): compared once, by its
    smallest id, and linked with each other (a repeated id is a row and a link of its
    own; rows of one id lie in one component). Ids are cast to long, other columns are
    not read. Links of a pair are counted, not emitted. Filters over ``full`` rows, and
    more than ``full`` vectors that candidates connect, are compared as pairs of chunks.
    """
    spark = vectors.sparkSession
    kind = "float" if isinstance(vectors.schema[vector_col].dataType.elementType, FloatType) else "double"
    fits = usable(F.col(vector_col)) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(fits, F.col(vector_col).cast(f"array<{kind}>")).alias("v"), F.xxhash64(label_col).alias("label"))
    usual = rows.where("v is not null").groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if usual is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    dim, total = usual
    fit = F.size("v") == dim
    rows = rows.select("vec_id", "label", F.when(fit, F.col("v")).alias("v"), F.when(fit, F.xxhash64("v")).alias("h1"), F.when(fit, F.xxhash64(F.lit(1), "v")).alias("h2"))
    same = ["label", "h1", "h2"]
    classes = cut(rows.where("h1 is not null").groupBy(*same).agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.any_value("v").alias("v")).withColumn("class", F.xxhash64(*same)))

    code, limit, turn = codes(dim, blocks, words, seed), bound / dim**0.5, rotation(dim, seed)
    longs = 1 + (total > 100_000) + (total > 10_000_000) + (total > 1_000_000_000)
    most = sketch_limit(threshold, longs)
    sketches = [f"s{i}" for i in range(longs)]

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(2), batch.num_rows)
                x = x / np.sqrt((x * x).sum(axis=1, keepdims=True)) @ turn
                of, number = decode_all(x, code, limit, least)
                short = sketch(x, longs)[of]
                key = _mixed(batch.column(0).to_numpy()[of], number)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(batch.column(1).to_numpy()[of]), *[pa.array(np.ascontiguousarray(short[:, i])) for i in range(longs)]], names=["key", "node", *sketches])

    columns = "".join(f", {s} long" for s in sketches)
    placed = classes.select("label", "node", "v").mapInArrow(place, "key long, node long" + columns)
    found = cut(placed.repartition("key").sortWithinPartitions("key").mapInArrow(_meet(most, longs, full), "a long, b long, key long, chunk long" + columns))
    links, hot = found.where("b is not null").select("a", "b"), found.where("b is null")
    if not hot.isEmpty():
        last = hot.groupBy("key").agg(F.max("chunk").alias("last"))
        pairs = hot.join(last, "key").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
        pairs = pairs.select("key", F.least("chunk", "other").alias("c1"), F.greatest("chunk", "other").alias("c2"), "chunk", F.col("a").alias("node"), *sketches)

        def compare(pdf):
            pdf = pdf.sort_values("chunk", kind="stable")
            split = None if pdf["c1"].iat[0] == pdf["c2"].iat[0] else int((pdf["chunk"] == pdf["c1"].iat[0]).sum())
            steps = np.ascontiguousarray(pdf[sketches].to_numpy(np.int64)).view(np.int8).astype(np.float32)
            got = np.concatenate([np.empty((2, 0), np.int64), *_forest(steps, pdf["node"].to_numpy(), split, most)], axis=1)
            return type(pdf)({"a": got[0], "b": got[1]})

        links = links.union(pairs.groupBy("key", "c1", "c2").applyInPandas(compare, "a long, b long"))

    near = cut(components(links))
    sizes = near.groupBy("component").count().where(F.col("count") > full).select(F.col("component").alias("_k"), F.ceil(F.col("count") / (full // 2)).cast("int").alias("_n"))
    met = classes.join(near.select(F.col("node").alias("_node"), "component"), F.col("node") == F.col("_node")).select("component", F.lit(0).alias("c1"), F.lit(0).alias("c2"), F.lit(0).alias("chunk"), "class", "label", "node", "copies", "v")
    if not sizes.isEmpty():
        names = met.columns
        # ``sizes`` has under a row for each ``full`` classes.
        met = met.join(sizes, F.col("component") == F.col("_k"), "left")
        met = met.withColumn("chunk", F.when(F.col("_n").isNull(), 0).otherwise(F.pmod(F.xxhash64("class"), F.col("_n"))).cast("int"))
        met = met.withColumn("_o", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_n") - 1, F.lit(0)))))
        met = met.withColumn("c1", F.least("chunk", "_o")).withColumn("c2", F.greatest("chunk", "_o")).select(*names)
    keys = ["component", "c1", "c2"]
    linked = cut(met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_verify(threshold), "class long, node long, links long, star long"))

    counted = linked.groupBy("class").agg(F.sum("links").alias("_links")).withColumnRenamed("class", "_class")
    comp = components(linked.select(F.col("node").alias("a"), F.col("star").alias("b"))).select(F.col("node").alias("_n2"), F.col("component").alias("_comp"))
    named = classes.select(*same, "class", "node", "copies").join(counted, F.col("class") == F.col("_class"), "left").join(comp, F.col("node") == F.col("_n2"), "left")
    named = named.select(*[F.col(c).alias("_" + c) for c in same], F.col("class").alias("_class"), "copies", (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("_n"), F.coalesce("_comp", "node").alias("_c"))
    return _spread(rows.select("vec_id", *same), named, same, max(full, total // 4096))


def _spread(rows: DataFrame, named: DataFrame, same: list[str], full: int) -> DataFrame:
    """Every row with what its class got; the rows of classes with over ``full`` of them are dealt over salts.

    At most rows / ``full`` classes are that large, 4096 of all, so these are broadcast.
    """
    hot = named.where(F.col("copies") > full).select(F.col("_class").alias("_k"), F.ceil(F.col("copies") / full).cast("int").alias("_s"))
    mine = rows.withColumn("_mine", F.xxhash64(*same)).join(F.broadcast(hot), F.col("_mine") == F.col("_k"), "left")
    mine = mine.select("vec_id", *same, F.coalesce(F.pmod(F.xxhash64("vec_id", F.spark_partition_id()), F.col("_s")), F.lit(0)).cast("int").alias("_p"))
    salts = F.when(F.col("copies") > full, F.ceil(F.col("copies") / full)).otherwise(1).cast("int")
    named = named.withColumn("_q", F.explode(F.sequence(F.lit(0), salts - 1)))
    on = [F.col(c) == F.col("_" + c) for c in same] + [F.col("_p") == F.col("_q")]
    out = mine.join(named, on, "left").select("vec_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("_c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
