"""SimHash near-duplicates: fingerprints, popcount grid join, exact verification.

A fingerprint is cut into 32 segments of two bits and embedded as the vector of
its segments' bit counts. The Manhattan distance of two such vectors never
exceeds the Hamming distance of the fingerprints. The segments form axis groups,
more of them the more rows there are; two vectors within Manhattan distance four
differ in at most four groups, so they lie in one cell of at least one of the grids
that all choices of the other groups span. So a cell holds few rows at any size of
the table. Within a cell rows are joined by range: their bit counts over all
segments differ by four at most. What is in range is compared by Manhattan distance
and then exactly.

For stages that take word shingles and a similarity, links of fingerprints are
verified on whole shingle sets, and sets that fingerprints leave apart are joined by
prefix filters (``copies``): at a similarity of 4/5 fingerprints differ in about ten
bits, more than a grid can search.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import copies
from .shared import components, cut, named, unused

SEED = 42
RADIUS = 4
#: Rows up to which grids of 6, 7 and 8 axis groups serve; beyond, 9 do. Cells then hold about 2^16, 2^20, 2^24 and 2^27 places.
GROWTH = (1 << 17, 1 << 22, 1 << 27)
#: Groups of rows in one cell up to this size are compared all at once, larger ones one pivot at a time.
TINY = 6
#: Rows of one cell that a task holds; what lies beyond is dealt out as pairs of chunks.
CHUNK = 32_768
#: Rows of (key, id, hash) that are broadcast at most, of 64 bytes each.
NAMED = 250_000
#: Shingles hashed at a time, which bounds the memory that a very long text takes.
BLOCK = 1 << 18

LOW = np.uint64(0x5555555555555555)
ONE = np.uint64(1)


def fingerprint(text: str | None, width: int = 4) -> int:
    """The unsigned 64-bit SimHash of a text; 0 where it is null or has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    flat, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    stops = (ends[width - 1 :] - 1).tolist()
    starts = [0, *ends[: len(ends) - width].tolist()]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        part = np.array([digest(flat[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], stops[at : at + BLOCK])], np.uint64)
        ones += _ones(part)
    return _majority(ones, len(starts))


def _ones(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(ones: np.ndarray, of: int) -> int:
    return int(np.packbits(2 * ones > of, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """``(doc_id, fp, hash)``, one row per row of ``docs``; ``fp`` is the signed form of the fingerprint, ``hash`` one of the text as it is."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), batch.column(2)], names=["doc_id", "fp", "hash"])

    mine = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("hash"))
    return mine.mapInArrow(run, "doc_id long, fp long, hash long")


def embed(fp: np.ndarray) -> np.ndarray:
    """Segment bit counts in unary: 0, 1, 2 as 00, 01, 11, so that XOR counts their Manhattan distance."""
    high = (fp >> ONE) & LOW
    low = fp & LOW
    return (high | low) | ((high & low) << ONE)


def groups_for(rows: int) -> int:
    """Axis groups for so many fingerprints."""
    return 6 + sum(rows > n for n in GROWTH)


def axis_masks(groups: int) -> list[int]:
    bounds = [round(i * 32 / groups) for i in range(groups + 1)]
    return [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(bounds, bounds[1:])]


def grid_masks(groups: int, radius: int = RADIUS) -> list[int]:
    """One 64-bit mask per grid: the segments of each choice of the axis groups that must agree."""
    masks = axis_masks(groups)
    signed = [sum(masks[i] for i in chosen) for chosen in combinations(range(groups), groups - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in signed]


def _forest(fp: np.ndarray, node: np.ndarray, split: int | None, radius: int) -> list[np.ndarray]:
    """Links that connect what links within ``radius`` connect: each row is reached once.

    ``split``: only pairs of a row before it with a row from it on count (a pair of
    chunks); None: all pairs count.
    """
    grid, count, out = embed(fp), np.bitwise_count(fp).astype(np.int64), []
    left = np.arange(len(fp)) < split if split is not None else None
    todo = np.argsort(count, kind="stable")  # by bit count, so that what is in range of a row lies together
    level = count[todo]
    while len(todo):
        queue, todo, level = [int(todo[0])], todo[1:], level[1:]
        while queue and len(todo):
            at = queue.pop()
            a, b = np.searchsorted(level, (count[at] - radius, count[at] + radius + 1))
            some = todo[a:b]
            near = np.bitwise_count(grid[some] ^ grid[at]) <= radius
            near[near] = np.bitwise_count(fp[some[near]] ^ fp[at]) <= radius
            if left is not None:
                near &= left[some] != left[at]
            if near.any():
                found = some[near]
                out.append(np.stack([np.full(len(found), node[at]), node[found]]))
                queue += found.tolist()
                stay = np.ones(len(todo), bool)
                stay[a:b] = ~near
                todo, level = todo[stay], level[stay]
    return out


def _linked(keys: np.ndarray, fp: np.ndarray, node: np.ndarray, radius: int) -> np.ndarray:
    """Links among rows that are sorted by key, within each key."""
    out = [np.empty((2, 0), np.int64)]
    if len(fp) < 2:
        return out[0]
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    sizes = np.diff(edge)
    size_of = np.repeat(sizes, sizes)
    small = np.flatnonzero((size_of > 1) & (size_of <= TINY))
    grid = embed(fp)
    for step in range(1, TINY):
        a = small[small + step < len(fp)]
        b = a + step
        ok = keys[a] == keys[b]
        a, b = a[ok], b[ok]
        ok = np.bitwise_count(grid[a] ^ grid[b]) <= radius
        a, b = a[ok], b[ok]
        ok = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        out.append(np.stack([node[a[ok]], node[b[ok]]]))
    for i in np.flatnonzero(sizes > TINY):
        out += _forest(fp[edge[i] : edge[i + 1]], node[edge[i] : edge[i + 1]], None, radius)
    return np.concatenate(out, axis=1)


_OUT = "a long, b long, grid int, cell long, chunk long, fp long"


def _join_cells(radius: int, chunk: int):
    """Over rows sorted by grid and cell: links, and the rows of cells over ``chunk`` rows, numbered.

    A task holds one Arrow batch and the last cell's rows, ``chunk`` at most.
    """

    def links(found):
        n = found.shape[1]
        return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1]), *(pa.nulls(n, t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=_names)

    def rest(key, first, fp, node):
        n = len(fp)
        return pa.RecordBatch.from_arrays([pa.array(node), pa.nulls(n, pa.int64()), pa.array(np.full(n, key[0], np.int32)), pa.array(np.full(n, key[1])), pa.array((first + np.arange(n)) // chunk), pa.array(fp.view(np.int64))], names=_names)

    _names = ["a", "b", "grid", "cell", "chunk", "fp"]
    kind = np.dtype([("grid", np.int32), ("cell", np.int64)])

    def run(batches):
        held = (np.empty(0, kind), np.empty(0, np.uint64), np.empty(0, np.int64))
        over, passed = None, 0  # the cell whose rows pass through, and how many have
        for batch in batches:
            keys = np.empty(batch.num_rows, kind)
            keys["grid"], keys["cell"] = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fp, node = batch.column(2).to_numpy().view(np.uint64), batch.column(3).to_numpy()
            if over is not None:
                n = int(np.argmin(np.append(keys == over, False)))
                if n:
                    yield rest(over, passed, fp[:n], node[:n])
                    passed += n
                keys, fp, node = keys[n:], fp[n:], node[n:]
                if not len(fp):
                    continue
                over = None
            keys, fp, node = (np.concatenate(x) for x in zip(held, (keys, fp, node)))
            last = len(fp) - int(np.argmin(np.append((keys == keys[-1])[::-1], False)))
            found = _linked(keys[:last], fp[:last], node[:last], radius)
            if found.shape[1]:
                yield links(found)
            held = keys[last:], fp[last:], node[last:]
            if len(held[1]) > chunk:
                over, passed = held[0][0], len(held[1])
                yield rest(over, 0, held[1], held[2])
                held = tuple(x[:0] for x in held)
        found = _linked(*held, radius)
        if found.shape[1]:
            yield links(found)

    return run


def near_links(prints: DataFrame, radius: int = RADIUS, groups: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """``(a, b)`` links of nodes of distinct fingerprints that connect all pairs within ``radius`` bits.

    ``prints``: distinct ``(fp, node)``. A group of near copies gives a forest per
    cell, not all its pairs. Cells over ``chunk`` rows go on as pairs of chunks, each
    pair a group of its own, so no task holds more than two chunks. ``groups``: axis
    groups of the grids, by the count of rows if None.
    """
    masks = grid_masks(groups or groups_for(prints.count()), radius)
    one = F.shiftrightunsigned("fp", 1)
    low = F.lit(int(LOW))
    high_, low_ = one.bitwiseAND(low), F.col("fp").bitwiseAND(low)
    unary = high_.bitwiseOR(low_).bitwiseOR(F.shiftleft(high_.bitwiseAND(low_), 1))
    cells = prints.select("fp", "node", unary.alias("u")).select("fp", "node", F.posexplode(F.array(*[F.col("u").bitwiseAND(F.lit(m)) for m in masks])).alias("grid", "cell"))
    dealt = cells.repartition("grid", "cell").sortWithinPartitions("grid", "cell").select("grid", "cell", "fp", "node")
    found = cut(dealt.mapInArrow(_join_cells(radius, chunk), _OUT))
    links = found.where("b is not null").select("a", "b")
    hot = found.where("b is null").select(F.col("a").alias("node"), "grid", "cell", "chunk", "fp")
    if hot.isEmpty():
        return links
    count = hot.groupBy("grid", "cell").agg(F.max("chunk").alias("last"))
    pairs = hot.join(count, ["grid", "cell"]).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    pairs = pairs.select("grid", "cell", F.least("chunk", "other").alias("c1"), F.greatest("chunk", "other").alias("c2"), "chunk", "fp", "node")

    def compare(pdf):
        pdf = pdf.sort_values("chunk", kind="stable")
        split = None if pdf["c1"].iat[0] == pdf["c2"].iat[0] else int((pdf["chunk"] == pdf["c1"].iat[0]).sum())
        got = _forest_pairs(pdf["fp"].to_numpy().view(np.uint64), pdf["node"].to_numpy(), split, radius)
        return type(pdf)({"a": got[0], "b": got[1]})

    return links.union(pairs.groupBy("grid", "cell", "c1", "c2").applyInPandas(compare, "a long, b long"))


def _forest_pairs(fp, node, split, radius):
    out = _forest(fp, node, split, radius)
    return np.concatenate(out, axis=1) if out else np.empty((2, 0), np.int64)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = RADIUS, groups: int | None = None, chunk: int = CHUNK, keep_hash: bool = False) -> DataFrame:
    """``(doc_id, fp, component_id)`` (and ``hash`` of the text if asked for), one row per row of ``docs``.

    Documents whose fingerprints differ in at most ``radius`` bits are linked;
    ``component_id`` is the smallest id that links reach. Equal fingerprints meet in
    one aggregate before anything is compared, so copies cost one row each. Null and
    empty texts have fingerprint 0 and are linked like any other; a row with a null
    id keeps its row and takes its fingerprint's component (null if all its ids are
    null). An empty table gives an empty result; other columns are not read.
    """
    prints = cut(fingerprints(docs, id_col, text_col, width))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("node")))
    found = near_links(nodes.where("node is not null"), radius, groups, chunk)
    comp = components(found).withColumnRenamed("component", "_c")
    named = nodes.join(comp, "node", "left").select(F.col("fp").alias("_fp"), F.coalesce("_c", "node").alias("component_id"))
    return prints.join(named, F.col("fp") == F.col("_fp"), "left").select("doc_id", "fp", "component_id", *["hash"] * keep_hash)


def alike(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = copies.WIDTH, near: tuple[int, int] = copies.NEAR, chunk: int = CHUNK) -> DataFrame:
    """``(id, hash, group)``, one row per row of ``docs``: groups that shingle-set similarities of ``near`` or more connect.

    ``hash`` is one of the text as it is. Equal sets are one node from the start. Links
    within RADIUS bits of the fingerprints, and of neighbours in a shared prefix shingle,
    are verified on whole sets first, for each set that with the one it shares most
    with; in shingles of many sets each set's likeliest partners of other groups follow, some
    at a time; then what meets in a prefix shingle and still lies in different groups is.
    Pairs that the counts of their shingles rule out need no sets. So no similar pair is
    missed, and a large group does not cost all its pairs. Null and empty texts have the empty set.
    """
    text = named(text_col).cast("string")
    mine = docs.select(named(id_col).cast("long").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(copies.frequent(mine, width))

    def run(batches):
        for batch in batches:
            keys, sizes, fps, firsts, counted = [], [], [], [], []
            for t in batch.column(2):
                raw = copies.hashes(t.as_py(), width)
                found = np.unique(raw)
                ones = sum((_ones(raw[at : at + BLOCK]) for at in range(0, len(raw), BLOCK)), np.zeros(64, np.int64))
                keys.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                sizes.append(len(found))
                fps.append(_majority(ones, len(raw)))
                firsts.append(copies.prefix(found, *shared.value, near).view(np.int64))
                counted.append(copies.counts(found))
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), signed(keys), pa.array(sizes, pa.int64()), signed(fps), pa.array(firsts, pa.list_(pa.int64())), pa.array(counted, pa.binary())], names=["id", "hash", "key", "n", "fp", "first", "counts"])

    rows = cut(mine.mapInArrow(run, "id long, hash long, key long, n long, fp long, first array<long>, counts binary"))
    nodes = rows.dropDuplicates(["key"]).select("key", "n", "fp", "first")
    counted = rows.dropDuplicates(["key"]).select("key", "n", "counts")
    prints = cut(nodes.groupBy("fp").agg(F.min("key").alias("node")))
    met = cut(copies.meeting(nodes, near))
    equal = nodes.select("key", "fp").join(prints, "fp").where("key <> node").select(F.col("key").alias("a"), F.col("node").alias("b"))

    def whole(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.unique(copies.hashes(t.as_py(), width)).tobytes() for t in batch.column(1)], pa.binary())], names=["key", "set"])

    repeats = not rows.groupBy("id", "hash").count().where("count > 1").isEmpty()

    def sets_of(pairs: DataFrame, there: DataFrame | None = None) -> DataFrame:
        need = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
        if there is not None:
            need = need.join(there.select("key"), "key", "left_anti")
        one = cut(rows.select("key", "id", "hash").join(need, "key").groupBy("key").agg(F.min(F.struct("id", "hash")).alias("row")))
        one = F.broadcast(one) if one.count() <= NAMED else one
        texts = mine.select(F.struct("id", "hash").alias("_row"), "text").join(one, F.col("_row").eqNullSafe(F.col("row"))).select("key", "text")
        return cut((texts.dropDuplicates(["key"]) if repeats else texts).mapInArrow(whole, "key long, set binary"))

    sure = near_links(prints, chunk=chunk).union(equal).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(1 << 40).alias("times"))
    close = copies.neighbours(met).union(sure).groupBy("b").agg(F.max_by("a", F.struct("times", "a")).alias("a")).select("a", "b")
    close = cut(copies.likely(close, counted, near))
    sets = sets_of(close)
    links = cut(copies.verified(close, sets, near))
    comp = cut(components(links))
    crowd = cut(copies.crowded(met))
    for turn in range(0 if crowd.isEmpty() else copies.TURNS):
        # Each set's likeliest partner elsewhere, so that a large group hangs together before its pairs are listed.
        some = copies.likely(copies.strangers(crowd, comp, turn, near), counted, near, "off")
        each = some.select(F.inline(F.array(*[F.struct(F.col(c).alias("x"), F.struct("off", "a", "b").alias("p")) for c in "ab"])))
        best = cut(each.groupBy("x").agg(F.min("p").alias("p")).select("p.a", "p.b").distinct())
        if best.isEmpty():
            break
        sets = sets.union(sets_of(best, sets))
        more = cut(copies.verified(best, sets, near))
        if more.isEmpty():
            break
        comp = cut(components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)))
    rest = cut(copies.likely(copies.apart(met, comp, near), counted, near))
    if not rest.isEmpty():
        # Again one partner for each set first; what that does not connect is verified pair by pair.
        sets = sets.union(sets_of(rest, sets))
        best = cut(rest.groupBy("b").agg(F.max_by("a", F.struct("times", "a")).alias("a")).select("a", "b"))
        links = cut(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(copies.verified(best, sets, near)))
        comp = cut(components(links))
        left = rest.select("a", "b").join(best, ["a", "b"], "left_anti")
        for c in ("a", "b"):
            left = left.join(comp.select(F.col("node").alias(c), F.col("component").alias("of_" + c)), c, "left")
        more = cut(copies.verified(left.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b"), sets, near))
        if not more.isEmpty():
            comp = components(links.union(more))
    return rows.join(comp.withColumnRenamed("node", "key"), "key", "left").select("id", "hash", F.coalesce("component", "key").alias("group"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: tuple[int, int] | None = None, **options) -> DataFrame:
    """The rows of ``docs`` that near-duplicate removal leaves, with all their columns.

    Of each group the row with the smallest id stays, one with a null id only if there is
    no other. Where an id repeats, rows are told apart by a hash of their text too: of
    rows with one id the one whose text hashes smallest stays, of equal rows any one.
    Groups are those of fingerprints within RADIUS bits (rows with null ids are then
    grouped by equal fingerprints only), or with ``near`` those of word-shingle sets as
    similar as that (see ``alike``). An empty table gives an empty one. Texts are
    shuffled once, for the join back.
    """
    (mark,) = unused(docs, "_row")
    marked = docs.withColumn(mark, F.struct(named(id_col).cast("long").alias("id"), F.xxhash64(named(text_col).cast("string")).alias("hash")))
    if near:
        groups = alike(docs, id_col, text_col, near=near, **options)
        keys = ["group"]
    else:
        groups = near_duplicates(docs, id_col, text_col, keep_hash=True, **options).withColumnRenamed("doc_id", "id")
        groups = groups.withColumn("alone", F.when(F.col("component_id").isNull(), F.col("fp")))
        keys = ["component_id", "alone"]
    first = groups.groupBy(*keys).agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("f")).select(F.struct("f.id", "f.hash").alias(unused(marked, "_first")[0])).distinct()
    kept = marked.join(first, named(mark).eqNullSafe(named(first.columns[0])), "left_semi")
    if not groups.groupBy("id", "hash").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates([mark])
    return kept.drop(mark)
