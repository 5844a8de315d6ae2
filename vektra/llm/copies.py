"""Word-shingle sets: what near-duplicate stages verify on, and an exact similarity join by prefix filters.

A text is its set of shingles, their hashes in one order that all texts share, rare
ones first. Two sets with a Jaccard similarity of 4/5 or more have a shingle in
common within the first ``n - ceil(4n/5) + 1`` of each, so texts that meet in no
such shingle need no comparison. Those that meet are verified on their whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SEED = 42
#: Words of a shingle, and the least similarity as a fraction.
WIDTH, NEAR = 5, (4, 5)
#: Places of a set's counts, see ``counts``.
PLACES = 256
#: Of so many rows one has its shingles counted to tell frequent ones, and bounds of what counts as
#: frequent. Any order is right, this one is fast; a share, so that it is as good for any number of rows.
ONE_IN, OFTEN, MOST_OFTEN = 4, 3, 500_000
#: Sets in a prefix shingle from which ``strangers`` connects them before ``apart`` pairs them, and how often it tries.
CROWD, TURNS = 16, 4


def hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Hashes of a text's shingles, repeats included; of all its words where these are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    flat, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(flat, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    stops = (ends[width - 1 :] - 1).tolist()
    starts = [0, *ends[: len(ends) - width].tolist()]
    return np.fromiter((digest(flat[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(starts))


def prefix(found: np.ndarray, often: np.ndarray, times: np.ndarray, near: tuple[int, int] = NEAR) -> np.ndarray:
    """The first shingles of a set, of which sets as similar as ``near`` share one; rare ones come first."""
    n = len(found)
    if not n:
        return found
    at = np.minimum(np.searchsorted(often, found), max(len(often) - 1, 0))
    rank = np.where(often[at] == found, times[at], 0) if len(often) else np.zeros(n, np.int64)
    return found[np.lexsort((found, rank))][: n - -(-near[0] * n // near[1]) + 1]


def counts(found: np.ndarray) -> bytes:
    """How many shingles of a set have each of the low bytes of a hash, 255 standing for more too."""
    return np.minimum(np.bincount((found % np.uint64(PLACES)).astype(np.int64), minlength=PLACES), 255).astype(np.uint8).tobytes()


def frequent(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles of a sample of rows ``(text, hash)``, ascending, and how often each is there."""
    def run(batches):
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(hashes(t.as_py(), width)).view(np.int64))], names=["s"])

    some = texts.where(F.pmod("hash", F.lit(ONE_IN)) == 0).select("text").mapInArrow(run, "s long")
    rows = some.groupBy("s").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "s").limit(MOST_OFTEN).toArrow()
    often = rows.column("s").to_numpy().view(np.uint64)
    order = np.argsort(often)
    return often[order], rows.column("count").to_numpy()[order]


def likely(pairs: DataFrame, nodes: DataFrame, near: tuple[int, int] = NEAR, off: str | None = None) -> DataFrame:
    """Those of the pairs ``(a, b, ...)`` whose ``counts`` do not rule out that their sets are similar enough.

    A shingle that only one set has changes one count by one, so the counts' Manhattan
    distance is at most the sets' difference: no similar pair is lost, and whole sets
    travel for few others. ``nodes``: ``(key, n, counts)``, one row per key. ``off`` names
    a column more: that distance as a share of both sizes, least for the likeliest.
    """
    up, down = near
    names = pairs.columns
    one, two = (nodes.select(F.col("key").alias(c), F.col("n").alias("n" + c), F.col("counts").alias("c" + c)) for c in "ab")
    both = pairs.join(one, "a").join(two, "b").select(*names, "na", "nb", "ca", "cb")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PLACES).astype(np.int16) for c in ("ca", "cb"))
            apart_by = np.abs(x - y).sum(axis=1, dtype=np.int64)
            total = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            out = batch.select(names)
            if off:
                out = pa.RecordBatch.from_arrays([*out.columns, pa.array(apart_by / np.maximum(total, 1))], names=[*names, off])
            yield out.filter(pa.array(apart_by * (up + down) <= total * (down - up)))

    return both.mapInArrow(run, StructType([*pairs.schema.fields]).add(off, "double") if off else pairs.schema)


def verified(pairs: DataFrame, sets: DataFrame, near: tuple[int, int] = NEAR) -> DataFrame:
    """Those of the pairs ``(a, b)`` whose whole sets ``(key, set)`` are similar enough."""
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                same = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(near[1] * same >= near[0] * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _may_be_near(near: tuple[int, int], one: str, two: str):
    """Whether two sets, by their sizes n and the place ``at`` of a shared prefix shingle, may be as similar as ``near``."""
    up, down = near
    n1, n2, at1, at2 = (F.col(c + i) for c in ("n", "at") for i in (one, two))
    # What two sets may still share from their first common shingle on.
    rest = F.least(n1 - at1, n2 - at2) * (up + down) >= (n1 + n2) * up
    return rest & (F.least(n1, n2) * down >= F.greatest(n1, n2) * up)


def meeting(rows: DataFrame, near: tuple[int, int] = NEAR) -> DataFrame:
    """``(s, n, at, key, key0)``: each set's places in prefix shingles that it shares, and the set before it there if they may be similar.

    ``rows``: distinct ``(key, n, first)``. Sets of one shingle come in the order of their
    sizes, so a set's neighbour is the likeliest to be like it. Rows are dealt by range,
    so a very frequent shingle's are spread; at a task's borders rows stay even where
    they seem alone, and the first has no neighbour.
    """
    posts = rows.select("n", "key", F.posexplode("first").alias("at", "s")).select("s", "n", F.col("at").cast("long").alias("at"), "key")
    names = ["s", "n", "at", "key", "key0"]
    up, down = near

    def run(batches):
        held = None  # the last row so far: its columns and those of the one before it (None at the task's first)

        def given(columns, before, others, keep):
            (s, n, at, key), (n0, at0, key0) = columns, others
            fits = (np.minimum(n - at, n0 - at0) * (up + down) >= (n + n0) * up) & (np.minimum(n, n0) * down >= np.maximum(n, n0) * up)
            arrays = [pa.array(s), pa.array(n), pa.array(at), pa.array(key), pa.array(key0, mask=~(before & fits))]
            return pa.RecordBatch.from_arrays(arrays, names=names).filter(pa.array(keep))

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy() for c in batch.columns]
            if held is not None:
                columns = [np.concatenate([h, c]) for h, c in zip(held[0], columns)]
            same = columns[0][1:] == columns[0][:-1]
            before = np.append(held is not None and held[1], same)
            others = [np.append(held[2][i] if held is not None else 0, c[:-1]) for i, c in enumerate(columns[1:])]
            keep = before | np.append(same, False)
            keep[0] |= held is None
            keep[-1] = False  # given out when it is known what follows
            edge = held is not None and held[3]
            keep[0] |= edge and len(keep) > 1
            yield given(columns, before, others, keep)
            held = [c[-1:] for c in columns], bool(before[-1]), [c[-1] for c in others], (held is None or edge) and len(keep) == 1
        if held is not None:
            yield given(held[0], np.array([held[1]]), [np.array([c]) for c in held[2]], np.array([True]))

    dealt = posts.repartitionByRange("s", "n", "key").sortWithinPartitions("s", "n", "key")
    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def neighbours(met: DataFrame) -> DataFrame:
    """``(a, b, times)``: sets that come after each other in a shingle and may be similar, and in how many."""
    pairs = met.where("key0 is not null").select(F.least("key0", "key").alias("a"), F.greatest("key0", "key").alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("times"))


def crowded(met: DataFrame, crowd: int = CROWD) -> DataFrame:
    """The rows of ``met`` in shingles of over ``crowd`` sets."""
    return met.join(met.groupBy("s").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > crowd).select("s"), "s").select("s", "n", "at", "key")


def strangers(met: DataFrame, comp: DataFrame, turn: int, near: tuple[int, int] = NEAR) -> DataFrame:
    """Pairs ``(a, b)`` of sets of different components that come after each other in a shingle, in an order that ``turn`` draws, and may be similar.

    At most one pair for a row of ``met``. In a group of near copies each set meets others
    in each of its shingles, so the likeliest of them soon connect the group.
    """
    placed = met.join(comp, F.col("key") == F.col("node"), "left").select("s", "n", "at", "key", F.coalesce("component", "key").alias("c"))
    drawn = placed.withColumn("h", F.xxhash64("s", "key", F.lit(turn)))
    up, down = near

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [x.to_numpy() for x in batch.columns]
            if held is not None:
                columns = [np.concatenate([h, x]) for h, x in zip(held, columns)]
            held = [x[-1:] for x in columns]
            (s0, n0, at0, key0, c0), (s, n, at, key, c) = ([x[cut] for x in columns] for cut in (slice(None, -1), slice(1, None)))
            fits = (np.minimum(n - at, n0 - at0) * (up + down) >= (n + n0) * up) & (np.minimum(n, n0) * down >= np.maximum(n, n0) * up)
            pair = pa.RecordBatch.from_arrays([pa.array(np.minimum(key, key0)), pa.array(np.maximum(key, key0))], names=["a", "b"])
            yield pair.filter(pa.array((s == s0) & (c != c0) & fits))

    dealt = drawn.repartitionByRange("s", "h").sortWithinPartitions("s", "h").select("s", "n", "at", "key", "c")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def apart(met: DataFrame, comp: DataFrame, near: tuple[int, int] = NEAR) -> DataFrame:
    """Pairs ``(a, b, times)`` that meet in shingles, so many, may be as similar as ``near`` and lie in different components.

    ``met``: what ``meeting`` gives; ``comp``: ``(node, component)`` of what is linked
    already. In a shingle where nearly all sets lie in one component, only the others
    are paired, so a large group that hangs together costs no pairs.
    """
    placed = met.join(comp, F.col("key") == F.col("node"), "left").select("s", "n", "at", "key", F.coalesce("component", "key").alias("c"))
    largest = placed.groupBy("s", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("s").agg(F.max_by("c", F.struct("m", "c")).alias("big"), F.count(F.lit(1)).alias("k")).where("k > 1").select("s", "big")
    mixed = placed.join(largest, "s")
    left, right = (mixed.select("s", "big", *[F.col(c).alias(c + i) for c in ("key", "n", "at", "c")]) for i in "12")
    left = left.where("c1 <> big").drop("big")
    once = (F.col("c2") == F.col("big")) | (F.col("key1") < F.col("key2"))
    pairs = left.join(right, "s").where((F.col("c1") != F.col("c2")) & once & _may_be_near(near, "1", "2"))
    return pairs.select(F.least("key1", "key2").alias("a"), F.greatest("key1", "key2").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("times"))
