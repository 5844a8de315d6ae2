"""What several operators of this subpackage need: tables, lineage cuts, components."""

from __future__ import annotations

import contextlib
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage.

    The folder is the one that the cluster names in ``spark.checkpoint.dir``. Where
    that is unset, a temporary one is set in local mode only; on a cluster, whose
    machines share no such folder, this is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="vektra-ckpt-"))
    return df.checkpoint(eager=True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def named(column: str) -> Column:
    """The column of exactly that name, whatever signs are in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def scan(items: Column, state: Column, empty: Column, step: Callable[[Column, Column], Column], block: int = 512) -> Column:
    """A fold over an array that gives out items on its way: struct (state, out).

    ``step(acc, x)`` gives the next struct (state, out) from one of the same kind.
    Arrays are copied as they grow, so what is given out grows within a block of
    items first and is then put behind the earlier blocks': time is near linear.
    """

    def over(rows):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / block).cast("int")), lambda i: F.slice(rows, i * block + 1, F.lit(block)))
        start = lambda s: F.struct(s.alias("state"), empty.alias("out"))

        def each(acc, part):
            return let(F.aggregate(part, start(acc["state"]), step), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], r["out"]).alias("out")))

        return F.when(F.size(rows) > 0, F.aggregate(blocks, start(state), each)).otherwise(start(state))

    return let(items, over)


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bounded_sample(rows: DataFrame, key: str, label: str, per_class: int) -> DataFrame:
    """At most ``per_class`` rows of each of the labels 0 and 1, the first by a hash of the key.

    A sort with a limit: each task keeps its own first rows, so nothing but the
    bound travels. The result has at most ``2 * per_class`` rows by construction
    and may therefore be broadcast.
    """
    order = [F.xxhash64(F.col(key).cast("string")), F.col(key)]
    parts = [rows.where(F.col(label) == v).orderBy(*order).limit(per_class) for v in (0, 1)]
    return parts[0].unionByName(parts[1])


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text", most_chars: int = 20_000) -> DataFrame:
    """``(text, label)`` of a bounded, balanced sample of labelled rows that may be learnt from.

    Training rows longer than ``most_chars`` are left out (of training only). Ids that
    repeat with both labels give both rows; of documents with one id only that with
    the smallest text hash is learnt from. So there are ``2 * per_class`` rows at
    most, and what reaches the driver is bounded by ``2 * per_class * most_chars``
    characters.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(id_col))).select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).distinct()
    picked = bounded_sample(usable, "_id", "_y", per_class)
    mine = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).where(F.length("_text") <= most_chars)
    met = mine.join(F.broadcast(picked), F.col("_doc") == F.col("_id"))
    least = F.min(F.struct(F.xxhash64("_text").alias("h"), F.col("_text").alias("t")))  # each task keeps one of an id's documents
    return met.groupBy("_id", "_y").agg(least.alias("_m")).select(F.col("_m.t").alias("text"), F.col("_y").alias("label"))


def _with_least(side: DataFrame, least: DataFrame, hub: int | None) -> DataFrame:
    """``side`` (u, v) with ``least`` (u, m, n) joined on u; ``n``: how many rows of that u ``side`` has at most.

    With ``hub`` the rows of a u with over so many are dealt over salts; the list of
    these u is broadcast and has under ``rows of side / hub`` rows. Else nothing is
    broadcast: the driver would hold every round's.
    """
    if hub is None:
        return side.hint("merge").join(least.hint("merge"), "u")
    salts = F.ceil(F.col("n") / hub).cast("int")
    hubs = least.where(F.col("n") > hub).select(F.col("u").alias("_u"), salts.alias("_s"))
    left = side.join(F.broadcast(hubs), F.col("u") == F.col("_u"), "left").select("u", "v", F.coalesce(F.pmod(F.xxhash64("v"), F.col("_s")), F.lit(0)).cast("int").alias("_p"))
    right = least.select("u", "m", F.explode(F.sequence(F.lit(0), salts - 1)).alias("_p"))
    return left.hint("merge").join(right.hint("merge"), ["u", "_p"])


#: Links that one task contracts on its own, without an exchange; more are dealt out.
ONE_TASK = 200_000


def _contract(batches):
    """All links (u, v) of one task as ``(node, component)``: roots hook on the smallest they touch until no link joins two."""
    import numpy as np
    import pyarrow as pa

    ends = [[np.empty(0, np.int64)], [np.empty(0, np.int64)]]
    for batch in batches:
        for end, column in zip(ends, batch.columns):
            end.append(column.to_numpy())
    nodes, at = np.unique(np.concatenate([*ends[0], *ends[1]]), return_inverse=True)
    a, b = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while len(a):
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "component"])


def components(links: DataFrame, rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """Connected components of ``(a, b)`` links: ``(node, component)``, the smallest node reachable.

    Alternates large-star and small-star contraction, each an aggregate of the
    smallest neighbour and a join back, until nothing changes. Links stay
    distributed and each round is cut in the shared checkpoint folder, so a lost
    executor costs one round. The links of a node with very many are dealt out.
    Up to ``one_task`` links are contracted by one task in one go, so the driver need not
    plan and keep track of rounds of them. Nodes with no link have no row.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    size = edges.count()
    if size <= one_task:
        return cut(edges.coalesce(1).mapInArrow(_contract, "node long, component long"))
    seen = None
    for _ in range(rounds):
        both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
        hub = max(1024, size // 4096)  # 2 * size rows have 8192 hubs at most
        hub = None if least.where(F.col("n") > hub).isEmpty() else hub
        large = _with_least(both.where("v > u"), least, hub).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        # Each node's links, and the node itself, go to its smallest neighbour.
        stars = _with_least(large, low, hub).select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v"))))).where("u <> v")
        edges = cut(stars.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen, size = now, now.n
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.col("m").alias("component")).union(edges.select("v", "v").distinct())


def parts(column, rows: int = 512, most: int = 1 << 20):
    """The values of an Arrow column of texts as lists, of ``rows`` values or about ``most`` bytes at most, or of one longer text.

    A batch has up to 10,000 rows; only one part's texts are Python objects at a time.
    """
    import numpy as np
    import pyarrow.compute as pc

    if not len(column):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(column):
        before = ends[at - 1] if at else 0
        end = min(max(int(np.searchsorted(ends, before + most, side="right")), at + 1), at + rows)
        yield column.slice(at, end - at).to_pylist()
        at = end


def give_back() -> None:
    """Give memory that is free in this Python process back to the system, where its C library can."""
    import ctypes

    with contextlib.suppress(AttributeError, OSError, TypeError):
        ctypes.CDLL(None).malloc_trim(0)


def whole_groups(batches, keys: int):
    """Arrow tables of whole groups, from batches that are sorted by their first ``keys`` columns.

    Holds one batch and the rows of its last group, which the next batch may continue;
    callers bound the rows of a group.
    """
    import numpy as np
    import pyarrow as pa

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        got = pa.Table.from_batches([batch])
        got = got if held is None else pa.concat_tables([held, got])
        last = np.ones(got.num_rows, bool)
        for i in range(keys):
            column = got.column(i).to_numpy()
            last &= column == column[-1]
        cut = got.num_rows - int(np.argmin(np.append(last[::-1], False)))
        if cut:
            yield got.slice(0, cut).combine_chunks()
        held = got.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def group_bounds(table, keys: int):
    """Where the groups of a sorted table begin, and its end."""
    import numpy as np

    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for i in range(keys):
        column = table.column(i).to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def matrix(column, rows: int):
    """A (rows, length) double array of a list column whose lists have one length."""
    import numpy as np

    flat = column.combine_chunks().flatten() if hasattr(column, "combine_chunks") else column.flatten()
    return np.asarray(flat, np.float64).reshape(rows, -1)


def usable(vector: Column, dim: Column | int | None = None) -> Column:
    """Whether a vector has a direction: not null, of finite non-null components, not all zero."""
    v = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(fine, F.lit(False))
