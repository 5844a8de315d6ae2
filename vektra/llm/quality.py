"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are numbers of a whole text (shares of character classes, repetition of
words and lines, lengths). Trees are grown on binned statistics and kept as flat
arrays, which a batch of documents walks level by level, all trees at once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import give_back, labelled, parts

#: Bounds of what is learnt from: labelled rows of each class, and characters of one.
PER_CLASS, MOST_CHARS = 4000, 20_000

STATISTICS = (
    "log_chars", "log_words", "mean_word", "upper", "digit", "space", "newline", "comma_stop", "exclaim", "pipe", "symbol",
    "bracket", "other_ascii", "non_ascii", "distinct_words", "top_word", "same_as_previous", "distinct_lines", "mean_line",
    "distinct_pairs", "upper_words", "marked_words", "short_words", "long_words",
)

_CLASS = np.full(256, 9, np.uint8)  # 9: what no other class names
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b",.;:", b"!?", b"|", b"%$#&*~^@+=_<>\\/", b"()[]{}\"'")):
    _CLASS[list(_chars)] = _i
_CLASS[list(b"abcdefghijklmnopqrstuvwxyz")] = 10
_CLASS[128:] = 11
_MARKED = re.compile(rb"[^\w\s.,;:'\"()\x80-\xff-]{2,}")


def statistics(text: str | None) -> list[float]:
    """STATISTICS of a whole text; a null or empty one has zeros (and one line)."""
    raw = (text or "").encode("utf-8", "replace")
    n = max(len(raw), 1)
    share = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=12) / n
    words = raw.split()
    w = max(len(words), 1)
    lines = raw.split(b"\n")
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    pairs = len(set(zip(words, words[1:])))
    same = sum(map(bytes.__eq__, words, words[1:]))
    return [
        np.log1p(len(raw)), np.log1p(len(words)), lengths.sum() / w, share[0], share[1], share[2], share[3], share[4], share[5],
        share[6], share[7], share[8], share[9], share[11], len(counts) / w, max(counts.values(), default=0) / w, same / w,
        len(set(lines)) / len(lines), np.log1p(n / len(lines)), pairs / max(w - 1, 1), sum(map(bytes.isupper, words)) / w,
        len(_MARKED.findall(raw)) / w, float((lengths <= 2).sum()) / w, float((lengths >= 20).sum()) / w,
    ]


@dataclass(frozen=True)
class Forest:
    """Trees as arrays of one row per tree: the node's statistic (-1: leaf), bound, left child and value."""

    start: float
    feature: np.ndarray
    bound: np.ndarray
    left: np.ndarray
    value: np.ndarray
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        trees = np.arange(len(self.feature))
        node = np.zeros((len(x), len(trees)), np.int32)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[trees, node]
            right = x[rows, np.maximum(f, 0)] > self.bound[trees, node]
            node = np.where(f >= 0, self.left[trees, node] + right, node)
        return self.start + self.value[trees, node].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, smooth: float = 2.0, least: float = 1.0) -> Forest:
    """Boosted trees for labels 0 and 1, by logistic loss with second-order gains over binned statistics.

    Fewer than two labels give a forest that always answers the share of ones (0.5
    where there are no rows).
    """
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    start, size = float(np.log(share / (1 - share))), 2 ** (depth + 1) - 1
    feature, left = np.full((trees, size), -1, np.int32), np.zeros((trees, size), np.int32)
    bound, value = np.zeros((trees, size)), np.zeros((trees, size))
    if len(set(y.tolist())) < 2:
        return Forest(start, feature[:1], bound[:1], left[:1], value[:1], 1)
    d = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(d) * bins
    raw = np.full(len(y), start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        free, open_ = 1, [(0, np.arange(len(y)), 0)]
        while open_:
            node, rows, level = open_.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            value[t, node] = -rate * gs / (hs + smooth)
            if level < depth and len(rows) > 1:
                cells = flat[rows].ravel()
                gh = np.stack([np.bincount(cells, np.repeat(v[rows], d), d * bins).reshape(d, bins) for v in (g, h)])
                gl, hl = np.cumsum(gh, axis=2)
                gain = gl**2 / (hl + smooth) + (gs - gl) ** 2 / (hs - hl + smooth) - gs**2 / (hs + smooth)
                gain[(hl < least) | (hs - hl < least)] = -1
                j, b = divmod(int(gain.argmax()), bins)
                if gain[j, b] > 1e-6 and b < len(edges[j]):
                    feature[t, node], bound[t, node], left[t, node] = j, edges[j][b], free
                    goes = binned[rows, j] > b
                    open_ += [(free, rows[~goes], level + 1), (free + 1, rows[goes], level + 1)]
                    free += 2
                    continue
            raw[rows] += value[t, node]
    return Forest(start, feature, bound, left, value, depth)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, most_chars: int = MOST_CHARS, id_col: str = "doc_id", text_col: str = "text") -> Forest:
    """A forest from a bounded sample of labelled rows: ``per_class`` of each label at most.

    Rows that are held out (see shared.held_out) are never learnt from. Statistics
    are computed by the tasks; the driver gets numbers only.
    """
    rows = labelled(docs, labels, label, per_class, id_col, text_col, most_chars)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t) for part in parts(batch.column(0)) for t in part]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "label"])

    got = rows.mapInArrow(count, "x array<double>, label int").toPandas()
    x = np.array(got["x"].tolist()).reshape(-1, len(STATISTICS))
    y = got["label"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # rows come in any order; the forest shall not depend on it
    return fit(x[order], y[order])


def score(text: Column, model: Forest) -> Column:
    """Score (0 to 1) of each whole text; null and empty texts have one too."""

    @F.arrow_udf("double")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            x = np.array([statistics(t) for part in parts(batch) for t in part]).reshape(-1, len(STATISTICS))
            yield pa.array(model.score(x))
        batch = x = None
        give_back()

    return run(text.cast("string"))


def classify(docs: DataFrame, model: Forest, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``(doc_id, score, predicted)``, one row per row of ``docs``; other columns are not read.

    No exchange, no state between batches: repeated rows get equal scores, null ids
    stay, an empty table gives no rows.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), score(F.col(text_col), model).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep(docs: DataFrame, model: Forest, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns."""
    return docs.where(score(F.col(text_col), model) >= threshold)
