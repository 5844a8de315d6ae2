"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as its own hashed embedding and the mean of its hashed character
n-grams' embeddings. Two recurrent passes read each window of words; attention pools
their states into one logit. A document scores as its worst window, over all
overlapping windows of the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import give_back, labelled, parts

#: Bounds of what is learnt from: labelled rows of each class, and characters of one.
PER_CLASS, MOST_CHARS = 1200, 12_000
#: Words of a window and between the starts of two.
WINDOW, STRIDE = 32, 24
HIDDEN, EMBED, ATTEND = 8, 12, 8
WORD_ROWS, GRAM_ROWS, GRAMS = 1 << 13, 1 << 14, (3, 4, 5)
#: Windows computed at a time, and words whose input a worker keeps (emptied when full).
BATCH, KEPT = 1024, 200_000

_WORD, _GAP = re.compile(r"\w+"), re.compile(r"\W")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def blocks(text: str | None, size: int = 1 << 20) -> Iterator[str]:
    """A text in parts of about ``size`` characters that end between words."""
    text, at = text or "", 0
    while at < len(text):
        gap = _GAP.search(text, at + size) if at + size < len(text) else None
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def inputs(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word its embedding row; then all n-gram rows and where each word's begin."""
    raw = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-8", "replace"), np.uint8)
    begin = np.flatnonzero(raw == 60)
    of = np.cumsum(raw == 60) - 1
    code = raw.astype(np.uint64) + np.uint64(1)
    place = (np.arange(len(raw)) - begin[of]).astype(np.uint64)
    whole = np.add.reduceat(code * (place * _MIX + np.uint64(1)) ** 3, begin)
    rows, at = [], []
    for n in GRAMS:
        if len(raw) < n:
            continue
        ok = np.flatnonzero(of[: len(raw) - n + 1] == of[n - 1 :])
        h = np.zeros(len(ok), np.uint64)
        for j in range(n):
            h = h * np.uint64(257) + code[ok + j]
        rows.append((((h + np.uint64(n)) * _MIX) >> np.uint64(40)) % np.uint64(GRAM_ROWS))
        at.append(of[ok])
    rows, at = np.concatenate(rows).astype(np.int64), np.concatenate(at)
    order = np.argsort(at, kind="stable")
    return (((whole * _MIX) >> np.uint64(40)) % np.uint64(WORD_ROWS)).astype(np.int64), rows[order], np.searchsorted(at[order], np.arange(len(words)))


def window_starts(n: int, window: int = WINDOW, stride: int = STRIDE) -> list[int]:
    """Starts of the windows that cover n words; the last one ends with the text."""
    return [0] if n <= window else [*range(0, n - window, stride), n - window]


def fresh(seed: int = 7) -> dict[str, np.ndarray]:
    """Untrained parameters."""
    rng, h = np.random.default_rng(seed), HIDDEN
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    return {
        "word": draw(WORD_ROWS, EMBED, scale=0.1), "gram": draw(GRAM_ROWS, EMBED, scale=0.3), "in": draw(2 * EMBED, 6 * h, scale=0.3), "bias": np.zeros(6 * h, np.float32),
        "rec": draw(2, h, 3 * h, scale=0.3), "att": draw(2 * h, ATTEND, scale=0.3), "att_b": np.zeros(ATTEND, np.float32), "att_v": draw(ATTEND, scale=0.3),
        "out": draw(2 * h, scale=0.3), "out_b": np.zeros(1, np.float32),
    }


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def embed(p: dict, feats) -> np.ndarray:
    rows, grams, begin = feats
    count = np.diff(np.append(begin, len(grams)))[:, None]
    return np.concatenate([p["word"][rows], np.add.reduceat(p["gram"][grams], begin, axis=0) / count], axis=1)


def project(p: dict, feats, at_once: int = 10_000) -> np.ndarray:
    """Projected inputs of all words, a bounded number of them at a time."""
    rows, grams, begin = feats
    end = np.append(begin, len(grams))
    out = np.empty((len(rows), 6 * HIDDEN), np.float32)
    for a in range(0, len(rows), at_once):
        b = min(a + at_once, len(rows))
        part = (rows[a:b], grams[end[a] : end[b]], begin[a:b] - begin[a])
        out[a:b] = embed(p, part) @ p["in"] + p["bias"]
    return out


def forward(p: dict, x: np.ndarray, mask: np.ndarray | None, keep: bool = False):
    """Logits of windows from their projected inputs ``x`` (time, window, 6 * HIDDEN).

    ``mask`` (time, window): 1 for words, 0 for padding; None where all are words.
    """
    steps, n, _ = x.shape
    h = HIDDEN
    both = np.stack([x[:, :, : 3 * h], x[::-1, :, 3 * h :]], axis=1)  # time, direction, window
    m2 = None if mask is None else np.stack([mask, mask[::-1]], axis=1)[..., None]
    state = np.zeros((2, n, h), np.float32)
    states = np.empty((steps, 2, n, h), np.float32)
    kept = []
    for t in range(steps):
        rec = state @ p["rec"]
        gates = _sigmoid(both[t, :, :, : 2 * h] + rec[:, :, : 2 * h])
        z, r = gates[:, :, :h], gates[:, :, h:]
        new = np.tanh(both[t, :, :, 2 * h :] + r * rec[:, :, 2 * h :])
        nxt = new + z * (state - new)
        if m2 is not None:
            nxt *= m2[t]
        if keep:
            kept.append((state, z, r, new, rec[:, :, 2 * h :]))
        state = states[t] = nxt
    seq = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)  # time, window, 2 * HIDDEN
    u = np.tanh(seq @ p["att"] + p["att_b"])
    e = u @ p["att_v"]
    if mask is not None:
        e = e + (mask - 1) * 30
    a = np.exp(e - e.max(axis=0))
    if mask is not None:
        a *= mask
    a /= np.maximum(a.sum(axis=0), 1e-9)
    pooled = np.einsum("tn,tnk->nk", a, seq)
    logit = pooled @ p["out"] + p["out_b"]
    return (logit, (m2, kept, seq, u, a, pooled)) if keep else logit


def backward(p: dict, kept_all, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the parameters above the inputs, and of the projected inputs."""
    m2, kept, seq, u, a, pooled = kept_all
    h, steps = HIDDEN, len(kept)
    g = {"out": pooled.T @ dlogit, "out_b": np.array([dlogit.sum()], np.float32)}
    dpool = dlogit[:, None] * p["out"]
    dseq = a[:, :, None] * dpool
    da = np.einsum("tnk,nk->tn", seq, dpool)
    de = a * (da - (a * da).sum(axis=0))
    g["att_v"] = np.einsum("tn,tnk->k", de, u)
    du = de[:, :, None] * p["att_v"] * (1 - u * u)
    g["att_b"] = du.sum(axis=(0, 1))
    g["att"] = np.einsum("tni,tnj->ij", seq, du)
    dseq += du @ p["att"].T
    dstates = np.stack([dseq[:, :, :h], dseq[::-1, :, h:]], axis=1)
    dboth = np.empty((steps, *dstates.shape[1:3], 3 * h), np.float32)
    drec_w, back = np.zeros_like(p["rec"]), 0
    for t in range(steps - 1, -1, -1):
        state, z, r, new, rn = kept[t]
        d = dstates[t] + back
        if m2 is not None:
            d = d * m2[t]
        dnew = d * (1 - z) * (1 - new * new)
        dz = d * (state - new) * z * (1 - z)
        dr = dnew * rn * r * (1 - r)
        dboth[t, :, :, :h], dboth[t, :, :, h : 2 * h], dboth[t, :, :, 2 * h :] = dz, dr, dnew
        drec = np.concatenate([dz, dr, dnew * r], axis=2)
        drec_w += state.transpose(0, 2, 1) @ drec
        back = d * z + drec @ p["rec"].transpose(0, 2, 1)
    g["rec"] = drec_w
    return g, np.concatenate([dboth[:, 0], dboth[::-1, 1]], axis=2)


class _Adam:
    def __init__(self, p: dict, rate: float):
        self.rate, self.t = rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, p: dict, g: dict) -> None:
        self.t += 1
        fix = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, x in g.items():
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.001 * (x * x - self.v[k])
            p[k] -= fix * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)


def _parts(values: list, size: int) -> list[list]:
    return [values[i : i + size] for i in range(0, len(values), size)]


def fit(texts: list[str], y: np.ndarray, steps: int = 250, each: int = 8, batch: int = 512, rate: float = 0.02, drop: float = 0.5, decay: float = 2e-4, seed: int = 7) -> dict:
    """Parameters from labelled texts, by back-propagation through time.

    A document's label is that of its worst window. The first fifth of the batches takes
    windows of toxic documents at random, later ones those that score highest so far.
    Batches go on until there were ``steps`` of them, whatever the number of texts. Of
    clean documents half are the highest, half at random, ``each`` windows at most a
    document and epoch. Word embeddings are left out with probability ``drop``, so
    that characters tell too, and embeddings decay. With labels of one kind only, all
    texts score as that kind (as 0 without any).
    """
    rng, p = np.random.default_rng(seed), fresh(seed)
    if len(set(y.tolist())) < 2:
        p["out"][:] = 0
        p["out_b"][:] = 5.0 if len(y) and y[0] else -5.0
        return p
    vocab: dict[str, int] = {}
    lists = [np.array([vocab.setdefault(w, len(vocab)) for w in words_of(t)], np.int32) for t in texts]
    pad = len(vocab)
    feats = [inputs(part) for part in _parts([*vocab, "padding"], 20_000)]
    offset = np.cumsum([0, *(len(f[1]) for f in feats)])
    feats = (np.concatenate([f[0] for f in feats]), np.concatenate([f[1] for f in feats]).astype(np.int32), np.concatenate([f[2] + o for f, o in zip(feats, offset)]))
    count = np.diff(np.append(feats[2], len(feats[1])))
    windows, owner = [], []
    for i, ids in enumerate(lists):
        for s in window_starts(len(ids)):
            row = np.full(WINDOW, pad, np.int32)
            row[: len(ids[s : s + WINDOW])] = ids[s : s + WINDOW]
            windows.append(row)
            owner.append(i)
    windows, owner = np.array(windows), np.array(owner)
    opt = _Adam(p, rate)

    def logits(rows):
        table = project(p, feats)
        return np.concatenate([forward(p, table[windows[rows[i : i + BATCH]].T], (windows[rows[i : i + BATCH]].T != pad).astype(np.float32)) for i in range(0, len(rows), BATCH)])

    def choose(done):
        key = rng.random(len(windows))
        if done >= 0.2:
            got = logits(np.arange(len(windows)))
            hard = (y[owner] == 1) | (rng.random(len(windows)) < 0.5)
            key = np.where(hard, -got, key * 8 - 4)
        order = np.lexsort((key, owner))
        first = np.searchsorted(owner[order], owner[order])
        place = np.arange(len(order)) - first
        most = np.where((y[owner[order]] == 1) & (done >= 0.2), 1 + (done < 0.4), each)
        chosen = order[place < most]
        return rng.permutation(chosen)

    while opt.t < steps:
        chosen = choose(opt.t / steps)
        share = y[owner[chosen]].mean()
        weight = np.array([0.5 / (1 - share), 0.5 / share], np.float32)
        for i in range(0, len(chosen), batch):
            rows = chosen[i : i + batch]
            idx, target = windows[rows].T, y[owner[rows]].astype(np.float32)
            used, inverse = np.unique(idx, return_inverse=True)
            inverse = inverse.reshape(idx.shape)
            begin = np.concatenate([[0], np.cumsum(count[used])[:-1]])
            spans = np.repeat(feats[2][used] - begin, count[used]) + np.arange(count[used].sum())
            mine = (feats[0][used], feats[1][spans], begin)
            x = embed(p, mine)
            seen = (rng.random((len(used), 1)) >= drop).astype(np.float32) / (1 - drop)
            x[:, :EMBED] *= seen
            mask = (idx != pad).astype(np.float32)
            logit, kept = forward(p, (x @ p["in"] + p["bias"])[inverse], None if mask.all() else mask, keep=True)
            dlogit = ((_sigmoid(logit) - target) * weight[target.astype(int)] / len(rows)).astype(np.float32)
            g, dx = backward(p, kept, dlogit)
            flat, order = inverse.ravel(), np.argsort(inverse.ravel(), kind="stable")
            dproj = np.add.reduceat(dx.reshape(-1, dx.shape[2])[order], np.searchsorted(flat[order], np.arange(len(used))), axis=0)
            g["in"], g["bias"] = x.T @ dproj, dproj.sum(axis=0)
            dword = dproj @ p["in"].T
            g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
            np.add.at(g["word"], mine[0], dword[:, :EMBED] * seen)
            grad = np.repeat(dword[:, EMBED:] / count[used][:, None], count[used], axis=0)
            for j in range(EMBED):
                g["gram"][:, j] = np.bincount(mine[1], grad[:, j], GRAM_ROWS)
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            if norm > 1:
                g = {k: v / norm for k, v in g.items()}
            opt.step(p, g)
            for k in ("word", "gram"):
                p[k] *= 1 - decay
    return {k: v.astype(np.float32) for k, v in p.items()}


class Scorer:
    """Scores texts; keeps the projected inputs of words it has met."""

    def __init__(self, p: dict, kept: int = KEPT):
        self.p, self.kept = p, kept
        self.rows: dict[str, int] = {}
        # One table for all words that are kept: memory is taken as rows are written, and none is copied.
        self.table = np.empty((kept + 20_000, 6 * HIDDEN), np.float32)
        self.table[0] = 0

    def _learn(self, words: list[str]) -> None:
        first = len(self.rows) + 1  # row 0 is padding
        need = first + len(words)
        if need > len(self.table):
            self.table = np.concatenate([self.table[:first], np.empty((max(need, len(self.table) * 5 // 4) - first, 6 * HIDDEN), np.float32)])
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            self.table[first + at : first + at + len(part)] = project(self.p, inputs(part))
        self.rows.update(zip(words, range(first, need)))

    def worst(self, text: str | None) -> list[np.ndarray]:
        """The windows of a text, as rows of word numbers."""
        if len(self.rows) > self.kept:
            self.rows.clear()
        parts = [np.empty(0, np.int32)]
        for block in blocks(text):
            ws = words_of(block)
            new = set(ws).difference(self.rows)
            if new:
                self._learn(list(new))
            parts.append(np.fromiter(map(self.rows.__getitem__, ws), np.int32, len(ws)))
        ids = np.concatenate(parts)
        if len(ids) < WINDOW:
            return np.concatenate([ids, np.zeros(WINDOW - len(ids), np.int32)])[None]
        return np.lib.stride_tricks.sliding_window_view(ids, WINDOW)[window_starts(len(ids))]

    def score(self, texts) -> np.ndarray:
        """A score (0 to 1) for each text, computed over a bounded number of windows at a time."""
        out = np.full(len(texts), -np.inf)
        held, owner, n = [], [], 0

        def flush():
            nonlocal held, owner, n
            if n:
                windows, of = np.concatenate(held), np.concatenate(owner)
                for at in range(0, n, BATCH):
                    idx = windows[at : at + BATCH].T
                    mask = idx != 0
                    np.maximum.at(out, of[at : at + BATCH], forward(self.p, self.table[idx], None if mask.all() else mask.astype(np.float32)))
                held, owner, n = [], [], 0

        for i, text in enumerate(texts):
            if len(self.rows) > self.kept:
                flush()  # the numbers of the windows held are about to change
            got = self.worst(text)
            for at in range(0, len(got), 8 * BATCH):
                part = got[at : at + 8 * BATCH]
                held.append(part)
                owner.append(np.full(len(part), i))
                n += len(part)
                if n >= 8 * BATCH:
                    flush()
        flush()
        return _sigmoid(out)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, most_chars: int = MOST_CHARS, id_col: str = "doc_id", text_col: str = "text", **options) -> dict:
    """Parameters from a bounded sample of labelled rows, ``per_class`` of each label at most.

    Rows that are held out (see shared.held_out) are never learnt from. The driver
    gets at most ``2 * per_class * most_chars`` characters, and gives the memory of
    the training back to the system, as the driver lives on for later stages.
    """
    got = labelled(docs, labels, label, per_class, id_col, text_col, most_chars).toPandas()
    got["text"] = got["text"].fillna("")
    got = got.sort_values(["label", "text"])
    model = fit(got["text"].tolist(), got["label"].to_numpy().astype(int), **options)
    del got
    give_back()
    return model


def scores(batches: Iterator[pa.Array], model: dict) -> Iterator[pa.Array]:
    """Scores of the texts of each Arrow array, few of them Python objects at a time.

    Python workers live on and serve later stages, so what was taken is given back.
    """
    scorer = Scorer(model)
    for batch in batches:
        yield pa.array(np.concatenate([scorer.score(part) for part in parts(batch)] or [np.empty(0)]))
    batch = scorer = None
    give_back()


def score(text: Column, model: dict) -> Column:
    """Score (0 to 1) of each whole text; null and empty texts have one too."""

    @F.arrow_udf("double")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return scores(texts, model)

    return run(text.cast("string"))


def classify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``(doc_id, score, predicted)``, one row per row of ``docs``; other columns are not read.

    No exchange. Repeated rows get equal scores, null ids stay, an empty table gives
    no rows; a very long text is scored a bounded number of windows at a time.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), score(F.col(text_col), model).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep(docs: DataFrame, model: dict, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, with all their columns."""
    return docs.where(score(F.col(text_col), model) < threshold)
