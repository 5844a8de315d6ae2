"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is read here; its normaliser, space marker, scores and byte
fallback are rebuilt as a tokenizers pipeline: a unigram model takes the scores as they
are, a BPE model takes them as the order of its merges. All ids come from that
pipeline; ``parity`` verifies for every text that SentencePiece gives the same.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Kinds of pieces and models in the protobuf (fixed values).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Characters that are encoded at a time, if a single text is not longer.
SLICE = 500_000
#: Threads that the library encodes a batch with, in each worker.
THREADS = 2
#: Words whose ids a worker keeps.
KEPT_WORDS = 300_000

_SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@dataclass
class Model:
    """What a model file holds, as far as encoding and decoding need it."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True
    suffix: bool = False


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = varint()
        wire = key & 7
        if wire == 0:
            value = varint()
        elif wire in (1, 2, 5):
            size = {1: 8, 5: 4}.get(wire) or varint()
            value, at = data[at : at + size], at + size
        else:
            raise ValueError("not a model file")
        yield key >> 3, value


def parse(data: bytes) -> Model:
    """The model in a serialised ModelProto."""
    out = Model()
    for number, value in _fields(data):
        if number == 1:
            got = dict(_fields(value))
            out.pieces.append((got.get(1, b"").decode("utf-8"), struct.unpack("<f", got[2])[0] if 2 in got else 0.0, got.get(3, NORMAL)))
        elif number == 2:
            spec = dict(_fields(value))
            out.kind, out.byte_fallback, out.suffix = spec.get(3, UNIGRAM), bool(spec.get(35, 0)), bool(spec.get(24, 0))
        elif number == 3:
            spec = dict(_fields(value))
            out.charsmap, out.dummy_prefix, out.remove_extra, out.escape = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
    if out.kind not in (UNIGRAM, BPE) or not out.escape or out.suffix:
        raise ValueError("only unigram and BPE models with a space marker before words are supported")
    return out


def _merges(model: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, best score first.

    SentencePiece merges the leftmost of pairs with equal scores; here pairs have a
    rank of their own. Pairs of equal halves first, short ones before long ones, then
    those with the longest left part come to the same for runs of one character,
    which is where pieces of equal score meet (runs of spaces).
    """
    usable = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER, UNUSED)}
    found = []
    for piece, i in usable.items():
        for at in range(1, len(piece)):
            left, right = piece[:at], piece[at:]
            if left in usable and right in usable:
                halves = left == right
                found.append((-model.pieces[i][1], not halves, at if halves else -at, usable[left], usable[right], left, right))
    return [(a, b) for *_, a, b in sorted(found)]


@lru_cache(maxsize=2)
def build(data: bytes):
    """A tokenizers pipeline that encodes and decodes as the model file does; built once in a worker."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    model = parse(data)
    vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    unknown = next((i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), None)
    if model.kind == BPE:
        core = models.BPE(vocab, _merges(model), unk_token=model.pieces[unknown][0] if unknown is not None else None, fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unknown, model.byte_fallback)
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    # No piece goes on behind a marker that follows other characters, so words can be encoded one by one.
    if model.kind == BPE and not any(MARK in p.lstrip(MARK) for p in vocab):
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    parts = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    out.decoder = decoders.Sequence([*parts, *[decoders.Strip(" ", 1, 0)] * model.dummy_prefix])
    own = [AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER]
    if own:
        out.add_tokens(own)
    return out


@lru_cache(maxsize=2)
def _judge(data: bytes):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_proto=data)


class Encoder:
    """Ids of texts by the rebuilt pipeline, a batch at a time.

    Where no piece goes on behind a marker, words are encoded each by itself, once, and
    texts are put together from their words; a full store of words is emptied. Other
    models encode whole texts.
    """

    def __init__(self, data: bytes, kept: int = KEPT_WORDS):
        from tokenizers import Tokenizer

        self.data, self.model, self.whole, self.kept, self.words, self.wrong = data, parse(data), build(data), kept, {}, set()
        self.by_word = self.whole.pre_tokenizer is not None and not any(kind == USER for _, _, kind in self.model.pieces)
        self.core = Tokenizer(self.whole.model)
        self.plain = not self.model.charsmap and not self.model.remove_extra
        text = lambda p, kind: bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode()
        self.table = [text(p, kind) for p, _, kind in self.model.pieces]

    def _split(self, text: str) -> list[str]:
        if not text:
            return []
        flat = (MARK * self.model.dummy_prefix + text.replace(" ", MARK)) if self.plain else self.whole.normalizer.normalize_str(text)
        if MARK + MARK in flat or "\0" in flat:
            return _SEGMENT.findall(flat)
        return [w for w in flat.replace(MARK, "\0" + MARK).split("\0") if w]

    def encode(self, texts: list[str], verify: bool = False) -> tuple[list[np.ndarray], list[bool | None]]:
        """Ids of each text, and whether SentencePiece gives the same (None unless verified).

        Where words are encoded one by one, each distinct word is verified once and each
        text's normal form besides: no piece reaches over a word's border in either
        library, so a text's ids are those of its words.
        """
        if not self.by_word:
            got = [np.array(e.ids if t else [], "<u4") for e, t in zip(self.whole.encode_batch_fast(texts, add_special_tokens=False), texts)]
            return got, self._whole_texts(texts, got) if verify else [None] * len(texts)
        split = [self._split(t) for t in texts]
        if len(self.words) > self.kept:
            self.words.clear()
            self.wrong.clear()
        fresh = list(set().union(*split).difference(self.words))
        ids = [e.ids for e in self.core.encode_batch_fast(fresh, add_special_tokens=False)]
        for word, own in zip(fresh, ids):
            self.words[word] = np.array(own, "<u4").tobytes()
        got = [np.frombuffer(b"".join(map(self.words.__getitem__, ws)), "<u4") for ws in split]
        if not verify:
            return got, [None] * len(texts)
        if not (self.plain and self.model.dummy_prefix):
            return got, self._whole_texts(texts, got)
        judge = _judge(self.data)
        # The marker that begins a word is the one that SentencePiece puts before a text.
        theirs = judge.encode([w[1:].replace(MARK, " ") for w in fresh], num_threads=1)
        if MARK in fresh:  # SentencePiece puts no marker before an empty text, so this word is read off the end of another
            theirs[fresh.index(MARK)] = judge.encode("a ")[len(judge.encode("a")) :]
        self.wrong.update(w for w, a, b in zip(fresh, ids, theirs) if a != b)
        same = [judge.normalize(t) == (MARK + t.replace(" ", MARK) if t else "") for t in texts]
        if self.wrong:
            same = [ok and self.wrong.isdisjoint(ws) for ok, ws in zip(same, split)]
        return got, same

    def _whole_texts(self, texts: list[str], got: list[np.ndarray]) -> list[bool]:
        theirs = _judge(self.data).encode(texts, num_threads=1)
        return [a.tolist() == b for a, b in zip(got, theirs)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, put together from the pieces' bytes."""
        text = b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


@lru_cache(maxsize=2)
def encoder_of(data: bytes) -> Encoder:
    return Encoder(data)


OUT = "doc_id long, n_ids long, ids_crc32 long, round_trip boolean, parity boolean"


def encode(docs: DataFrame, data: bytes, id_col: str = "doc_id", text_col: str = "text", parity: bool = True, with_ids: bool = False) -> DataFrame:
    """``(doc_id, n_ids, ids_crc32, round_trip, parity)`` (and ``ids`` if asked for), one row per row.

    ``data``: the model file. ``round_trip``: decoding gives the text itself, or what
    SentencePiece's decoding gives (a normaliser may change texts). ``parity``: the ids
    equal SentencePiece's (null unless verified); the ids are the rebuilt pipeline's in
    any case. A null text counts as empty and has no ids; null ids and repeated rows
    stay; an empty table gives no rows; other columns are not read. Batches are encoded
    by the library's own threads, a bounded number of characters at a time; there is no
    exchange.
    """
    names = ["doc_id", "n_ids", "ids_crc32", "round_trip", "parity", *["ids"] * with_ids]

    def run(batches):
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        encoder, judge = encoder_of(data), _judge(data) if parity else None

        def rows(ids, texts):
            got, same = encoder.encode(texts, parity)
            trip = []
            for t, g in zip(texts, got):
                back = encoder.decode(g)
                trip.append(back == t or (judge is not None and back == judge.decode(g.tolist())))
            arrays = [pa.array(ids, pa.int64()), pa.array(list(map(len, got)), pa.int64()), pa.array([zlib.crc32(g.tobytes()) for g in got], pa.int64()), pa.array(trip, pa.bool_()), pa.array(same, pa.bool_())]
            return pa.RecordBatch.from_arrays([*arrays, *[pa.array([g.tolist() for g in got], pa.list_(pa.int64()))] * with_ids], names=names)

        for batch in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(i)
                texts.append(t.as_py() or "")
                size += len(texts[-1])
                if size >= SLICE:
                    yield rows(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield rows(ids, texts)

    mine = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return mine.mapInArrow(run, OUT + (", ids array<long>" if with_ids else ""))


def decode(rows: DataFrame, data: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, text)`` from ids, one row per row; a null list gives a null text, nulls in a list are skipped."""

    def run(batches):
        tokenizer = build(data)
        for batch in batches:
            ids = batch.column(1).to_pylist()
            texts = iter(tokenizer.decode_batch([[i for i in x if i is not None] for x in ids if x is not None], skip_special_tokens=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else next(texts) for x in ids], pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<long>").alias("ids")).mapInArrow(run, "doc_id long, text string")
