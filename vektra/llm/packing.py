"""Harmonic packing: documents' tokens into training sequences, without an exchange.

Lengths fall into the reciprocal classes of the capacity: class k holds those over
1024/(k+1) and up to 1024/k, and a bin of class k takes exactly k pieces. As documents
may be cut, what such a bin lacks comes from the front of a later document, so full
bins have no padding at all. Every task fills its bins on its own. What remains at a
task's end makes sequences of a power of two, which need no padding either.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY = 1024
END_ID = 0
#: Characters whose pieces a task gives on at a time, if a single text is not longer.
SLICE = 4_000_000
#: Length of a run of one kind of character from which a text goes through the tokenizers library: the fast path gives
#: up on long ones, or takes a time that grows with the square.
LONG = 20_000
_RUN = re.compile(r"\s+|\w+|[^\s\w]+")

#: Fixed value: the pattern by which byte-level pre-tokenisers part a text.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 for itself, others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in printable)
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """A worker's encoder for a file, loaded once."""
    return Encoder(path)


class Encoder:
    """Token ids of whole texts by a file of the tokenizers library.

    Where the file is a plain byte-level BPE whose ids follow its merges, its own
    vocabulary is handed to the faster BPE of tiktoken, which gives the same ids.
    Texts that hold a special token, that the fast path refuses, and all texts of
    other files go through the tokenizers library itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = self._ranks(json.loads(self.tokenizer.to_str()))

    def _ranks(self, spec: dict):
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        byte_level = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        odd = model.get("dropout") or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("byte_fallback") or model.get("ignore_merges")
        if model["type"] != "BPE" or not byte_level or odd:
            return None
        merged = ["".join(m) if not isinstance(m, str) else m.replace(" ", "") for m in model["merges"]]
        ids = [model["vocab"].get(m, -1) for m in merged]
        if ids != sorted(set(ids)):
            return None
        import tiktoken

        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
        return tiktoken.Encoding("own", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None and not any(s in text for s in self.special):
            if len(text) < LONG or max(m.end() - m.start() for m in _RUN.finditer(text)) < LONG:
                return np.array(self.fast.encode_ordinary(text), "<u4")
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


def class_of(length: int, capacity: int = CAPACITY) -> int:
    """The reciprocal class k of a length: over ``capacity / (k + 1)``, and ``capacity / k`` at most."""
    return capacity // length


class Bins:
    """Fills sequences of one task. A piece is (doc_id, start, ids, tokens of its document).

    A bin of class k takes k pieces of that class. What it then lacks, less than a
    piece of its own class, is cut from the front of the next document that is
    long enough, so a closed sequence is full. Open bins of all classes together hold
    under ``classes * capacity`` ids, and there are about ``2 * sqrt(capacity)`` classes.
    """

    def __init__(self, capacity: int, first: int, with_ids: bool):
        self.capacity, self.sequence, self.with_ids = capacity, first, with_ids
        self.open: dict[int, list[tuple]] = {}
        self.short: list[tuple[int, list[tuple]]] = []  # (ids that lack, pieces) of bins with all their pieces
        self.out: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.sequence, offset, *([ids] if self.with_ids else ())))
            offset += len(ids)
        self.sequence += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while self.short and self.short[-1][0] <= total - at:
            lacks, pieces = self.short.pop()
            self.close([*pieces, (doc, at, ids[at : at + lacks], total)])
            at += lacks
        while total - at >= self.capacity:
            self.close([(doc, at, ids[at : at + self.capacity], total)])
            at += self.capacity
        if at == total:
            return
        k = class_of(total - at, self.capacity)
        pieces = self.open.setdefault(k, [])
        pieces.append((doc, at, ids[at:].copy(), total))
        if len(pieces) == k:
            del self.open[k]
            lacks = self.capacity - sum(len(p[2]) for p in pieces)
            if lacks:
                self.short.append((lacks, pieces))
            else:
                self.close(pieces)

    def finish(self) -> None:
        """What is open at the end, put in line and cut: full sequences, then powers of two."""
        line = [p for _, pieces in self.short for p in pieces] + [p for k in sorted(self.open) for p in self.open[k]]
        self.short, self.open = [], {}
        left, pieces, room = sum(len(p[2]) for p in line), [], 0
        for doc, start, ids, total in line:
            at = 0
            while at < len(ids):
                if not room:
                    room = min(self.capacity, 1 << (left.bit_length() - 1))
                take = min(room, len(ids) - at)
                pieces.append((doc, start + at, ids[at : at + take], total))
                at, room, left = at + take, room - take, left - take
                if not room:
                    self.close(pieces)
                    pieces = []


OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ``ids`` if asked for).

    ``tokenizer``: path of a file of the tokenizers library, there on every worker.
    ``capacity`` is a power of two. A null text counts as empty and gives the end id
    alone; null ids and repeated rows are packed like any other; an empty table gives
    no rows; other columns are not read. Every id lies in exactly one piece. Most
    documents stay whole: one is cut only where it is longer than ``capacity``, fills
    up a bin, or is left at the task's end. There every sequence has the length of a
    power of two, so no sequence is padded. A task holds one batch of texts and the
    open bins (see ``Bins``); a sequence never spans tasks, so a lost task is simply
    run again.
    """
    if capacity & (capacity - 1) or capacity < 1:
        raise ValueError("capacity must be a power of two")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]

    def run(batches):
        from pyspark import TaskContext

        encoder, end = encoder_of(tokenizer), np.array([end_id], "<u4")
        context = TaskContext.get()
        bins = Bins(capacity, (context.partitionId() if context else 0) << 40, with_ids)

        def batch():
            columns = list(zip(*bins.out))
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]] + [pa.array(c, pa.list_(pa.int64())) for c in columns[7:]]
            bins.out = []
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for got in batches:
            size = 0
            for doc, text in zip(got.column(0).to_pylist(), got.column(1)):
                text = text.as_py() or ""
                bins.add(doc, np.concatenate([encoder.encode(text), end]))
                size += len(text)
                if size >= SLICE and bins.out:
                    yield batch()
                    size = 0
            if bins.out:
                yield batch()
        bins.finish()
        if bins.out:
            yield batch()

    mine = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return mine.mapInArrow(run, OUT + (", ids array<long>" if with_ids else ""))


def padded(filled: Column, capacity: int = CAPACITY) -> Column:
    """Length of a sequence with padding: none at a power of two, else up to the capacity."""
    return F.when(F.bit_count(filled) == 1, filled).otherwise(F.lit(capacity))
