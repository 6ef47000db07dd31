"""Bounded-space online packing of tokenised documents into sequences.

Each partition keeps `windows` open windows. A document is cut into whole sequences first; its rest goes to the window
that it fits best. When it fits none, the fullest window is emitted: if its gap is `least` tokens or more, the head of
the document fills it, otherwise the gap is padded (under 1 % of a sequence). Windows left at the end travel with
their ids to a merge over a few partitions each, are laid end to end and cut into whole sequences; what then remains is cut
into powers of two, which need no padding. So no task gathers more than a fixed number of windows.

Defined cases: null text is empty, and an empty document is its end token alone; a text of any length is cut; rows of
equal id are packed each on its own; windows that fit equally well are taken in the order they were opened; other columns
are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import in_batches
from .common import CACHES, checkpoint

CACHE_ITEMS = 700_000
MERGED = 16
PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Words to a call of the tokenizer.
TOGETHER = 512
_ODD = re.compile("[\x1c-\x1f]")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


class WordTokenizer:
    """A tokenizer whose pieces never cross whitespace, with a cache of words.

    New words are encoded many to a call, joined by blanks, and their ids told apart afterwards: by the ends that the
    vocabulary marks, as far as the number of marked ends in a word is known beforehand, otherwise by offsets.
    """

    def __init__(self, path: str, end: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own, self.words = Tokenizer.from_file(path), {}
        self.end = np.uint32(end).tobytes()
        vocabulary = self.own.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[k for w, k in vocabulary.items() if w.endswith("</w>")]] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.own.encode_batch(texts, add_special_tokens=False)]

    def _by_ends(self, words: list[str], ends: list[int]) -> list[bytes]:
        ids = np.array(self.own.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        at, last = np.flatnonzero(self.is_end[ids]), np.cumsum(ends)
        if len(at) != last[-1] or at[-1] != len(ids) - 1:
            return self._by_offsets(words)
        return _cut(ids, [0, *(at[last - 1] + 1).tolist()])

    def _by_offsets(self, words: list[str]) -> list[bytes]:
        e = self.own.encode_batch([" ".join(words)], add_special_tokens=False)[0]
        ids = np.array(e.ids, np.uint32)
        begins = np.fromiter((a for a, _ in e.offsets), np.int64, len(ids))
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        return _cut(ids, [*np.searchsorted(begins, np.cumsum(size) - size).tolist(), len(ids)])

    def _learn(self, words: list[str]) -> None:
        known, other, ends = [], [], []
        for w in words:
            n = marked_ends(w)
            if n:
                known.append(w)
                ends.append(n)
            else:
                other.append(w)
        for k in range(0, len(known), TOGETHER):
            self.words.update(zip(known[k : k + TOGETHER], self._by_ends(known[k : k + TOGETHER], ends[k : k + TOGETHER]), strict=True))
        for k in range(0, len(other), TOGETHER):
            self.words.update(zip(other[k : k + TOGETHER], self._by_offsets(other[k : k + TOGETHER]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids with the end token, as little-endian 32-bit integers."""
        odd = _ODD.search("\n".join(texts)) is not None
        split = [None if odd and _ODD.search(t) else t.split() for t in texts]
        if len(self.words) > CACHE_ITEMS:
            self.words.clear()
        self._learn(list(set().union(*(s for s in split if s)) - self.words.keys()))
        get = self.words.__getitem__
        return [(self._ids([t])[0] if s is None else b"".join(map(get, s))) + self.end for t, s in zip(texts, split, strict=True)]


def _cut(ids: np.ndarray, edges: list[int]) -> list[bytes]:
    raw = ids.tobytes()
    return [raw[4 * a : 4 * b] for a, b in itertools.pairwise(edges)]


def marked_ends(word: str) -> int:
    """How many pieces of a word end it or a part of it; 0 where only the tokenizer can tell."""
    if word.isascii():
        return 0 if "<|" in word else 1 if word.isalpha() else len(_PARTS.findall(word.lower()))
    return int(max(word) < "\u0600" and unicodedata.normalize("NFC", word).lower().isalpha())


@functools.cache
def tokenizer(path: str, end: int) -> WordTokenizer:
    return WordTokenizer(path, end)


CACHES.append(tokenizer.cache_clear)


class Packer:
    """Windows hold pieces (id, start, ids, tokens of the document)."""

    def __init__(self, size: int, windows: int, least: int, first_id: int):
        self.size, self.windows, self.least, self.next = size, windows, least, first_id
        self.open: list[list] = []  # [used, pieces]
        self.rows: list[tuple] = []

    def emit(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next, at))
            at += n
        self.next += 1

    def add(self, doc, ids: bytes) -> None:
        total, start = len(ids) // 4, 0
        while total - start >= self.size:
            self.emit([(doc, start, ids[4 * start : 4 * (start + self.size)], total)])
            start += self.size
        while start < total:
            need = total - start
            best = max((w for w in self.open if w[0] + need <= self.size), key=lambda w: w[0], default=None)
            if best is None and len(self.open) < self.windows:
                best = [0, []]
                self.open.append(best)
            if best is None:
                full = max(self.open, key=lambda w: w[0])
                gap = self.size - full[0]
                if gap >= self.least:
                    full[1].append((doc, start, ids[4 * start : 4 * (start + gap)], total))
                    start += gap
                self.open.remove(full)
                self.emit(full[1])
                continue
            best[1].append((doc, start, ids[4 * start :], total))
            best[0] += need
            start = total
            if best[0] == self.size:
                self.open.remove(best)
                self.emit(best[1])

    def merge(self, pieces: list) -> None:
        """Lays pieces end to end: whole sequences, then powers of two."""
        left = sum(len(ids) // 4 for _, _, ids, _ in pieces)
        room, now = 0, []
        for doc, start, ids, total in pieces:
            while ids:
                if not room:
                    room = self.size if left >= self.size else 1 << (left.bit_length() - 1)
                n = min(room, len(ids) // 4)
                now.append((doc, start, ids[: 4 * n], total))
                ids, start, room, left = ids[4 * n :], start + n, room - n, left - n
                if not room:
                    self.emit(now)
                    now = []


def pack(docs: DataFrame, vocabulary: str, end: int = 1, size: int = 2048, windows: int = 32, least: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    kind = docs.schema[id_col].dataType.simpleString()
    arrow = docs.select(id_col).schema
    columns = [f"`{id_col}` {kind}"]

    def table(rows, ids, groups, id_type) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        arrays = [pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:])]
        if ids is not None:
            arrays, names = [*arrays, pa.array(ids, pa.binary()), pa.array(groups, pa.int64())], [*names, "__ids", "__group"]
        return pa.RecordBatch.from_arrays(arrays, names)

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        own, packer, id_type = tokenizer(vocabulary, end), Packer(size, windows, least, part << 32), None
        for batch in batches:
            id_type, docs_of = batch.schema.field(0).type, iter(batch.column(0).to_pylist())
            for texts in in_batches(batch.column(1)):
                for ids in own.encode(texts):
                    packer.add(next(docs_of), ids)
            rows, packer.rows = packer.rows, []
            yield table(rows, [None] * len(rows), [None] * len(rows), id_type)
        left = [(w, p) for w, (_, pieces) in enumerate(packer.open) for p in pieces]
        if left:
            rows = [(doc, start, len(ids) // 4, 0, total, (part << 32) + w, k) for k, (w, (doc, start, ids, total)) in enumerate(left)]
            yield table(rows, [p[2] for _, p in left], [part // MERGED] * len(rows), id_type)

    placed = checkpoint(docs.select(id_col, text_col).mapInArrow(run, ", ".join([*columns, PIECE, "__ids binary", "__group long"])))

    def merge(left: pa.Table) -> pa.Table:
        left = left.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        packer = Packer(size, windows, least, ((1 << 30) + left.column("__group")[0].as_py()) << 32)
        packer.merge(list(zip(*(left.column(c).to_pylist() for c in (id_col, "start", "__ids", "doc_tokens")), strict=True)))
        return pa.Table.from_batches([table(packer.rows, None, None, left.schema.field(id_col).type)])

    whole = placed.where("__ids IS NULL").drop("__ids", "__group")
    rest = placed.where("__ids IS NOT NULL").groupBy("__group").applyInArrow(lambda t: merge(t), T.StructType([arrow[0], *T.StructType.fromDDL(PIECE)]))
    return whole.union(rest.select(*whole.columns))
