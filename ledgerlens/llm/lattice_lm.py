"""Language-model scores over a subword lattice, and an add-one word model beside them.

The vocabulary is that of an existing tokenizer. Its scores order its pieces; the first weights fall as one over the
rank, and ROUNDS rounds of expected counts over the corpus's words re-estimate them. A word's probability is the sum over all its segmentations,
by a forward recursion in scaled log space; a text's is the product over its words and an end. Single characters fall back
to the vocabulary's byte pieces, so every text has a probability, and the weights of pieces and end sum to one.

Documents are read once. Each batch keeps its texts as numbers of its own distinct words, and posts those words, once
each with their training counts, to buckets by hash. Buckets add up counts over all batches, learn expected counts of
pieces (summed by a tree, a vector of its size at a time, about sqrt(buckets) of which reach the driver) and answer with each word's count and log probability.

Defined cases: null text is empty and scores its end token; a null id is never held out; words of any length are
scaled, never underflow; repeated rows count as documents each; ties don't arise, each row has a score of its own; other columns
are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, checkpoint, packed, partitions, text_buffers, text_bytes, unpacked

END = b"\n"
END_PIECE = "\n"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BATCH_BYTES = 8 << 20
BUCKET_BYTES = 8 << 20
ROUNDS = 2
N_ROW, V_ROW = -2, -1
TINY, SCALE = 1e-120, 1e120


class Lattice:
    """Weights of pieces, bytes and the end; `get` also holds proper prefixes, at weight nought."""

    def __init__(self, path: str, weights: dict[int, float] | None = None):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [(own.get_score(i), own.id_to_piece(i), own.is_byte(i)) for i in range(own.get_piece_size()) if not own.is_control(i) and not own.is_unknown(i) and not own.is_unused(i)]
        self.bytes = {int(p[3:5], 16): p for _, p, b in pieces if b}
        words = [p for _, p, b in sorted(pieces, key=lambda x: (-x[0], x[1])) if not b and p == _lowered(p)]
        self.names = [END_PIECE, *(self.bytes[k] for k in sorted(self.bytes)), *words]
        self.number = {p: i for i, p in enumerate(self.names)}
        if weights is None:
            first = [1.0] + [1e-3] * len(self.bytes) + [1 / (50 + r) for r in range(len(words))]
        else:
            first = [weights.get(i, 0.0) + 0.01 for i in range(len(self.names))]
        total = math.fsum(first)
        self.p = [x / total for x in first]
        self.byte_p = {k: self.p[self.number[p]] for k, p in self.bytes.items()}
        self.get_map: dict[str, float] = {}
        for p in words:
            for n in range(1, len(p)):
                self.get_map.setdefault(p[:n], 0.0)
            self.get_map[p] = self.p[self.number[p]]
        self.end_log = math.log10(self.p[0])
        self.longest = max(map(len, words), default=1)

    def arcs(self, s: str) -> list[list[tuple[int, float]]]:
        """From each place of s, the ends and weights of the pieces there; single characters always have one."""
        get, n, out = self.get_map.get, len(s), []
        for i in range(n):
            here, j = [], i + 1
            p = get(s[i:j])
            if not p:
                q = 1.0
                for b in s[i].encode("utf-8", "surrogatepass"):
                    q *= self.byte_p[b]
                here.append((j, q))
            else:
                here.append((j, p))
            while p is not None and j < n:
                j += 1
                p = get(s[i:j])
                if p:
                    here.append((j, p))
            out.append(here)
        return out

    def log10(self, word: bytes) -> float:
        if word == END:
            return self.end_log
        s = "▁" + word.decode("utf-8", "replace")
        get, n, byte_p = self.get_map.get, len(s), self.byte_p
        a, scaled = [1.0] + [0.0] * n, 0
        for i in range(n):
            x = a[i]
            if x < TINY:
                scaled += 1
                x *= SCALE
                for k in range(i, min(n, i + self.longest) + 1):
                    a[k] *= SCALE
            j = i + 1
            p = get(s[i:j])
            if p:
                a[j] += x * p
            else:
                q = x
                for b in s[i].encode("utf-8", "surrogatepass"):
                    q *= byte_p[b]
                a[j] += q
            while p is not None and j < n:
                j += 1
                p = get(s[i:j])
                if p:
                    a[j] += x * p
        return math.log10(a[n]) - 120 * scaled

    def expect(self, word: bytes, count: float, into: np.ndarray) -> None:
        """Adds the expected uses of each piece, over all segmentations weighted by their probability."""
        if word == END:
            into[0] += count
            return
        s = "▁" + word.decode("utf-8", "replace")
        arcs, n = self.arcs(s), len(s)
        ahead, shift = [0.0] * n + [1.0], [0] * (n + 1)
        for i in range(n - 1, -1, -1):
            shift[i] = shift[i + 1]
            x = math.fsum(p * ahead[j] * (SCALE ** (shift[i] - shift[j]) if shift[j] != shift[i] else 1.0) for j, p in arcs[i])
            if x < TINY:
                x, shift[i] = x * SCALE, shift[i] + 1
            ahead[i] = x
        # walk forward by the share of each arc among those from its place
        mass = [count] + [0.0] * n
        number, names_of_bytes = self.number, self.bytes
        for i in range(n):
            if (m := mass[i]) == 0.0:
                continue
            for j, p in arcs[i]:
                share = m * p * ahead[j] * (SCALE ** (shift[i] - shift[j]) if shift[j] != shift[i] else 1.0) / ahead[i]
                if share > 0.0:
                    mass[j] += share
                    k = number.get(s[i:j])
                    if k is not None:
                        into[k] += share
                    else:
                        for b in s[i].encode("utf-8", "surrogatepass"):
                            into[number[names_of_bytes[b]]] += share


def _lowered(p: str) -> str:
    return p.encode().translate(LOWER).decode()


@functools.cache
def first_lattice(path: str) -> Lattice:
    return Lattice(path)


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def _number(batches, buckets: int, batch_bytes: int):
    """Kind 0: a batch's documents as numbers of its words; kind 1: its words of one bucket and their training counts."""
    from pyspark import TaskContext

    part, serial = TaskContext.get().partitionId(), 0
    index: dict[bytes, int] = defaultdict()
    index.default_factory = index.__len__
    ids, places, size = [], [], 0

    def flush():
        words = list(index)
        n = np.array([len(p) for p in places], np.uint32)
        number = np.concatenate([*places, np.empty(0, np.uint32)])
        train = np.repeat([not held_out(i) for i in ids], n).astype(bool)
        count = np.bincount(number[train], minlength=len(words))
        bucket = np.array([zlib.crc32(w) % buckets for w in words], np.int64)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        key = (part << 32) + serial
        compress = zstandard.ZstdCompressor(level=1).compress
        rows = [(0, key, -1, packed(rank[number]), packed(n), packed(np.array([LAST_ID if i is None else i for i in ids], np.int64)))]
        edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-2))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            at = order[a:b]
            rows.append((1, key, int(bucket[at[0]]), compress(b" ".join([words[k] for k in at.tolist()])), packed(count[at]), b""))
        cols = list(zip(*rows, strict=True))
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["kind", "batch", "bucket", "a", "b", "c"])

    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        data = data.tobytes()
        for i, a, b in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            words = data[a:b].translate(LOWER).split()
            words.append(END)
            ids.append(i)
            places.append(np.fromiter(map(index.__getitem__, words), np.uint32, len(words)))
            size += b - a + 64
            if size >= batch_bytes:
                yield flush()
                serial, size = serial + 1, 0
                ids.clear(), places.clear(), index.clear()
    if ids:
        yield flush()


def _bucket_words(posts: pa.Table) -> tuple[list[list[bytes]], dict[bytes, int]]:
    open_ = zstandard.ZstdDecompressor().decompress
    lists, total = [], defaultdict(int)
    for words, counts in zip(posts.column("a").to_pylist(), posts.column("b").to_pylist(), strict=True):
        lists.append(open_(words).split(b" "))
        for w, c in zip(lists[-1], unpacked(counts, np.int64).tolist(), strict=True):
            total[w] += c
    return lists, total


def _learn(posts: pa.Table, path: str, weights: dict[int, float] | None, fan: int) -> pa.Table:
    """One row: expected uses of all pieces over the bucket's words, then N and V."""
    _, total = _bucket_words(posts)
    lattice = Lattice(path, weights) if weights else first_lattice(path)
    uses = np.zeros(len(lattice.names) + 2)
    for w, c in total.items():
        if c:
            lattice.expect(w, c, uses)
            uses[N_ROW] += c
            uses[V_ROW] += 1
    return _uses_row(posts.column("bucket")[0].as_py() % fan, uses)


def _uses_row(part: int, uses: np.ndarray) -> pa.Table:
    return pa.table({"part": pa.array([part], pa.int64()), "uses": pa.array([packed(uses)], pa.binary())})


def _added(rows: pa.Table) -> pa.Table:
    return _uses_row(rows.column("part")[0].as_py(), np.sum([unpacked(x, np.float64) for x in rows.column("uses").to_pylist()], axis=0))


def learnt_uses(posts: DataFrame, path: str, weights: dict[int, float] | None, buckets: int) -> np.ndarray:
    """Sums by a tree: a row of the vocabulary's size for each bucket, then for each part of about sqrt(buckets)."""
    fan = math.isqrt(buckets) + 1
    rows = posts.groupBy("bucket").applyInArrow(lambda t: _learn(t, path, weights, fan), "part long, uses binary")
    rows = rows.groupBy("part").applyInArrow(lambda t: _added(t), "part long, uses binary").collect()
    return np.sum([unpacked(bytes(r["uses"]), np.float64) for r in sorted(rows, key=lambda r: r["part"])] or [np.zeros(2)], axis=0)


def _answer(posts: pa.Table, path: str, weights: dict[int, float]) -> pa.Table:
    lists, total = _bucket_words(posts)
    lattice = Lattice(path, weights)
    log = {w: lattice.log10(w) for w in total}
    counts = [packed(np.array([total[w] for w in ws], np.int64)) for ws in lists]
    logs = [packed(np.array([log[w] for w in ws], np.float64)) for ws in lists]
    return pa.table({"batch": posts.column("batch"), "bucket": posts.column("bucket"), "a": pa.array(counts, pa.binary()), "b": pa.array(logs, pa.binary())})


def _score(kept: pa.Table, answers: pa.Table, total: int, words: int, id_col: str) -> pa.Table:
    answers = answers.sort_by("bucket")
    count = np.concatenate([unpacked(x, np.int64) for x in answers.column("a").to_pylist()])
    log = np.concatenate([unpacked(x, np.float64) for x in answers.column("b").to_pylist()])
    number, n, ids = unpacked(kept.column("a")[0].as_py(), np.uint32), unpacked(kept.column("b")[0].as_py(), np.uint32), unpacked(kept.column("c")[0].as_py(), np.int64)
    first = np.cumsum(n, dtype=np.int64) - n
    c = count[number]
    base = np.add.reduceat(np.log10(c + 1.0), first) - n * math.log10(total + words + 1)
    owned = [None if i == LAST_ID else i for i in ids.tolist()]
    return pa.table({
        id_col: pa.array(owned, pa.int64()), "held_out": pa.array([held_out(i) for i in owned], pa.bool_()), "n_tokens": pa.array(n.astype(np.int64)), "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), first)),
        "train_tokens": pa.array(np.full(len(n), total, np.int64)), "base_score": pa.array(base), "score": pa.array(np.add.reduceat(log[number], first)),
    })


def lattice_scores(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES, rounds: int = ROUNDS) -> DataFrame:
    """Id, held_out, n_tokens, n_known, train_tokens, base_score (add-one words) and score (the lattice's), in log10."""
    # a bucket gathers what all batches hold of about so many bytes of text
    buckets = max(2 * partitions(docs.sparkSession), math.ceil(text_bytes(docs, text_col) / BUCKET_BYTES))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    read = checkpoint(rows.mapInArrow(lambda it: _number(it, buckets, batch_bytes), "kind int, batch long, bucket long, a binary, b binary, c binary"))
    posts = read.where("kind = 1").select("batch", "bucket", "a", "b")
    weights, total, words = None, 0, 0
    for _ in range(rounds):
        uses = learnt_uses(posts, vocabulary, weights, buckets)
        total, words = round(uses[N_ROW]), round(uses[V_ROW])
        weights = {int(k): float(uses[k]) for k in np.flatnonzero(uses[:-2])}
    answers = posts.groupBy("bucket").applyInArrow(lambda t: _answer(t, vocabulary, weights), "batch long, bucket long, a binary, b binary")
    kept = read.where("kind = 0").select("batch", "a", "b", "c")
    out = f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return kept.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(lambda a, b: _score(a, b, total, words, id_col), out)
