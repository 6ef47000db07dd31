"""Exact removal of repeated byte strings, by a depth-limited radix sort of suffixes.

Suffixes are ordered only through the first `threshold` bytes, and only as far as needed: most-significant-digit
passes split all suffixes into ever smaller groups, groups that lie in one document go, and those equal through all
digits are exactly the repeated windows. The digits of a suffix are

1. the least hash among the half-window strings in its first `threshold` bytes. Neighbouring suffixes share it, so a
   stretch of them (a run) is posted once, about 7 runs for 100 bytes;
2. the hash of all the bytes that a run's windows cover, with which whole runs are equal at once;
3. the hash of the single window, only where runs share digit 1 but not digit 2: the ends of repeated passages.

Documents are dealt into batches of some megabytes by their id, and digits into buckets of about twice as much text. In each pass a batch posts what it holds once, with
its smallest document, to the bucket of the digit's leading bits; a bucket answers in the order posted. So a passage
that stands in a third of all documents is a row for each batch, not for each copy, and nothing is broadcast. What a
batch has learnt goes with its posts and comes back with the answers, as places in its documents' order of id and text: so
no pass is asked twice, and after the second only bytes of runs that matter are hashed. Digits 2
and 3, which decide, are 128 bits of two independent hashes, so that unequal windows don't meet in a corpus of any size;
digit 1 is cut to 48 bits, which can only make later passes look at more.

Defined cases: null text is empty; texts under `threshold` bytes stay; a null id stands after all others; rows of
equal id don't cover each other, so repeated rows all stay; input columns, whatever their names, are kept when `keep_text` asks
for documents, but give way to a result of the same name; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import byte_windows as bw
from .common import LAST_ID, packed, packed_sorted, partitions, positional, starts_of, text_buffers, text_bytes, unpacked, unpacked_sorted

#: Rows between batches and buckets are batches times buckets, and each costs a call of the compressor on either side:
#: so both are as large as a task's memory allows.
BATCH_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20
DIGIT_SHIFT = np.uint64(16)
POSTS = "__bucket long, __batch long, __kind int, a binary, b binary, c binary"
ANSWERS = "__batch long, __bucket long, __kind int, a binary"


def in_order(docs: pa.Table) -> pa.Table:
    """Rows come in any order from a shuffle; places of bytes hold from pass to pass in this one. Rows that tie have one text."""
    return docs.sort_by([("__id", "ascending"), ("__text", "ascending")])


def expanded(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Every place in stretches that begin there and are so long."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())


def stretches(begin: np.ndarray, end: np.ndarray, apart: np.ndarray | tuple = ()) -> tuple[np.ndarray, np.ndarray]:
    """Where the union of intervals begins and ends; those that begin at places `apart` are not joined to what touches them."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    if not len(begin):
        return begin, end
    new = np.ones(len(begin), bool)
    new[1:] = (begin[1:] > end[:-1]) | np.isin(begin[1:], apart)
    first = np.flatnonzero(new)
    return begin[first], end[np.append(first[1:], len(begin)) - 1]


class Covered:
    """The bytes that the windows of some runs cover, put together: late passes hash these alone."""

    def __init__(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, threshold: int):
        self.t = threshold
        self.begin, end = stretches(start, start + length - 1 + threshold)
        size = end - self.begin
        self.place = np.cumsum(size) - size
        edge = np.zeros(len(data) + 1, np.int8)  # stretches don't touch; places as indices would be many times the text
        edge[self.begin], edge[end] = 1, -1
        self.data = data[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]

    def places(self, at: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.begin, at, "right") - 1
        return at - self.begin[k] + self.place[k]

    def halves(self, family: int) -> np.ndarray:
        return bw.half_hashes(self.data, self.t, family)


def parts(sorted_values: np.ndarray, bits: int, buckets: int) -> list[tuple[int, slice]]:
    """The values of each bucket that has any: by the leading 32 bits."""
    bounds = -(-(np.arange(1, buckets, dtype=object) << bits) // buckets)
    edges = np.concatenate([[0], np.searchsorted(sorted_values, np.array(bounds, dtype=np.uint64)), [len(sorted_values)]]).astype(np.int64)
    return [(b, slice(edges[b], edges[b + 1])) for b in np.flatnonzero(np.diff(edges))]


class Batch:
    """The documents of a batch and their runs, for the first two passes."""

    def __init__(self, docs: pa.Table, threshold: int, buckets: int):
        self.t, self.buckets = threshold, buckets
        self.data, self.offsets = text_buffers(docs.column("__text"))
        self.ids = docs.column("__id").to_numpy()
        halves, digits = bw.half_hashes_and_digits(self.data, threshold)
        self.halves = halves
        n = len(digits)
        cut = np.zeros(n + 1, bool)
        if n:
            np.not_equal(digits[1:], digits[:-1], out=cut[1:n])
            cut[self.offsets[self.offsets < n]] = True
            last = self.offsets[1:] - threshold + 1
            last = last[(last > self.offsets[:-1]) & (last < n)]
            cut[last] = True
            cut[n] = True
        edges = np.flatnonzero(cut)
        start, length = edges[:-1], np.diff(edges)
        row = np.searchsorted(self.offsets, start, "right") - 1
        whole = start + threshold <= self.offsets[row + 1]
        self.start, self.length, self.row = start[whole], length[whole], row[whole]
        self.doc = self.ids[self.row]
        self.digit = digits[self.start] >> DIGIT_SHIFT

    # Pass 1: which digits lie in more than one document.
    def first(self):
        order = np.lexsort((self.doc, self.digit))
        value, doc = self.digit[order], self.doc[order]
        at = starts_of(value)
        several = np.minimum.reduceat(doc, at) < np.maximum.reduceat(doc, at) if len(at) else np.empty(0, bool)
        return order, at, value[at], several

    def post_first(self):
        _, _, value, several = self.first()
        for b, part in parts(value, 48, self.buckets):
            yield b, 1, packed_sorted(value[part]), np.packbits(several[part]).tobytes(), b""

    def keep_shared(self, answers: dict):
        """Only runs whose digit is shared go on."""
        order, at, value, _ = self.first()
        shared = np.zeros(len(value), bool)
        for b, part in parts(value, 48, self.buckets):
            if (1, b) in answers:
                shared[part] = np.unpackbits(np.frombuffer(answers[1, b], np.uint8), count=part.stop - part.start).astype(bool)
        keep = np.zeros(len(self.digit), bool)
        keep[order] = np.repeat(shared, np.diff(np.append(at, len(order))))
        for k in ("start", "length", "row", "doc", "digit"):
            setattr(self, k, getattr(self, k)[keep])
        ends = self.start + self.length - 1
        if not len(ends):
            self.span = np.empty((0, 2), np.uint64)
            return
        one = self.span_hashes(self.halves, self.start, ends)
        del self.halves  # as large as those of the other family
        own = Covered(self.data, self.start, self.length, self.t)
        self.span = np.stack([one, self.span_hashes(own.halves(1), own.places(self.start), own.places(ends))], axis=1)
        # a run of up to `half + 1` windows is no longer than two windows: their hashes are those of all its bytes

    def span_hashes(self, halves: np.ndarray, start: np.ndarray, ends: np.ndarray) -> np.ndarray:
        span = bw.window_hashes(halves, start, self.t) * np.uint64(0x9FB21C651E98DF25) + bw.window_hashes(halves, ends, self.t)
        return bw.mixed(span + self.length.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))

    # Pass 2: which runs are equal through their last byte, and where runs part.
    def post_second(self):
        order = np.lexsort((self.doc, self.span[:, 1], self.span[:, 0], self.digit))
        digit, span, doc = self.digit[order], self.span[order], self.doc[order]
        at = starts_of(digit, span[:, 0], span[:, 1])
        new = np.zeros(len(order), np.int64)
        new[at] = 1
        digit, span, doc = digit[at], span[at], doc[at]
        for b, part in parts(digit, 48, self.buckets):
            yield b, 2, packed_sorted(digit[part]), packed(span[part]), packed(doc[part])
        yield -1, 0, packed(np.concatenate([self.start[order], self.length[order], new])), b"", b""


class Late:
    """The documents of a batch, for the passes that know which runs matter: these come with the answers."""

    def __init__(self, docs: pa.Table, threshold: int, buckets: int):
        self.t, self.buckets = threshold, buckets
        self.data, self.offsets = text_buffers(docs.column("__text"))
        self.ids = docs.column("__id").to_numpy()

    def doc_of(self, start: np.ndarray) -> np.ndarray:
        return self.ids[np.searchsorted(self.offsets, start, "right") - 1]

    def read_second(self, answers: dict):
        """Runs to be covered whole, as intervals, and the first of each of those that go on as single windows.

        The code of a run is 2 if an earlier document has it, 1 if nobody earlier has but runs of its digit differ.
        """
        start, length, new = unpacked(answers.get((0, -1), b""), np.int64).reshape(3, -1)
        doc, at = self.doc_of(start), np.flatnonzero(new)
        code = np.concatenate([np.empty(0, np.uint8), *(unpacked(answers[k], np.uint8) for k in sorted(answers) if k[0] == 2)])
        size = np.diff(np.append(at, len(start)))
        code, least = np.repeat(code, size), np.repeat(doc[at], size)
        run, take = (code == 2) | (doc > least), (code == 1) & (doc == least)
        self.begin, self.end = stretches(start[run], start[run] + length[run] - 1 + self.t, self.offsets)
        self.start, self.length = start[take], length[take]

    def read_third(self, answers: dict):
        state = unpacked(answers.get((0, -1), b""), np.int64)
        n = int(state[0]) if len(state) else 0
        (self.begin, self.end), (self.start, self.length) = state[1 : 1 + 2 * n].reshape(2, -1), state[1 + 2 * n :].reshape(2, -1)

    # Pass 3: single windows, of the first document with each run, where runs part.
    def third(self):
        at = expanded(self.start, self.length)
        if not len(at):
            return at, np.empty(0, np.uint64), np.empty(0, np.uint64), self.ids[:0]
        own = Covered(self.data, self.start, self.length, self.t)
        place = expanded(own.places(self.start), self.length)
        return at, *(bw.window_hashes(own.halves(k), place, self.t) for k in (0, 1)), np.repeat(self.doc_of(self.start), self.length)

    def posted_third(self):
        at, value, other, doc = self.third()
        order = np.lexsort((doc, other, value))
        value, other, doc = value[order], other[order], doc[order]
        new = starts_of(value, other)
        return at, order, new, value[new], other[new], doc[new], doc

    def post_third(self):
        _, _, _, value, other, doc, _ = self.posted_third()
        for b, part in parts(value, 64, self.buckets):
            yield b, 3, packed_sorted(value[part]), packed(doc[part]), packed(other[part])
        yield -1, 0, packed(np.concatenate([[len(self.begin)], self.begin, self.end, self.start, self.length])), b"", b""

    def covered(self, answers: dict) -> tuple[np.ndarray, np.ndarray]:
        """Where covered stretches begin and end; none goes over the end of a document."""
        at, order, new, value, _, least, doc = self.posted_third()
        earlier = np.zeros(len(value), bool)
        for b, part in parts(value, 64, self.buckets):
            if (3, b) in answers:
                earlier[part] = np.unpackbits(np.frombuffer(answers[3, b], np.uint8), count=part.stop - part.start).astype(bool)
        size = np.diff(np.append(new, len(order)))
        single = at[order][np.repeat(earlier, size) | (doc > np.repeat(least, size))]
        return stretches(np.concatenate([self.begin, single]), np.concatenate([self.end, single + self.t]), self.offsets)


def _answers(table: pa.Table) -> dict:
    return {(k, b): a for k, b, a in zip(*(table.column(c).to_pylist() for c in ("__kind", "__bucket", "a")), strict=True)}


def _posts(batch_no: int, rows, buckets: int) -> pa.Table:
    """Kind 0 is for the batch itself: it takes the way of the answers, in a group of its own."""
    rows = [(buckets + batch_no if kind == 0 else b, kind, *rest) for b, kind, *rest in rows]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.table({"__bucket": pa.array(cols[0], pa.int64()), "__batch": pa.array([batch_no] * len(rows), pa.int64()), "__kind": pa.array(cols[1], pa.int32()), **{c: pa.array(cols[2 + i], pa.binary()) for i, c in enumerate("abc")}})


def _post_first(docs: pa.Table, threshold: int, buckets: int) -> pa.Table:
    return _posts(docs.column("__batch")[0].as_py(), Batch(docs, threshold, buckets).post_first(), buckets)


def _post_second(docs: pa.Table, answers: pa.Table, threshold: int, buckets: int) -> pa.Table:
    if not docs.num_rows:
        return _posts(0, [], buckets)
    batch = Batch(in_order(docs.select(["__id", "__text"])), threshold, buckets)
    batch.keep_shared(_answers(answers))
    return _posts(docs.column("__batch")[0].as_py(), batch.post_second(), buckets)


def _post_third(docs: pa.Table, answers: pa.Table, threshold: int, buckets: int) -> pa.Table:
    if not docs.num_rows:
        return _posts(0, [], buckets)
    batch = Late(in_order(docs.select(["__id", "__text"])), threshold, buckets)
    batch.read_second(_answers(answers))
    return _posts(docs.column("__batch")[0].as_py(), batch.post_third(), buckets)


def _answer(posts: pa.Table) -> pa.Table:
    """What a bucket has to say to each batch, in the order posted."""
    kind, bucket = posts.column("__kind")[0].as_py(), posts.column("__bucket")[0].as_py()
    if kind == 0:
        return pa.table({"__batch": posts.column("__batch"), "__bucket": pa.array([-1] * posts.num_rows, pa.int64()), "__kind": posts.column("__kind"), "a": posts.column("a")})
    a, b, c = (posts.column(k).to_pylist() for k in "abc")
    value = [unpacked_sorted(x) for x in a]
    size = np.array([len(v) for v in value])
    value = np.concatenate(value)
    if kind == 1:
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(b, size, strict=True)])
        order = np.argsort(value, kind="stable")
        at = starts_of(value[order])
        count = np.diff(np.append(at, len(order)))
        said = np.empty(len(order), np.uint8)
        said[order] = np.repeat((count > 1) | (np.maximum.reduceat(several[order], at) > 0), count)
    elif kind == 2:
        span = np.concatenate([unpacked(x, "V16").view(np.uint64).reshape(-1, 2) for x in b])
        doc = np.concatenate([unpacked(x, np.int64) for x in c])
        order = np.lexsort((doc, span[:, 1], span[:, 0], value))
        s = span[order]
        at, digit_at = starts_of(value[order], s[:, 0], s[:, 1]), starts_of(value[order])
        count, digit_count = np.diff(np.append(at, len(order))), np.diff(np.append(digit_at, len(order)))
        least = np.repeat(doc[order][at], count)
        new = np.zeros(len(order), np.int64)
        new[at] = 1
        runs = np.add.reduceat(new, digit_at)
        parts = np.repeat(runs > 1, digit_count)
        said = np.empty(len(order), np.uint8)
        said[order] = np.where(least < doc[order], 2, np.where(parts, 1, 0))
    else:
        doc, other = np.concatenate([unpacked(x, np.int64) for x in b]), np.concatenate([unpacked(x, np.uint64) for x in c])
        order = np.lexsort((doc, other, value))
        at = starts_of(value[order], other[order])
        said = np.empty(len(order), np.uint8)
        said[order] = np.repeat(doc[order][at], np.diff(np.append(at, len(order)))) < doc[order]
    said = np.split(said, np.cumsum(size)[:-1])
    said = [packed(x) if kind == 2 else np.packbits(x).tobytes() for x in said]
    n = len(said)
    return pa.table({"__batch": posts.column("__batch"), "__bucket": pa.array([bucket] * n, pa.int64()), "__kind": pa.array([kind] * n, pa.int32()), "a": pa.array(said, pa.binary())})


def _finish(docs: pa.Table, answers: pa.Table, threshold: int, buckets: int, keep_text: bool, schema: pa.Schema) -> pa.Table:
    if not docs.num_rows:
        return schema.empty_table()
    docs, said = in_order(docs), _answers(answers)
    batch = Late(docs, threshold, buckets)
    batch.read_third(said)
    begin, end = batch.covered(said)
    data, offsets = memoryview(batch.data), batch.offsets
    n, row = len(offsets) - 1, np.searchsorted(batch.offsets, begin, "right") - 1
    spans, removed = np.bincount(row, minlength=n), np.bincount(row, weights=end - begin, minlength=n).astype(np.int64)
    pieces = [data[i:j] for i, j in itertools.pairwise(offsets.tolist())]
    cuts = np.searchsorted(row, np.arange(n + 1))
    for r in np.flatnonzero(spans).tolist():
        own = slice(cuts[r], cuts[r + 1])
        pieces[r] = b"".join(data[i:j] for i, j in zip([int(offsets[r]), *end[own].tolist()], [*begin[own].tolist(), int(offsets[r + 1])], strict=True))
    out = {"n_bytes": np.diff(offsets), "n_removed": removed, "n_spans": spans}
    out = {k: pa.array(v, pa.int64()) for k, v in out.items()}
    out["kept_sha256"] = pa.array([hashlib.sha256(p).hexdigest() for p in pieces], pa.string())
    if keep_text:
        out["kept"] = pa.array([str(p, "utf-8", "ignore") for p in pieces], pa.string())
    own = {f.name: docs.column(f.name) for f in schema if f.name not in out}
    return pa.table([own[f.name] if f.name in own else out[f.name] for f in schema], schema=schema)


def dealt(total: int, least: int, batch_bytes: int = BATCH_BYTES) -> tuple[int, int]:
    """Into how many batches and buckets so many bytes of text go: at least one for each shuffle partition."""
    return max(least, math.ceil(total / batch_bytes), 1), max(least, math.ceil(total / max(batch_bytes, BUCKET_BYTES)), 1)


def dedup_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 50, keep_text: bool = False, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Removes each byte covered by a `threshold`-byte string that also starts in a document of smaller id.

    Returns the input's id column (all input columns with keep_text) with n_bytes, n_removed, n_spans and
    kept_sha256, and with keep_text the text that is left as `kept` (bytes of characters cut apart go).
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    n, buckets = dealt(text_bytes(docs, text_col), partitions(docs.sparkSession), batch_bytes)
    named = docs if keep_text else docs.select(id_col, text_col)
    own = [f"__own{i}" for i in range(len(named.columns))]
    id_at, text_at = named.columns.index(id_col), named.columns.index(text_col)
    base = named.toDF(*own)
    base = base.withColumn("__id", F.coalesce(F.col(own[id_at]).cast("long"), F.lit(LAST_ID))).withColumn("__text", F.col(own[text_at]))
    base = base.drop(own[text_at]).withColumn("__batch", F.pmod(F.xxhash64("__id"), F.lit(n)))
    args = {"threshold": threshold, "buckets": buckets}

    def answered(posts: DataFrame) -> DataFrame:
        return posts.groupBy("__bucket").applyInArrow(lambda t: _answer(t), ANSWERS)

    def with_docs(answers: DataFrame):
        return base.groupBy("__batch").cogroup(answers.groupBy("__batch"))

    one = answered(base.groupBy("__batch").applyInArrow(lambda t: _post_first(t, **args), POSTS))
    two = answered(with_docs(one).applyInArrow(lambda t, a: _post_second(t, a, **args), POSTS))
    three = answered(with_docs(two).applyInArrow(lambda t, a: _post_third(t, a, **args), POSTS))
    fields = [T.StructField(c, f.dataType) for c, f in zip(own, named.schema.fields, strict=True) if c != own[text_at]]
    fields += [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())]
    fields += [T.StructField("kept", T.StringType())] * keep_text
    out = T.StructType(fields)
    schema = to_arrow_schema(out)
    done = with_docs(three).applyInArrow(lambda t, a: _finish(t, a, keep_text=keep_text, schema=schema, **args), out)
    new = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text
    back = [F.col(c).alias(name) for c, name in zip(own, named.columns, strict=True) if c != own[text_at] and name not in new]
    return done.select(*back, *new)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 50) -> DataFrame:
    """The documents with what dedup_windows() leaves of their texts; other columns as they were."""
    base, own = positional(docs)
    left = dedup_windows(base, own[id_col], own[text_col], threshold, keep_text=True).withColumnRenamed("kept", own[text_col])
    return left.select(*(F.col(own[c]).alias(c) for c in docs.columns))
