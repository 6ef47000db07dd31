"""Byte-level BPE: text to ids and back, by the ranks of an existing vocabulary.

Pre-tokenisation uses no regular expression. Every code point becomes one of eight classes (whitespace and
apostrophes look one and two characters ahead), a class is a transition function on the states of the splitting
automaton, and functions compose associatively. A composition of four is constant on all states that can occur, so
the prefix scan ends after two doublings: the state before a character follows from the four classes before it, and one
gather from a table of composed functions finds all boundaries of a batch at once. Slices between boundaries go to a
cache of merged pairs (lowest rank first, leftmost on ties). An encoded text keeps where its slices begin, in code points and
in ids, so that any stretch of it decodes by the slices that cover it, and the whole by all of them.

Defined cases: null and empty texts give no ids; texts of any length are merged in n log n; bytes that a vocabulary
lacks raise KeyError; rows are independent, so ties and repeated rows are not special; other columns are ignored, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import itertools
import unicodedata
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

L, N, O, A1, A2, SP_LAST, WS_LAST, MID = range(8)
SPACES = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: States: in a run of letters, numbers or others; after a blank that joins the next run; after other whitespace;
#: in a contraction with one or two letters to come; after a contraction.
IN_L, IN_N, IN_O, BLANK, SPACE, TWO, ONE, ENDED = range(8)
CACHE_ITEMS = 700_000


def _step(state: int, c: int) -> tuple[int, bool]:
    """The next state, and whether a piece begins at a character of class c."""
    if state in (TWO, ONE):
        return (ONE if state == TWO else ENDED), False
    if c in (SP_LAST, WS_LAST, MID):
        begins = state not in (BLANK, SPACE) or c != MID
        return (BLANK if c == SP_LAST else SPACE), begins
    joins = state == BLANK
    if c in (A1, A2) and not joins and state != IN_O:
        return (ONE if c == A1 else TWO), True
    run = IN_L if c == L else IN_N if c == N else IN_O
    return run, not joins and state != run


@functools.cache
def boundary_table() -> np.ndarray:
    """Whether a piece begins at a character, by its class and the four before: functions composed, then applied."""
    functions = np.array([[_step(s, c)[0] for s in range(8)] for c in range(8)], np.uint8)
    begins = np.array([[_step(s, c)[1] for s in range(8)] for c in range(8)])
    pairs = np.array([[functions[b][functions[a]] for b in range(8)] for a in range(8)])  # first a, then b
    table = np.zeros(8**5, bool)
    for a, b, c, d in itertools.product(range(8), repeat=4):
        composed = pairs[c, d][pairs[a, b]]
        # only a letter follows an apostrophe of a contraction, so the states inside one can't come before others
        state = composed[IN_L if a in (L,) else SPACE]
        base = ((a * 8 + b) * 8 + c) * 8 + d
        table[base * 8 : base * 8 + 8] = begins[:, state]
    return table


@functools.cache
def class_table() -> np.ndarray:
    """L, N, O for code points; blanks and other whitespace as SP_LAST and WS_LAST."""
    kinds = np.full(0x110000, O, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            kinds[c] = L
        elif k == "N":
            kinds[c] = N
    kinds[SPACES] = WS_LAST
    kinds[32] = SP_LAST
    return kinds


def boundaries(text: str) -> np.ndarray:
    """Where pieces begin."""
    if not text:
        return np.empty(0, np.int64)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kinds = class_table()[codes]
    space = kinds >= SP_LAST
    before_space = np.append(space[1:], True)
    kinds[space & before_space] = MID
    marks = np.flatnonzero(codes == 39)
    if len(marks):
        one, two = (np.where(marks + k < len(codes), codes[np.minimum(marks + k, len(codes) - 1)], 0) for k in (1, 2))
        is_1 = np.isin(one, [ord(c) for c in "stmd"])
        is_2 = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        kinds[marks[is_1]], kinds[marks[is_2]] = A1, A2
    padded = np.concatenate([np.full(4, WS_LAST, np.uint8), kinds]).astype(np.uint16)
    n = len(kinds)
    index = padded[:n]
    for k in range(1, 5):
        index = (index << np.uint16(3)) | padded[k : n + k]
    begins = boundary_table()[index]
    begins[0] = True
    return np.flatnonzero(begins)


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Pairs of the lowest rank first, the leftmost on ties, in n log n."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != to:
            continue
        j = end[i]
        alive[j] = False
        end[i] = to
        if to < n:
            before[to] = i
            if (r := ranks.get(piece[i : end[to]])) is not None:
                heapq.heappush(heap, (r, i, end[to]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:to])) is not None:
            heapq.heappush(heap, (r, h, to))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Cache(dict):
    """Pieces of text to their ids as little-endian 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_ITEMS:
            self.clear()
        ids = np.array(merged(piece.encode(), self.ranks), np.uint32).tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Encoded(NamedTuple):
    """Ids as little-endian 32-bit integers, and where slices begin: in code points, and in ids (one more, for the end)."""

    ids: bytes
    starts: np.ndarray
    edges: np.ndarray


class Codec:
    """Encodes and decodes by the ranks in a file of base64 tokens and ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.cache = Cache(self.ranks)

    def encode(self, texts: list[str]) -> list[Encoded]:
        if not texts:
            return []
        # a line feed between texts is a state from which every text begins alike
        joined = "\n".join(texts)
        starts = boundaries(joined)
        size = np.array([len(t) for t in texts])
        first = np.cumsum(size + 1) - size - 1
        starts = np.unique(np.concatenate([starts, first, (first + size)[:-1]]))
        cuts = starts.tolist()
        pieces = [joined[a:b] for a, b in zip(cuts, [*cuts[1:], len(joined)], strict=True)]
        lo, hi = np.searchsorted(starts, first), np.searchsorted(starts, first + size)
        ids = list(map(self.cache.__getitem__, pieces))
        count = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        edges = np.concatenate([[0], np.cumsum(count)])
        return [Encoded(b"".join(ids[a:b]) if n else b"", starts[a : b if n else a] - at, edges[a : (b if n else a) + 1] - edges[a]) for a, b, at, n in zip(lo.tolist(), hi.tolist(), first.tolist(), size.tolist(), strict=True)]

    def decode(self, text: Encoded, first: int = 0, last: int | None = None) -> bytes:
        """The bytes of the slices from number `first` up to `last`."""
        ids = np.frombuffer(text.ids, np.uint32)[text.edges[first] : text.edges[-1 if last is None else last]]
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))

    def decode_span(self, text: Encoded, begin: int, end: int) -> tuple[int, bytes]:
        """The slices that cover the code points from begin to end: the code point at which they begin, and their bytes."""
        if begin >= end or not len(text.starts):
            return begin, b""
        a = max(0, int(np.searchsorted(text.starts, begin, "right")) - 1)
        return int(text.starts[a]), self.decode(text, a, int(np.searchsorted(text.starts, end)))


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def in_batches(column: pa.Array, characters: int = 1 << 20):
    """Lists of texts of about so many characters; null is empty."""
    out, size = [], 0
    for text in column.to_pylist():
        out.append(text or "")
        size += len(out[-1])
        if size >= characters:
            yield out
            out, size = [], 0
    if out:
        yield out


def bpe_roundtrip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, n_tokens, and SHA-256 of the ids (little-endian 32-bit) and of the bytes that they decode to."""

    def run(batches):
        own = codec(vocabulary)
        for batch in batches:
            n, a, b = [], [], []
            for texts in in_batches(batch.column(1)):
                for text in own.encode(texts):
                    n.append(int(text.edges[-1]))
                    a.append(hashlib.sha256(text.ids).hexdigest())
                    b.append(hashlib.sha256(own.decode(text)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
