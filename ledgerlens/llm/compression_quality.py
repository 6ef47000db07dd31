"""A quality classifier by compression with dictionaries of good and bad text.

Two zstandard dictionaries are trained on labelled texts of either class. A text is compressed in blocks of `BLOCK` bytes, all
of it, with each; the difference of the compressed sizes, normalised by the text's bytes and by the larger size, goes through a
logistic calibration. Blocks keep a long text from explaining itself, so that the dictionaries go on telling the classes apart.

Fitting reads at most `per_class` labelled rows of each class, in order of a hash of the id (the documented bound on what
reaches the driver). A hash of the id deals them into two halves. The first feeds the dictionaries, with
`pieces` pieces of `piece_bytes` bytes spread evenly over each text (texts up to that size whole), all of which the trainer weighs; the
second feeds the calibration, with the sizes of whole texts, which executors compute. Scoring reads every byte of every text.

Labels are learnt only from rows that aren't held out (crc32 of the id as text modulo 4 is 2). Defined cases: null and
empty texts have differences of nought and get the calibration's score for them; a null id isn't held out; repeated labels
count once, a doc_id with both labels is bad; of repeated rows of a labelled id each distinct text counts once; with a class
missing, or too little text for two dictionaries, the score is the share of good labels; extra columns are ignored, whatever their
names; a score equal to the limit is predicted 1; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1024
PER_CLASS = 2000
PIECES, PIECE_BYTES = 4, 1024
DICTIONARY_BYTES = 48 << 10
LEVEL = 3
LIMIT = 0.7


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: np.ndarray
    prior: float

    def compressors(self):
        def made(content: bytes):
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False).compress

        return made(self.good), made(self.bad)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(expanded(x) @ self.weights, -30, 30)))


def features(text: bytes, compressors) -> tuple[float, float]:
    """The difference of the sizes by the bad and the good dictionary, over the text's bytes and over the larger size."""
    if not text:
        return 0.0, 0.0
    blocks = [text[k : k + BLOCK] for k in range(0, len(text), BLOCK)]
    good, bad = (sum(len(c(b)) for b in blocks) for c in compressors)
    return (bad - good) / len(text), (bad - good) / max(good, bad)


def expanded(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), 10 * x[:, 0], 10 * x[:, 1]])


def spread(text: bytes, pieces: int, size: int) -> list[bytes]:
    """A short text whole, of a longer one as many pieces at even distances from its first byte to its last."""
    if len(text) <= pieces * size:
        return [text[k : k + size] for k in range(0, len(text), size)]
    return [text[k : k + size] for k in np.linspace(0, len(text) - size, pieces).astype(int).tolist()]


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps."""
    a = expanded(x)
    w = np.zeros(a.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def in_first_half(doc_id) -> bool:
    return zlib.crc32(f"half{doc_id}".encode()) & 1 == 0


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary of all samples; empty if they are too few to train one."""
    samples = [s for s in samples if len(s) >= 8]
    if len(samples) < 8:
        return b""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 2)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS, pieces: int = PIECES, piece_bytes: int = PIECE_BYTES, dictionary_bytes: int = DICTIONARY_BYTES) -> Model:
    named = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    known = labels.select(F.col(id_col).alias("__known"), F.col("quality").alias("__q")).where("__known IS NOT NULL AND __q IS NOT NULL")
    known = known.where(~held_out(F.col("__known"))).groupBy("__known").agg((F.min("__q") > 0).alias("__y"))
    order = [F.xxhash64("__known"), "__known"]
    ids = known.where("NOT __y").orderBy(*order).limit(per_class).union(known.where("__y").orderBy(*order).limit(per_class))
    # at most 2 * per_class rows; distinct texts, so that repeated rows of an id count once
    rows = named.join(F.broadcast(ids), F.col("__id") == F.col("__known")).select("__id", "__y", "__text").distinct()

    def cut(batches):
        for batch in batches:
            out = [(i, y, p) for i, y, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) if in_first_half(i) for p in spread((t or "").encode(), pieces, piece_bytes)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in out], batch.schema.field(0).type), pa.array([y for _, y, _ in out], pa.bool_()), pa.array([p for _, _, p in out], pa.binary())], ["i", "y", "p"])

    kind = docs.schema[id_col].dataType.simpleString()
    samples = sorted((r["i"], bytes(r["p"]), r["y"]) for r in rows.mapInArrow(cut, f"i {kind}, y boolean, p binary").collect())
    shares = {r["__y"]: r["count"] for r in ids.groupBy("__y").count().collect()}
    prior = (shares.get(True, 0) + 1) / (sum(shares.values()) + 2)
    nothing = Model(b"", b"", np.empty(0), prior)
    model = Model(*(trained([p for _, p, y in samples if y == z], dictionary_bytes) for z in (True, False)), np.empty(0), prior)
    if not model.good or not model.bad:
        return nothing

    def measure(batches):
        own = model.compressors()
        for batch in batches:
            out = [(i, y, *features((t or "").encode(), own)) for i, y, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) if not in_first_half(i)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((batch.schema.field(0).type, pa.bool_(), pa.float64(), pa.float64()))], ["i", "y", "d", "r"])

    measured = sorted((r["i"], r["d"], r["r"], r["y"]) for r in rows.mapInArrow(measure, f"i {kind}, y boolean, d double, r double").collect())
    y = np.array([r[3] for r in measured], float)
    if len(set(y.tolist())) < 2:
        return nothing
    model.weights = fitted(np.array([r[1:3] for r in measured]), y)
    return model


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS, limit: float = LIMIT) -> DataFrame:
    """Id, held_out, score (0 to 1) and predicted (1 at the limit or above)."""
    model = fit(docs, labels, id_col, text_col, per_class)

    def run(batches):
        own = model.compressors() if len(model.weights) else None
        for batch in batches:
            texts = batch.column(1).to_pylist()
            x = np.array([features((t or "").encode(), own) if own else (0.0, 0.0) for t in texts]).reshape(len(texts), 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], [id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))
