"""What the corpus operators share: sessions' settings, checkpoints, batches of documents and packed columns."""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What operators keep in a worker from task to task: calls that let go of it.
CACHES: list = []
#: Made once for each process: a context costs as much as a small column takes to compress.
_PACK, _UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
#: Null ids stand after all others.
LAST_ID = 2**63 - 1


def free_caches() -> None:
    """For a task of another operator: a worker that has packed may hold hundreds of thousands of words."""
    for free in CACHES:
        free()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ready_to_checkpoint(spark: SparkSession) -> None:
    """Uses the shared folder that the session names in spark.checkpoint.dir; where it names none, one under the warehouse."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")


def checkpoint(df: DataFrame) -> DataFrame:
    ready_to_checkpoint(df.sparkSession)
    return df.checkpoint()


def positional(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with columns named by their places, and those names by the old ones: so no input column can clash with one that an operator makes."""
    own = {c: f"__in{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*own.values()), own


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def packed(values: np.ndarray) -> bytes:
    """Compressed by planes of bytes; made for sorted or small integers."""
    if not len(values):
        return b""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return _PACK.compress(np.ascontiguousarray(planes).tobytes())


def unpacked(blob: bytes, dtype) -> np.ndarray:
    if not blob:
        return np.empty(0, dtype)
    raw = np.frombuffer(_UNPACK.decompress(blob), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(dtype)


def packed_sorted(values: np.ndarray) -> bytes:
    """Of sorted unsigned integers: their differences."""
    return packed(np.diff(values, prepend=values.dtype.type(0)))


def unpacked_sorted(blob: bytes, dtype=np.uint64) -> np.ndarray:
    return np.cumsum(unpacked(blob, dtype), dtype=dtype)


def starts_of(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where rows of sorted columns differ from the row before."""
    n = len(sorted_columns[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for c in sorted_columns:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and the offsets of its rows in them; nulls are empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]
