"""Shared helpers of the training-data operators: scratch storage, word tables, set hashes.

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes with A-Z lower-cased.  Word and shingle
hashes are 64 bits; sets are compared through them.
"""

from __future__ import annotations

import gc
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Workers need no copy of the package: its functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__.rsplit(".", 1)[0]])

#: Bytes of text that a task hashes at a time.
PIECE_BYTES = 1 << 20
_M = 0xFFFFFFFFFFFFFFFF


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs in one process."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared scratch folder and read it back (cuts the lineage)."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    forget(spark)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of steps that nothing refers to any more: it waits for a collection of the driver's garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def partitions(spark: SparkSession, least: int = 12) -> int:
    """Shuffle partitions to ask for: the session's number, at least ``least``."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0x9FB21C651E98DF25)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(32)
    return x


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if off is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def space_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[9, 10, 11, 12, 13, 32]] = True
    return table


class WordHasher:
    """Hashes of all words of a buffer, without a Python loop over words.

    A word's hash is a polynomial of its bytes in a ring modulo 2**64, taken from prefix sums
    and then mixed.  ``piece``: bytes hashed at a time, each of which takes some 60 bytes; hashes don't depend on it.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, piece: int = PIECE_BYTES) -> None:
        rng = np.random.default_rng(20240229)
        self.values = rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)[lower_table()]
        self.space = space_table()
        self.piece, self.size = piece, 0
        self._grow(piece + 4096)

    def _grow(self, n: int) -> None:
        if n <= self.size:
            return
        self.size = n
        base, inverse = self.BASE | 1, pow(self.BASE | 1, -1, 1 << 64)
        for name, b in (("power", base), ("unpower", inverse)):
            step = np.full(n, b, np.uint64)
            step[0] = 1
            setattr(self, name, np.multiply.accumulate(step))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash of each word, its first byte, for each row the number of its first word), n + 1 of the last.

        ``ends`` then holds the places behind the words.
        """
        hashes, starts, ends = [], [], []
        heads = offsets[:-1][np.diff(offsets) > 0]
        at, n = 0, len(data)
        while at < n:
            end = min(n, at + self.piece)
            if end < n:  # cut before a space or a row
                room = np.flatnonzero(self.space[data[at + 1 : end]])
                k = np.searchsorted(heads, end, "right") - 1
                back = max(int(room[-1]) + at + 1 if len(room) else at, int(heads[k]) if k >= 0 else at)
                if back > at:
                    end = back
                else:
                    later = n if k + 1 >= len(heads) else int(heads[k + 1])
                    while end < later and not self.space[data[end]]:
                        end += 1
            piece = data[at:end]
            self._grow(len(piece) + 1)
            solid = ~self.space[piece]
            edge = np.zeros(len(piece) + 1, bool)
            lo, hi = np.searchsorted(heads, [at, end])
            edge[heads[lo:hi] - at] = True
            edge[-1] = edge[0] = True
            first = solid & (edge[:-1] | np.concatenate(([True], ~solid[:-1])))
            last = solid & (edge[1:] | np.concatenate((~solid[1:], [True])))
            s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
            total = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(self.values[piece] * self.power[: len(piece)], out=total[1:])
            hashes.append(mix((total[e] - total[s]) * self.unpower[s] + (e - s).astype(np.uint64)))
            starts.append(s + at)
            ends.append(e + at)
            at = end
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.ends = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        return h, s, np.searchsorted(s, offsets)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one word sequence; a shorter sequence is one shingle."""
    if len(h) == 0:
        return h
    k = min(k, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (h[i : len(h) - k + 1 + i] + np.uint64(0x165667B19E3779F9))
        out ^= out >> np.uint64(31)
    return mix(out)


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most ``most`` bytes of text (a longer row alone)."""
    _, offsets = text_buffer(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end
