"""Vectorised text helpers shared by the operators.

Every helper works on a whole Arrow string column at once: the UTF-8 bytes of
many texts lie in one buffer, and numpy finds words and hashes them without a
Python loop over texts or words. Callers feed slices of a few megabytes
(``slices``), so that the 64-bit work arrays stay small whatever the batch is.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
SLICE_BYTES, HASH_BLOCK, BROADCAST_BYTES, ROW_BYTES = 1 << 20, 1 << 19, 8 << 20, 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_pow = [np.ones(1, U64), np.ones(1, U64)]

#: Bytes that make up words: ASCII letters and digits, and every byte of a non-ASCII character (but see ``word_bytes``).
ALNUM = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
#: Bytes that make up white-space-separated words.
NONSPACE = np.array([b not in b" \t\n\r\v\f" for b in range(256)])


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which a cluster shares. Only where none is set and all runs on this machine (tests) a folder of its own; on a cluster without one this is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="juralake-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """An eager, reliable checkpoint: a lost executor costs nothing that was computed before it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


class Scratch:
    """Tables in the shared folder that cut the lineage of an operator's steps and go when it is done.

    ``keep`` writes a table and reads it back; ``free`` removes tables that no later step reads; leaving the block removes the rest. What the operator returns must not read them: it is a ``cut_lineage``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.tables = spark, f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        remove_folder(self.spark, self.root)

    def keep(self, df: DataFrame) -> DataFrame:
        self.tables += 1
        path = f"{self.root}/{self.tables}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def free(self, *tables: DataFrame) -> None:
        for t in tables:
            remove_folder(self.spark, t.scratch_path)


def small_or_shuffled(df: DataFrame, width, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A table marked for broadcast if its bytes (``width`` a row: a number or a Column, and what a row of a hash table costs) are within the limit; beyond it the join shuffles, and adaptive execution splits hot keys."""
    total = df.agg(F.sum(ROW_BYTES + (width if isinstance(width, Column) else F.lit(width)))).first()[0] or 0
    return F.broadcast(df) if total <= limit else df


def kind(df: DataFrame, column: str) -> str:
    """The type of a column as SQL: ids keep theirs."""
    return df.schema[column].dataType.simpleString()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base modulo 2**64, and of its inverse."""
    if len(_pow[0]) < n:
        size = max(n, 2 * HASH_BLOCK + 1)
        for k, b in enumerate((_BASE, _INV)):
            x = np.full(size, b, U64)
            x[0] = 1
            _pow[k] = np.cumprod(x, dtype=U64)
    return _pow[0][:n], _pow[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit hash over all its bits."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the offsets of its texts in them; a null counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, off, data = texts.buffers()
    off = np.frombuffer(off, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``limit`` bytes of text; one longer text makes a slice of its own."""
    _, off = buffers(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def word_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to words: ASCII letters and digits, and characters beyond ASCII other than signs (U+0080 to U+00BF, general punctuation U+2000 to U+207F, CJK punctuation U+3000 to U+303F)."""
    inside = ALNUM[data]
    if len(data) > 2 and data.max() >= 0xC2:
        two = np.flatnonzero(data == 0xC2)
        a, b = data[:-2], data[1:-1]
        three = np.flatnonzero(((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80)))
        inside[two] = False
        inside[np.minimum(two + 1, len(data) - 1)] = False
        for k in range(3):
            inside[three + k] = False
    return inside


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each maximal run of word bytes; no run crosses from one text to the next."""
    n = len(data)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, e
    inside = word_bytes(data) if table is ALNUM else table[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    before[edge] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[edge - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of values[start:end] for many spans in order of their starts, from prefix sums of a polynomial hash.

    A hash doesn't depend on where its span lies, so long arrays are taken a piece at a time, and the 64-bit sums stay small.
    """
    if len(values) > 2 * HASH_BLOCK and len(start):
        out, cuts = np.empty(len(start), U64), np.searchsorted(start, np.arange(0, len(values), HASH_BLOCK))
        for i, j in zip(cuts, [*cuts[1:], len(start)], strict=True):
            if i < j:
                lo, hi = int(start[i]), int(end[i:j].max())
                out[i:j] = _span_hash(values[lo:hi], start[i:j] - lo, end[i:j] - lo)
        return out
    return _span_hash(values, start, end)


def _span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * up[:-1], dtype=U64, out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == U64 else x.astype(np.int64))


def ragged(counts: np.ndarray) -> np.ndarray:
    """0..counts[0]-1, 0..counts[1]-1, and so on in one array."""
    total = int(counts.sum())
    first = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(first, counts)


def binary_rows(matrix: np.ndarray) -> pa.Array:
    """One binary value for each row of a C-contiguous matrix."""
    width = matrix.shape[1] * matrix.itemsize
    off = np.arange(len(matrix) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(matrix))])


def list_rows(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list array with counts[i] of the values in row i."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)
