"""Token ids packed by best-fit decreasing, with a segment tree over capacities.

Each partition of documents is tokenised and packed where it lies, so nothing is
shuffled and the work grows with the input alone. A partition is packed in pools
of ``pool_tokens`` tokens, which bounds a worker's memory; each pool is one
best-fit-decreasing packing. A text of more than ``window`` tokens is cut into
full windows and a rest, in order, so that no token is lost.

A row is one window: ids as a little-endian binary vector padded with
``pad_id``, cumulative segment lengths (first 0, last the number of real
tokens), positions that start again at 0 in each segment, and for each segment
its document, its piece number and its offset in the document's ids.

``write_binary`` puts the same into files for a trainer: the id matrix (which it
can map), positions, cumulative lengths, and segments; ``read_binary`` has the rows back.

Edge cases: null and empty texts have no tokens and no segment; a null id stays
null in the segments; repeated rows are packed as often as they occur; an empty
table gives no rows. Texts are never cut short. Of equally long pieces the earlier
row comes first. Ids keep their type; other columns, whatever their names, are
left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_rows, kind, list_rows
from .tokens import VOCABULARY, encoder

WINDOW, POOL_TOKENS, EOT = 2048, 4_000_000, 50256


class CapacityTree:
    """Segment tree over capacities 0..size: how many bins have each, and the least capacity of at least c that any has."""

    def __init__(self, size: int):
        self.n = 1 << max(1, (size + 1 - 1).bit_length())
        self.count = [0] * (2 * self.n)
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, bin_no: int) -> None:
        self.bins[capacity].append(bin_no)
        i = capacity + self.n
        while i:
            self.count[i] += 1
            i >>= 1

    def best(self, need: int) -> int:
        """The least capacity of at least ``need`` with a bin, or -1."""
        i = need + self.n
        if self.count[i]:
            return need
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.n
            i >>= 1
        return -1

    def take(self, capacity: int) -> int:
        i = capacity + self.n
        while i:
            self.count[i] -= 1
            i >>= 1
        return self.bins[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> np.ndarray:
    """Bin of each item (all at most ``window``): longest first (ties: in order), each into the fullest bin that holds it."""
    tree, out, used = CapacityTree(window), np.empty(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        room = tree.best(need) if need < window else -1
        if room < 0:
            b, room, used = used, window, used + 1
        else:
            b = tree.take(room)
        out[i] = b
        if room > need:
            tree.add(room - need, b)
    return out


def pieces(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, piece number and length of every piece of documents that have so many tokens."""
    counts = -(-lengths // window)
    doc = np.repeat(np.arange(len(lengths)), counts)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    return doc, number, np.minimum(window, lengths[doc] - number * window)


def schema(id_type: str) -> str:
    return f"token_ids binary, n_tokens int, cu_seqlens array<int>, position_ids binary, segments array<struct<doc_id:{id_type},piece:int,offset:bigint,length:int>>"


def pack_pool(ids: np.ndarray, lengths: np.ndarray, doc_ids: pa.Array, window: int, pad: int) -> pa.RecordBatch:
    """The packed windows of documents whose ids lie one after the other in ``ids``."""
    doc, number, size = pieces(lengths, window)
    where = best_fit_decreasing(size, window)
    bins = int(where.max()) + 1
    order = np.argsort(where, kind="stable")
    doc, number, size, where = doc[order], number[order], size[order], where[order]
    total = np.bincount(where, size, bins).astype(np.int64)
    at = np.cumsum(size) - size - np.repeat(np.cumsum(total) - total, np.bincount(where, minlength=bins))  # in its window
    source = (np.cumsum(lengths) - lengths)[doc] + number.astype(np.int64) * window
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    matrix, position = np.full((bins, window), pad, ids.dtype), np.zeros((bins, window), ids.dtype if window < 1 << 16 else np.int32)
    flat = np.repeat(where * window + at, size) + inner
    matrix.ravel()[flat] = ids[np.repeat(source, size) + inner]
    position.ravel()[flat] = inner
    n = np.bincount(where, minlength=bins)
    ends = np.zeros(len(size) + bins, np.int32)
    slot = np.arange(len(size)) + where + 1
    ends[slot] = at + size
    seg = pa.StructArray.from_arrays([doc_ids.take(pa.array(doc)), pa.array(number.astype(np.int32)), pa.array(number.astype(np.int64) * window), pa.array(size.astype(np.int32))], ["doc_id", "piece", "offset", "length"])
    return pa.RecordBatch.from_arrays([binary_rows(matrix), pa.array(total.astype(np.int32)), list_rows(pa.array(ends), n + 1), binary_rows(position), list_rows(seg, n)], ["token_ids", "n_tokens", "cu_seqlens", "position_ids", "segments"])


def _pack(path: str, window: int, pool: int, pad: int, dtype):
    def run(batches):
        enc = encoder(path)
        if enc.n_vocab > np.iinfo(dtype).max + 1 or pad > np.iinfo(dtype).max:
            raise ValueError(f"token ids don't fit {np.dtype(dtype)}")
        ids, lengths, docs, held = [], [], [], 0

        def pool_():
            return pack_pool(np.concatenate(ids), np.array(lengths), pa.concat_arrays(docs), window, pad)

        for batch in batches:
            for i, t in enumerate(batch.column("text")):
                x = np.array(enc.encode_ordinary(t.as_py()), dtype)
                if not len(x):
                    continue
                ids.append(x)
                lengths.append(len(x))
                docs.append(batch.column("doc_id").slice(i, 1))
                held += len(x)
                if held >= pool:
                    yield pool_()
                    ids, lengths, docs, held = [], [], [], 0
        if held:
            yield pool_()

    return run


def pack_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, window: int = WINDOW, pool_tokens: int = POOL_TOKENS, pad_id: int = EOT, dtype: str = "uint16", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed windows of all texts: token_ids (binary, ``window`` values of ``dtype``), n_tokens, cu_seqlens, position_ids (binary), segments."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null and text <> ''")
    return d.mapInArrow(_pack(vocabulary, window, pool_tokens, pad_id, np.dtype(dtype).type), schema(kind(docs, id_col)))


PARTS = ("ids", "pos", "len", "seg")
_MANIFEST = "part int, path string, windows long, tokens long"


def _files(folder: str):
    """File system and path of a folder that all executors share: a path, or a URI of any kind that Arrow knows (file, hdfs, s3, gs)."""
    from pyarrow import fs

    if ":/" not in folder:
        return fs.LocalFileSystem(), folder
    if folder.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + folder[6:].lstrip("/")
    return fs.FileSystem.from_uri(folder)


def write_binary(packed: DataFrame, folder: str) -> DataFrame:
    """Writes each partition to ``part-<n>.*`` in a shared folder: ``ids``, a matrix of a row for each window; ``pos``, the same for positions, which repeat so much that they are kept as a zstd stream; ``len``, for each window the number of its segments and then its cumulative lengths (int32); ``seg``, Arrow's file of the segments. Returns part, path, windows, tokens.

    A file appears under its name only when it is whole, so a lost or repeated task leaves no torn file. Lazy: files are written as the result is read.
    """

    def run(batches):
        from pyspark import TaskContext

        files, path = _files(folder)
        files.create_dir(path, recursive=True)
        ctx = TaskContext.get()
        part, rows, tokens = ctx.partitionId(), 0, 0
        name = f"{path}/part-{part:05d}"
        out = {k: files.open_output_stream(f"{name}.{k}.{ctx.taskAttemptId()}", compression="zstd" if k == "pos" else None) for k in PARTS}
        seg = None
        for b in batches:
            if not b.num_rows:
                continue
            for k, c in (("ids", "token_ids"), ("pos", "position_ids")):
                for x in b.column(c):
                    out[k].write(x.as_buffer())
            n = np.asarray(pc.list_value_length(b.column("cu_seqlens")))
            ends = np.asarray(pc.list_flatten(b.column("cu_seqlens"))).astype("<i4")
            out["len"].write(np.insert(ends, np.cumsum(n) - n, n - 1).astype("<i4").tobytes())
            s = pa.RecordBatch.from_arrays([b.column("segments")], ["segments"])
            seg = seg or pa.ipc.new_file(out["seg"], s.schema)
            seg.write_batch(s)
            rows, tokens = rows + b.num_rows, tokens + (pc.sum(b.column("n_tokens")).as_py() or 0)
        if seg:
            seg.close()
        for k, f in out.items():
            f.close()
            if rows:
                files.move(f"{name}.{k}.{ctx.taskAttemptId()}", f"{name}.{k}")
            else:
                files.delete_file(f"{name}.{k}.{ctx.taskAttemptId()}")
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"{folder}/part-{part:05d}"]), pa.array([rows], pa.int64()), pa.array([tokens], pa.int64())], ["part", "path", "windows", "tokens"])

    return packed.mapInArrow(run, _MANIFEST)


def read_binary(manifest: DataFrame, id_type: str = "bigint", window: int = WINDOW, dtype: str = "uint16") -> DataFrame:
    """The rows of ``pack_tokens`` from files that ``write_binary`` wrote. A task reads a file, some windows at a time."""
    width = window * np.dtype(dtype).itemsize

    def run(batches):
        for b in batches:
            for folder, name in (x.as_py().rsplit("/", 1) for x in b.column("path")):
                files, path = _files(folder)
                with files.open_input_file(f"{path}/{name}.ids") as ids, files.open_input_stream(f"{path}/{name}.pos", compression="zstd") as pos, files.open_input_file(f"{path}/{name}.len") as f, pa.ipc.open_file(files.open_input_file(f"{path}/{name}.seg")) as seg:
                    flat, at = np.frombuffer(f.read(), "<i4"), 0
                    for k in range(seg.num_record_batches):
                        s = seg.get_batch(k).column("segments")
                        n, ends = np.asarray(pc.list_value_length(s)).astype(np.int64), []
                        for m in n.tolist():
                            ends.append(flat[at + 1 : at + m + 2])
                            at += m + 2
                        matrix = lambda f, rows=len(s): binary_rows(np.frombuffer(f.read(rows * width), np.uint8).reshape(rows, width))
                        cu = list_rows(pa.array(np.concatenate(ends)), n + 1)
                        total = pa.array(np.array([e[-1] for e in ends], np.int32))
                        yield pa.RecordBatch.from_arrays([matrix(ids), total, cu, matrix(pos), s], ["token_ids", "n_tokens", "cu_seqlens", "position_ids", "segments"])

    # a file for each task
    return manifest.select("path").repartition(max(1, manifest.count()), "path").mapInArrow(run, schema(id_type))
