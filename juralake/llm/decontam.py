"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are normalised alike: lower case; everything but word
characters (see ``common.word_bytes``) becomes one space; a space stands at both
ends. An item of m bytes occurs in a text if the item with its two spaces, M = m
+ 2 bytes, aligns with some part of the text with at most e = floor(rate * m)
edits (bytes put in, left out or changed). This one rule holds for all lengths;
without edits (m below 1 / rate) it means whole words.

If the item occurs with at most e edits, the two share at least M - q + 1 - q * e
q-grams on neighbouring diagonals. With q = min(Q, M // (e + 1)) that is at least
1, whatever the length. So, for each text and each q that occurs: mark the
positions whose q-gram occurs in any item; keep stretches dense enough to hold an
occurrence; there look the q-grams up, count hits by (item, diagonal band), with
bands that overlap by half so that no alignment is split between two; and verify
bands that reach the bound of their item by banded alignment within the edit
budget. The filter loses nothing: what it drops cannot meet the budget. Hits are
counted ``HITS`` at a time, and bands that lie behind are closed, so that items
with much text in common cost time but not memory.

The benchmark reaches the executors in shards of at most ``shard_chars``
characters; a larger benchmark makes more passes over the documents, not a
larger broadcast.

Edge cases: null or empty texts, and items without a word character, match
nothing, nor does anything match in an empty table or with an empty benchmark;
null document ids are kept in the result as null; null item ids too. A document
that holds an item more than once is reported once, with the fewest edits.
Repeated rows are reported once each, and so are repeated items. Texts are
searched whole, however long. Ids keep their type; ``remove`` returns all columns
of its input, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, buffers, kind, ragged, slices, word_bytes

Q, RATE, SHARD_CHARS, HITS = 10, 0.06, 4_000_000, 1 << 21
_TABLE_BITS = 22
_MULT = U64(0x9E3779B97F4A7C15)  # odd


def normalise(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes and the offsets of the texts in them. Each text starts and ends in one space; one without words is a space."""
    data, off = buffers(pc.utf8_lower(texts))
    n, k = len(data), len(texts)
    flat = np.full(n + 2 * k, 32, np.uint8)
    flat[np.arange(n) + 2 * np.repeat(np.arange(k), np.diff(off)) + 1] = np.where(word_bytes(data), data, 32)
    new_off = off + 2 * np.arange(k + 1)
    space = flat == 32
    drop = np.zeros(len(flat), bool)
    drop[1:] = space[1:] & space[:-1]
    drop[new_off[:-1]] = False
    keep = ~drop
    return flat[keep], np.concatenate([[0], np.cumsum(keep)])[new_off]


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """The q bytes from each position on as one number (over 8 bytes: a hash of them), zero bytes behind the end; q is at most 16."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    at = lambda k: np.ndarray(shape=(len(data),), dtype="<u8", buffer=padded, offset=k, strides=(1,))
    if q <= 8:
        return at(0) & U64((1 << (8 * q)) - 1) if q < 8 else at(0)
    return (at(0) * _MULT) ^ (at(q - 8) * U64(0xD6E8FEB86659FD93))


@dataclass
class Layer:
    """Items of one q: which they are, their bytes with both spaces, budgets and bounds, and their q-grams in order."""

    q: int
    name: np.ndarray
    items: list[bytes]
    edits: np.ndarray
    bound: np.ndarray
    table: np.ndarray
    gram: np.ndarray
    item: np.ndarray
    pos: np.ndarray


@dataclass
class Index:
    """One shard of the benchmark: ids and normalised lengths of all its items, and the layers that find them."""

    ids: pa.Array
    size: np.ndarray
    layers: list[Layer]


def _layer(q: int, name: np.ndarray, items: list[bytes], edits: np.ndarray) -> Layer:
    m = np.array([len(x) for x in items])
    counts = m - q + 1
    g = np.concatenate([grams(np.frombuffer(x, np.uint8), q)[:c] for x, c in zip(items, counts, strict=True)])
    item, pos = np.repeat(np.arange(len(items)), counts), ragged(counts)
    order = np.argsort(g, kind="stable")
    table = np.zeros(1 << _TABLE_BITS, bool)
    table[((g * _MULT) >> U64(64 - _TABLE_BITS)).astype(np.int64)] = True
    return Layer(q, name, items, edits, counts - q * edits, table, g[order], item[order].astype(np.int32), pos[order].astype(np.int32))


def build_index(ids: pa.Array | list, texts: list, q: int = Q, rate: float = RATE) -> Index | None:
    """None if no item has a word character."""
    data, off = normalise(pa.array(texts, pa.string()))
    items = [data[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)]
    size = np.array([max(len(x) - 2, 0) for x in items], np.int64)
    edits = (size * rate).astype(int)
    grain = np.minimum(q, (size + 2) // (edits + 1))
    full = size > 0
    if not full.any():
        return None
    layers = [_layer(int(k), at, [items[i] for i in at], edits[at]) for k in np.unique(grain[full]) for at in [np.flatnonzero(full & (grain == k))]]
    return Index(ids if isinstance(ids, pa.Array) else pa.array(ids), size, layers)


def banded(item: np.ndarray, region: np.ndarray, low: int, high: int, most: int) -> int | None:
    """Fewest edits between the item and any part of the region, over diagonals low..high (region position less item position). None if more than ``most``."""
    m, width, big = len(item), high - low + 1, most + 1
    col = np.arange(width)
    cost = np.where((col + low >= 0) & (col + low <= len(region)), 0, big)
    for i in range(1, m + 1):
        j = i + low + col  # region bytes used at this cell
        inside = (j >= 1) & (j <= len(region))
        ch = region[np.clip(j - 1, 0, max(len(region) - 1, 0))] if len(region) else np.zeros(width, np.uint8)
        diag = np.where(inside, cost + (ch != item[i - 1]), big)
        best = np.minimum(diag, np.append(cost[1:], big) + 1)
        best = np.where((j >= 0) & (j <= len(region)), best, big)
        # along the row: a region byte that the item lacks
        cost = np.minimum(np.minimum.accumulate(best - col) + col, big)
        if cost.min() > most:
            return None
    return int(cost.min()) if cost.min() <= most else None


def _dense(n: int, where: np.ndarray, total: np.ndarray, layer: Layer) -> np.ndarray:
    """Of the positions with a known q-gram, those in a window that an occurrence could fill. Items of like length share a test."""
    m = np.array([len(x) for x in layer.items])
    wanted = np.zeros(n, bool)
    group = np.floor(np.log2(m) * 4).astype(int)
    for c in np.unique(group):
        span, least = int((m + layer.edits)[group == c].max()), int(layer.bound[group == c].min())
        stop = np.minimum(where + span, n)
        dense = (total[stop] - total[where]) >= least  # the window from this hit on
        if dense.any():
            step = np.zeros(n + 1, np.int32)
            np.add.at(step, where[dense], 1)
            np.add.at(step, stop[dense], -1)
            wanted |= np.cumsum(step)[:-1] > 0
    return where[wanted[where]]


def _bands(data: np.ndarray, off: np.ndarray, layer: Layer, hits: int):
    """(text, item, low, width) of every diagonal band that holds its item's bound of q-grams; low is counted from the text's start."""
    q, n = layer.q, len(data)
    g = grams(data, q)
    hit = layer.table[((g * _MULT) >> U64(64 - _TABLE_BITS)).astype(np.int64)]
    where = np.flatnonzero(hit)
    if not len(where):
        return
    where = _dense(n, where, np.concatenate([[0], np.cumsum(hit, dtype=np.int64)]), layer)
    if not len(where):
        return
    lo, hi = np.searchsorted(layer.gram, g[where], "left"), np.searchsorted(layer.gram, g[where], "right")
    many = hi - lo
    reach = max(len(x) for x in layer.items)
    span = 2 * (n + 4 * reach) + 2  # more bands than any text has
    spread, count = layer.edits + 1, len(layer.items)
    key, number = np.zeros(0, np.int64), np.zeros(0, np.int64)
    runs = np.cumsum(many) // hits
    cuts = np.flatnonzero(np.diff(runs, prepend=-1)).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(where)], strict=True):
        at = np.repeat(lo[a:b], many[a:b]) + ragged(many[a:b])
        p, item = np.repeat(where[a:b], many[a:b]), layer.item[at].astype(np.int64)
        doc = np.searchsorted(off, p, "right") - 1
        base = p - layer.pos[at] - off[doc] + 2 * reach
        # bands of twice the alignment's spread (edits each way), shifted by half
        s = spread[item]
        keys = [((doc * count + item) * span + (base + half * s) // (2 * s)) * 2 + half for half in (0, 1)]
        uniq, n_here = np.unique(np.concatenate(keys), return_counts=True)
        key, back = np.unique(np.concatenate([key, uniq]), return_inverse=True)
        number = np.bincount(back, np.concatenate([number, n_here]), len(key)).astype(np.int64)
        half, band, rest = key & 1, (key >> 1) % span, (key >> 1) // span
        doc, item = rest // count, rest % count
        s = spread[item]
        low = band * 2 * s - half * s - 2 * reach
        full = number >= layer.bound[item]
        closed = off[doc] + low + 2 * s + reach < (where[b] if b < len(where) else 1 << 62)
        for k in np.flatnonzero(full & closed):
            yield int(doc[k]), int(item[k]), int(low[k]), int(2 * s[k])
        key, number = key[~closed], number[~closed]


def find(texts: pa.Array, index: Index, hits: int = HITS) -> list[tuple[int, int, int]]:
    """(text, item, edits) for each text and item that occurs in it."""
    data, off = normalise(texts)
    best: dict[tuple[int, int], int] = {}
    for layer in index.layers:
        for d, i, low, width in _bands(data, off, layer, hits):
            to, e, item = (d, int(layer.name[i])), int(layer.edits[i]), layer.items[i]
            if best.get(to) == 0:
                continue
            body = data[off[d] : off[d + 1]]
            a = max(0, low - e)
            region = body[a : max(a, low + width + len(item) + 2 * e)]
            found = 0 if item in region.tobytes() else banded(np.frombuffer(item, np.uint8), region, low - e - a, low + width - 1 + e - a, e) if e else None
            if found is not None:
                best[to] = min(best.get(to, found), found)
    return [(d, i, e) for (d, i), e in sorted(best.items())]


def _search(index: Index):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                rows = find(part.column("text"), index)
                d, i, e = (np.array([r[k] for r in rows], np.int64) for k in range(3))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(d)), index.ids.take(pa.array(i)), pa.array(e.astype(np.int32)), pa.array(index.size[i].astype(np.int32))], ["doc_id", "item_id", "edits", "item_chars"])

    return run


def _drop(index: Index, text_col: str):
    def run(batches):
        for batch in batches:
            at = batch.schema.names.index(text_col)
            for part in slices(batch, text_col):
                bad = {r[0] for r in find(pc.cast(part.column(at), pa.string()), index)}
                yield part.take(pa.array([i for i in range(part.num_rows) if i not in bad], pa.int64())) if bad else part

    return run


def shards(benchmark: DataFrame, q: int = Q, rate: float = RATE, shard_chars: int = SHARD_CHARS) -> list[Index]:
    """The benchmark's indexes, each over items of at most ``shard_chars`` characters in all (one longer item makes a shard)."""
    b = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")
    total = b.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    parts = max(1, -(-total // shard_chars))
    b = b.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    out = []
    for k in range(parts):
        rows = b.where(F.col("shard") == k).orderBy("item_id", "text").select("item_id", "text").toArrow()
        index = build_index(rows.column("item_id").combine_chunks(), rows.column("text").to_pylist(), q, rate)
        if index:
            out.append(index)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, shard_chars: int = SHARD_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, edits, item_chars (bytes of the normalised item) for each document and item that occurs in it within the budget. One scan of docs for each shard, no shuffle."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    schema = f"doc_id {kind(docs, id_col)}, item_id {kind(benchmark, 'item_id')}, edits int, item_chars int"
    out = None
    for index in shards(benchmark, q, rate, shard_chars):
        found = d.mapInArrow(_search(index), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else d.sparkSession.createDataFrame([], schema)


def remove(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, shard_chars: int = SHARD_CHARS, text_col: str = "text") -> DataFrame:
    """docs without those that hold a benchmark item; all columns stay."""
    for index in shards(benchmark, q, rate, shard_chars):
        docs = docs.mapInArrow(_drop(index, text_col), docs.schema)
    return docs
