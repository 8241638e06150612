"""Packing plans by non-negative least squares over the length histogram.

Lengths (tokens; overlong documents are first cut into full windows and a rest)
are rounded up to multiples of ``grain`` and counted. Strategies are all
combinations of up to ``depth`` lengths that fill a window exactly. Their repeat
counts x >= 0 minimise |A x - histogram|, each length weighted by one over the
square root of its count; they are rounded, bounded by what the histogram can
serve, and the pieces that remain are packed greedily (longest first, each into
the fullest window that holds it) with whole groups of equal windows moved at
once. A window holds at most window / grain pieces, and each piece leaves up to
grain - 1 tokens of room.

Only the histogram (window / grain numbers) comes to the driver. Documents get
their place from their rank among pieces of equal length, which is computed in
two levels (a salt's offset, and the rank within the salt), so no partition
holds all pieces of one length.

Edge cases: null and empty texts have length 0 and no row; null ids are packed
like others; repeated rows are packed as often as they occur (rows equal in id,
piece and length share out the ranks among them in no fixed order, which changes
nothing in the result); an empty table gives no rows. Texts are tokenised whole,
however long. Ids keep their type; other columns, whatever their names, are left
alone.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, kind
from .tokens import VOCABULARY, encoder

WINDOW, GRAIN, DEPTH, RANK_ROWS = 2048, 16, 3, 200_000


def strategies(size: int, depth: int) -> list[tuple[int, ...]]:
    """All non-increasing combinations of up to ``depth`` lengths 1..size that sum to size."""
    out = [(size,)]

    def go(left: int, most: int, taken: tuple[int, ...]):
        if left == 0:
            out.append(taken)
        elif len(taken) < depth:
            slots = depth - len(taken)
            for x in range(min(left, most), (left - 1) // slots, -1):
                go(left - x, x, (*taken, x))

    for x in range(size - 1, 0, -1):
        go(size - x, x, (x,))
    return out


def nnls(a: np.ndarray, b: np.ndarray, tol: float = 1e-9) -> np.ndarray:
    """Lawson and Hanson's active-set solution of min |a x - b|, x >= 0, on the normal equations."""
    g, h = a.T @ a, a.T @ b
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    scale = max(1.0, np.abs(h).max(initial=0.0))
    for _ in range(6 * a.shape[0] + 20):
        w = h - g @ x
        w[free] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= tol * scale:
            break
        free[j] = True
        while True:
            at = np.flatnonzero(free)
            s = np.linalg.lstsq(g[np.ix_(at, at)], h[at], rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            bad = s <= 0
            step = np.min(x[at][bad] / np.maximum(x[at][bad] - s[bad], 1e-300))
            x[at] += step * (s - x[at])
            x[at[bad & (x[at] <= tol * scale)]] = 0
            gone = at[x[at] <= 1e-12 * scale]
            free[gone] = False
            x[gone] = 0
            if not free.any():
                break
    return x


def greedy(counts: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing of counts[l] pieces of each length l: (window's lengths, how many such windows). Equal windows move together."""
    room: dict[int, list[list]] = defaultdict(list)  # capacity left -> [lengths, windows]
    for length in range(size, 0, -1):
        left = int(counts[length])
        while left:
            cap = min((c for c in room if c >= length and room[c]), default=None)
            if cap is None:
                # all pieces that are left open windows of their own, as many as hold them
                per = size // length
                full, rest = divmod(left, per)
                for k, n in ((per, full), (rest, 1 if rest else 0)):
                    if n and k:
                        room[size - k * length].append([(length,) * k, n])
                break
            lengths, n = room[cap].pop()
            per = cap // length
            full = min(n, left // per)
            if full:
                room[cap - per * length].append([lengths + (length,) * per, full])
                left -= full * per
                n -= full
            if n and left and left < per:
                room[cap - left * length].append([lengths + (length,) * left, 1])
                left, n = 0, n - 1
            if n:
                room[cap].append([lengths, n])
    return [(tuple(lengths), n) for group in room.values() for lengths, n in group]


def plan(histogram: np.ndarray, size: int, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a window, repeat count) for all windows; together they use exactly the histogram (index: length 0..size)."""
    hist = np.asarray(histogram, np.int64)
    combos = strategies(size, depth)
    a = np.zeros((size, len(combos)))
    for j, c in enumerate(combos):
        for x in c:
            a[x - 1, j] += 1
    # relative weights keep a rare length from being drowned by a common one
    weight = 1 / np.sqrt(np.maximum(hist[1:], 1))
    x = nnls(a * weight[:, None], hist[1:] * weight)
    left, out = hist.copy(), []
    for j in np.argsort(-x):
        use = np.zeros(size + 1, np.int64)
        np.add.at(use, list(combos[j]), 1)
        n = min(int(round(x[j])), int((left[use > 0] // use[use > 0]).min()))
        if n > 0:
            out.append((combos[j], n))
            left -= n * use
    return out + greedy(left, size)


def placement(plans: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """Which ranks of which length go where: length, rank_from, rank_to, first_pack, per_pack, slot."""
    rows, used, packs = [], defaultdict(int), 0
    for lengths, n in plans:
        slot = 0
        for length in sorted(set(lengths), reverse=True):
            per = lengths.count(length)
            rows.append((length, used[length], used[length] + n * per, packs, per, slot))
            used[length] += n * per
            slot += per
        packs += n
    return pd.DataFrame(rows, columns=["bin", "rank_from", "rank_to", "first_pack", "per_pack", "slot"])


def _count(vocabulary: str):
    def run(batches):
        enc = encoder(vocabulary)
        for b in batches:
            n = [len(enc.encode_ordinary(t.as_py())) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n"])

    return run


def token_lengths(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n: tokens of each text that has any. One pass of Python over the texts; only ids and counts come back."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null and text <> ''")
    return d.mapInArrow(_count(vocabulary), f"doc_id {kind(docs, id_col)}, n long")


def pack(docs: DataFrame, window: int = WINDOW, grain: int = GRAIN, depth: int = DEPTH, vocabulary: str = VOCABULARY, lengths=None, rank_rows: int = RANK_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, offset, length, pack_id, slot: the place of every piece of every text.

    lengths: a Column of token counts to use instead of tokenising. window must be a multiple of grain.
    """
    if window % grain:
        raise ValueError("window must be a multiple of grain")
    size = window // grain
    d = token_lengths(docs, vocabulary, id_col, text_col) if lengths is None else docs.select(F.col(id_col).alias("doc_id"), lengths.cast("long").alias("n"))
    # tokenised once: the counts are a few bytes a document
    d = cut_lineage(d.where("n > 0"))
    piece = d.select("doc_id", "n", F.posexplode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / window).cast("int"))).alias("piece", "p"))
    piece = piece.select("doc_id", "piece", (F.col("piece").cast("long") * window).alias("offset"), F.least(F.lit(window), F.col("n") - F.col("piece").cast("long") * window).cast("int").alias("length"))
    piece = piece.withColumn("bin", F.ceil(F.col("length") / grain).cast("int"))
    counts = {r["bin"]: r["n"] for r in piece.groupBy("bin").agg(F.count("*").alias("n")).collect()}  # at most window / grain rows
    spark = docs.sparkSession
    schema = "bin int, rank_from long, rank_to long, first_pack long, per_pack int, slot int"
    hist = np.zeros(size + 1, np.int64)
    for b, c in counts.items():
        hist[b] = c
    table = placement(plan(hist, size, depth)) if counts else pd.DataFrame(columns=["bin", "rank_from", "rank_to", "first_pack", "per_pack", "slot"])
    spans = spark.createDataFrame(list(table.itertuples(index=False, name=None)), schema)
    # two-level rank: rows of a length are spread over salts, and each salt starts where the one before it ends
    salts = {b: max(1, -(-c // rank_rows)) for b, c in counts.items()}
    per_bin = F.create_map(*[F.lit(x) for b in sorted(salts) for x in (b, salts[b])]) if salts else None
    salt = F.pmod(F.xxhash64("doc_id", "piece"), per_bin[F.col("bin")]) if salts else F.lit(0)
    piece = piece.withColumn("salt", salt.cast("int"))
    offsets = piece.groupBy("bin", "salt").agg(F.count("*").alias("m"))
    offsets = offsets.select("bin", "salt", (F.sum("m").over(Window.partitionBy("bin").orderBy("salt")) - F.col("m")).alias("before"))
    own = F.row_number().over(Window.partitionBy("bin", "salt").orderBy("doc_id", "piece", "length")) - 1
    ranked = piece.withColumn("own", own).join(offsets, ["bin", "salt"]).withColumn("rank", F.col("before") + F.col("own"))
    # the plan's table has at most (window / grain) ** 2 / 2 rows, whatever the corpus is
    placed = ranked.join(F.broadcast(spans), (ranked["bin"] == spans["bin"]) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    within = F.col("rank") - F.col("rank_from")
    return placed.select("doc_id", "piece", "offset", "length", (F.col("first_pack") + F.floor(within / F.col("per_pack"))).cast("long").alias("pack_id"), (F.col("slot") + within % F.col("per_pack")).cast("int").alias("slot"))
