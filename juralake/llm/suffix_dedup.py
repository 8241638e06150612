"""Sparse suffix arrays: passages of at least ``LENGTH`` words that occur twice or more.

A suffix is kept only where its word k-mer is the minimiser of W neighbouring
k-mers, a choice that depends on content alone: two copies of a passage keep the
same suffixes. Any LENGTH words contain a kept suffix whose first
LENGTH - W + 1 words lie inside them, so suffixes are sorted by (a fingerprint
of) that prefix, and neighbours with the same prefix are matches to extend.
Extension goes left over the words between the previous kept suffix and this
one, and right to the full LENGTH: a kept suffix carries one hash for each
window of LENGTH words that it stands for, and a window whose hash recurs among
the neighbours is a repeat. The result is exact: a word is in a repeat if and
only if it lies in a window of LENGTH words that occurs at two places of the
corpus (up to collisions of 64-bit prefix and 32-bit window hashes).

Words are runs of non-white-space, compared byte for byte. The first place (by
document id, then position) of each repeated window stays; a word is cut when a
window over it is a later copy and no window over it is a first one, so each
repeated window stays whole at its first place.

Edge cases: null ids, null texts and texts of fewer than LENGTH words have no
repeats and stay as they are; an empty table gives an empty one. Texts are read
whole, however long. Repeats within one text count. Rows that repeat an id and
text are copies of each other for ``repeats``; ``remove`` treats all rows of one
id and text alike, keeping what the first keeps. Of places with equal ids and
positions the one with the least hash of its text is first. A text of which
nothing is left is dropped. Ids keep their type and order; ``remove`` returns all
columns of its input, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NONSPACE, U64, buffers, fresh, i64, kind, ragged, slices, span_hash, words

LENGTH, KMER, WINDOW = 50, 5, 40
_POS = 22


def _running(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum of x[i:i+width] (least) or maximum, by doubling; the array's end counts as far as it goes."""
    op, done, out = np.minimum if least else np.maximum, 1, x.copy()
    while done < width:
        step = min(done, width - done)
        out[:-step] = op(out[:-step], out[step:])
        done += step
    return out


def suffixes(texts: pa.Array, length: int, kmer: int, window: int):
    """Kept suffixes of all texts: text, first window (a word number in its text), prefix fingerprint, number of windows, and their 32-bit hashes one after the other."""
    data, off = buffers(texts)
    start, end, doc = words(data, off, NONSPACE)
    n = len(start)
    number = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(number) - number
    windows = np.maximum(number - length + 1, 0)
    s = np.repeat(first, windows) + ragged(windows)  # every window's first word
    if not len(s):
        e = np.zeros(0, np.int64)
        return e, e, e.astype(U64), e, e.astype(np.uint32)
    assert n < 1 << _POS or len(texts) == 1
    bits = max(_POS, int(n).bit_length())
    h = span_hash(data, start, end)
    i = np.arange(n)
    k = span_hash(h, i, np.minimum(i + kmer, n))
    low = U64((1 << bits) - 1)
    least = _running((k & ~low) | i.astype(U64), window, True)
    at = (least[s] & low).astype(np.int64)  # the leftmost minimiser of each window
    new = np.ones(len(s), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[s[1:]] != doc[s[:-1]])
    p, lead = at[new], np.flatnonzero(new)
    counts = np.diff(np.append(lead, len(s)))
    prefix = span_hash(h, p, p + length - window + 1)
    whole = (span_hash(h, s, s + length) >> U64(32)).astype(np.uint32)
    owner = doc[s[lead]]
    return owner, s[lead] - first[owner], prefix, counts, whole


def _emit(length: int, kmer: int, window: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                owner, lead, prefix, counts, whole = suffixes(part.column("text"), length, kmer, window)
                if len(owner):
                    off = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32) * 4
                    hashes = pa.Array.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(off), pa.py_buffer(whole)])
                    at = pa.array(owner)
                    yield pa.RecordBatch.from_arrays([i64(prefix), part.column("doc_id").take(at), part.column("row_key").take(at), pa.array(lead.astype(np.int32)), hashes], ["prefix", "doc_id", "row_key", "lead", "hashes"])

    return run


def _mark(prefix, hashes):
    """For rows sorted by (prefix, doc, lead): per window, whether its hash recurs under its prefix, and whether this is the first place."""
    counts = np.array([len(x) for x in hashes]) // 4
    value = np.frombuffer(b"".join(hashes), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    group = np.cumsum(np.concatenate([[0], prefix[1:] != prefix[:-1]]))[row]
    order = np.lexsort((row, value, group))  # stable in rows, hence in (doc, lead)
    g, v = group[order], value[order]
    same = np.zeros(len(order), bool)
    same[1:] = (g[1:] == g[:-1]) & (v[1:] == v[:-1])
    follows = np.zeros(len(order), bool)
    follows[:-1] = same[1:]
    later, first = np.zeros(len(order), bool), np.zeros(len(order), bool)
    later[order], first[order] = same, follows & ~same
    return row, counts, first, later


def _runs(row, counts, lead, flag):
    """Maximal runs of flagged windows in each row: row, first window, number."""
    if not flag.any():
        e = np.zeros(0, np.int64)
        return e, e, e
    pos = ragged(counts)
    edge = np.concatenate([[False], flag[:-1]]) & (pos > 0)
    begin = np.flatnonzero(flag & ~edge)
    nxt = np.concatenate([flag[1:], [False]]) & np.concatenate([pos[1:] > 0, [False]])
    stop = np.flatnonzero(flag & ~nxt)
    return row[begin], lead[row[begin]] + pos[begin], stop - begin + 1


def _extend(batches):
    """Compares and extends neighbours. Rows come sorted by prefix; a prefix that goes on in the next batch is carried over."""
    held = None

    def out(t):
        prefix, lead = (np.asarray(t.column(c)) for c in ("prefix", "lead"))
        row, counts, first, later = _mark(prefix, t.column("hashes").to_pylist())
        parts = [(_runs(row, counts, lead, f), k) for f, k in ((first, True), (later, False))]
        at = np.concatenate([p[0][0] for p in parts])
        doc, key = (t.column(c).combine_chunks().take(pa.array(at)) for c in ("doc_id", "row_key"))
        return pa.RecordBatch.from_arrays([doc, key, pa.array(np.concatenate([p[0][1] for p in parts]).astype(np.int32)), pa.array(np.concatenate([p[0][2] for p in parts]).astype(np.int32)), pa.array(np.concatenate([np.full(len(p[0][0]), p[1]) for p in parts]))], ["doc_id", "row_key", "lead", "n", "is_first"])

    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
        if not t.num_rows:
            continue
        prefix = np.asarray(t.column("prefix"))
        other = np.flatnonzero(prefix != prefix[-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield out(t.slice(0, cut))
        held = t.slice(cut)
    if held is not None and held.num_rows:
        yield out(held)


def _spans(length: int):
    """Per document, word spans of repeats and of what is to be cut, from runs of windows."""

    def covered(lead, n, size):
        step = np.zeros(size + 1, np.int32)
        np.add.at(step, lead, 1)
        np.add.at(step, lead + n + length - 1, -1)
        return np.cumsum(step)[:-1] > 0

    def edges(mask):
        step = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
        return list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True))

    def run(batches):
        for b in batches:
            rep, cut = [], []
            for runs in b.column("runs").to_pylist():
                lead, n = np.array([r["lead"] for r in runs]), np.array([r["n"] for r in runs])
                first = np.array([r["is_first"] for r in runs])
                size = int((lead + n).max()) + length - 1
                stay, later = covered(lead[first], n[first], size), covered(lead[~first], n[~first], size)
                rep.append(edges(stay | later))
                cut.append(edges(later & ~stay))
            spans = pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32())]))
            rows = lambda x: pa.array([[{"first_word": a, "end_word": e} for a, e in r] for r in x], spans)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_key"), rows(rep), rows(cut)], ["doc_id", "row_key", "repeats", "cuts"])

    return run


def repeat_spans(docs: DataFrame, length: int = LENGTH, kmer: int = KMER, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_key (hash of the text), repeats and cuts (arrays of word spans [first_word, end_word)) of every document that holds a repeated passage."""
    if window + kmer - 1 > length:
        raise ValueError("window + kmer - 1 must not exceed length: else a passage might hold no kept suffix")
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null").withColumn("row_key", F.xxhash64("text"))
    s = d.mapInArrow(_emit(length, kmer, window), f"prefix long, doc_id {kind(docs, id_col)}, row_key long, lead int, hashes binary")
    from pyspark.sql import Window

    # neighbours: a suffix goes on only if the one before or after it in sorted order has the same prefix
    w = Window.partitionBy("prefix").orderBy("doc_id", "lead", "row_key")
    s = s.withColumn("before", F.lag("lead").over(w)).withColumn("after", F.lead("lead").over(w)).where("before is not null or after is not null").drop("before", "after")
    runs = s.mapInArrow(_extend, f"doc_id {kind(docs, id_col)}, row_key long, lead int, n int, is_first boolean")
    per_doc = runs.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("lead", "n", "is_first")).alias("runs"))
    spans = "array<struct<first_word:int,end_word:int>>"
    return per_doc.mapInArrow(_spans(length), f"doc_id {kind(docs, id_col)}, row_key long, repeats {spans}, cuts {spans}")


def repeats(docs: DataFrame, **params) -> DataFrame:
    """One row for each repeated passage of a document: doc_id, first_word, end_word (exclusive), n_words, n_cut (of them, words that ``remove`` would cut)."""
    s = repeat_spans(docs, **params)
    one = s.select("doc_id", F.explode("repeats").alias("r"), "cuts").select("doc_id", "r.first_word", "r.end_word", "cuts")
    inside = F.expr("aggregate(cuts, 0, (s, c) -> s + greatest(0, least(c.end_word, end_word) - greatest(c.first_word, first_word)))")
    return one.select("doc_id", "first_word", "end_word", (F.col("end_word") - F.col("first_word")).alias("n_words"), inside.alias("n_cut"))


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and the white space before each."""
    raw = np.frombuffer(text.encode(), np.uint8)
    start, end, _ = words(raw, np.array([0, len(raw)]), NONSPACE)
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : end[a - 1] if a else 0].tobytes())
        at = int(end[b - 1])
    out.append(raw[at:].tobytes())
    return b"".join(out).decode()


def _cut(texts, spans):
    return pd.Series([t if s is None or len(s) == 0 else cut_words(t, [(int(x["first_word"]), int(x["end_word"])) for x in s]) for t, s in zip(texts, spans, strict=True)], dtype=object)


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", **params) -> DataFrame:
    """docs without later copies of repeated passages; ``chars_col``, if there is one, follows the shortened texts. Texts of which only white space is left are dropped."""
    i, k, cuts, new_text = fresh(docs, "cut_id", "cut_key", "cut_spans", "cut_text")
    spans = repeat_spans(docs, id_col=id_col, text_col=text_col, **params).where("size(cuts) > 0").select(F.col("doc_id").alias(i), F.col("row_key").alias(k), F.col("cuts").alias(cuts))

    def shorten(t: pd.Series, s: pd.Series) -> pd.Series:
        return _cut(t, s)

    # "nondeterministic" keeps the optimiser from running it once for the filter and once for the result
    shorten = F.pandas_udf(shorten, "string").asNondeterministic()
    text = F.col(text_col).cast("string")
    joined = docs.join(spans, (F.col(id_col) == F.col(i)) & (F.xxhash64(text) == F.col(k)), "left")
    whole = F.col(cuts).isNull()
    # texts without cuts don't go to Python: for them the function gets nulls
    short = joined.withColumn(new_text, shorten(F.when(~whole, text), F.col(cuts)))
    short = short.withColumn(new_text, F.when(whole, text).otherwise(F.col(new_text)))
    short = short.where(whole | (F.regexp_replace(new_text, r"\s+", "") != ""))
    new = {text_col: F.col(new_text)}
    if chars_col and chars_col in docs.columns:
        new[chars_col] = F.when(whole, F.col(chars_col)).otherwise(F.length(new_text).cast(docs.schema[chars_col].dataType))
    return short.withColumns(new).select(docs.columns)
