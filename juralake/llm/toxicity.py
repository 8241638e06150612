"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of
its words' weights; a leaky noisy-or combines the sentences to the document's
probability, and the weights are trained from document labels alone. The leak
takes up labels that no sentence explains, so the bias needn't; it is left out
when documents are judged. So is the bias's own share of every sentence, and a
document is judged by its strongest passage of at most ``PASSAGE`` sentences:
length alone, or faint words spread over a long clean text, make nothing toxic.
The same weights then point at the sentences.

Training uses at most ``max_train`` labelled documents (those with the least
hash of their id, repeated texts once); scoring covers every document and every
byte of it.

Edge cases: null or empty texts score 0 and are never toxic; null ids are
scored like others; a label table without rows of both classes gives a model
that calls nothing toxic; an empty table gives no rows. Repeated rows are scored
one by one; of ids labelled twice the worse label counts, and ids of equal hash
train in their own order. Ids keep their type (labels are found by the id as
text); ``reject`` returns all columns of its input, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, U64, buffers, kind, list_rows, slices, span_hash, words
from .minhash import shingles, signatures

BITS, MAX_TRAIN, MIN_G2, THRESHOLD, SENTENCE, STEM, PASSAGE = 21, 4000, 20.0, 0.5, 0.5, 4, 256
_END = np.zeros(256, bool)
_END[list(b".!?\n")] = True


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two slots of each word, sentence of each word, document of each sentence, and byte span of each sentence (from its first word to its last) in its lower-cased text."""
    data, off = buffers(pc.utf8_lower(texts))
    start, end, doc = words(data, off, ALNUM)
    # each word twice: whole, and its first bytes, which inflected forms share
    whole, stem = (span_hash(data, start, e) >> U64(65 - bits) for e in (end, np.minimum(end, start + STEM)))
    slot = np.stack([whole, stem + U64(1 << (bits - 1))], axis=1).astype(np.int64)
    stops = np.cumsum(_END[data])
    new = np.ones(len(start), bool)
    if len(start):
        new[1:] = (stops[start[1:]] != stops[start[:-1]]) | (doc[1:] != doc[:-1])
    sentence = np.cumsum(new) - 1
    last = np.ones(len(start), bool)
    last[:-1] = new[1:]
    owner = doc[new]
    return slot, sentence, owner, start[new] - off[owner], end[last] - off[owner]


def _log_none(score: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
    """Per document, the log of the probability that no sentence is toxic."""
    return -np.bincount(owner, np.logaddexp(0, score), docs)


def _passage(evidence: np.ndarray, owner: np.ndarray, docs: int, length: int = PASSAGE) -> np.ndarray:
    """Per document, the greatest sum of evidence over ``length`` consecutive sentences."""
    total = np.concatenate([[0.0], np.cumsum(evidence)])
    end = np.cumsum(np.bincount(owner, minlength=docs))
    here = total[np.minimum(np.arange(len(owner)) + length, end[owner])] - total[:-1]
    most = np.zeros(docs)
    np.maximum.at(most, owner, here)
    return most


def _g2(k: np.ndarray, n: np.ndarray, bad: int, docs: int) -> np.ndarray:
    """Log-likelihood ratio of the 2 x 2 tables word (k of n documents are toxic) by label (bad of docs)."""
    cells = ((k, n, bad), (n - k, n, docs - bad), (bad - k, docs - n, bad), (docs - n - bad + k, docs - n, docs - bad))
    return 2 * sum(np.where(o > 0, o * np.log(np.maximum(o, 1) * docs / np.maximum(r * float(c), 1e-9)), 0.0) for o, r, c in cells)


def first_of_copies(texts: pa.Array, ngram: int = 3, hashes: int = 64, rows: int = 4) -> np.ndarray:
    """Of the training texts, one of each group of near copies (those with an equal band of MinHashes): copies of one label are no independent evidence."""
    group = np.arange(len(texts))
    at, sigs = [], []
    batch, base = pa.RecordBatch.from_arrays([texts], ["text"]), 0
    for p in slices(batch):
        h, counts = shingles(p.column("text"), ngram)
        if len(h):
            at.append(np.flatnonzero(counts) + base)
            sigs.append(signatures(h, counts, hashes))
        base += p.num_rows
    if not at:
        return group
    at, sigs = np.concatenate(at), np.concatenate(sigs)
    changed = True
    while changed:  # labels spread over equal bands until none gets less
        before = group.copy()
        for k in range(0, hashes, rows):
            _, band = np.unique(sigs[:, k : k + rows], axis=0, return_inverse=True)
            least = np.full(band.max() + 1, len(group))
            np.minimum.at(least, band, group[at])
            group[at] = np.minimum(group[at], least[band])
        changed = bool((group != before).any())
    return np.flatnonzero(group == np.arange(len(group)))


def loss_and_slopes(w: np.ndarray, b: float, row: np.ndarray, col: np.ndarray, owner: np.ndarray, y: np.ndarray, leak: float, l2: float) -> tuple[float, np.ndarray, float]:
    """Mean loss of the leaky noisy-or over documents with labels y, with a pull of the weights to 0 and of the bias to -6, and its slopes. Word occurrences: sentence ``row``, word ``col``; ``owner``: document of each sentence."""
    docs = len(y)
    score = np.clip(np.bincount(row, w[col], len(owner)) + b, -30, 30)
    none = _log_none(score, owner, docs) + np.log1p(-leak)
    p = np.clip(-np.expm1(none), 1e-9, 1 - 1e-9)
    # d loss / d log(none): with p = 1 - none
    g_doc = np.where(y > 0, (1 - p) / p, -1.0)
    g = g_doc[owner] * (1 / (1 + np.exp(-score))) * -1.0 / docs
    value = -np.where(y > 0, np.log(p), none).mean() + l2 * (w @ w) / 2 + 1e-4 * (b + 6.0) ** 2 / 2
    return float(value), np.bincount(col, g[row], len(w)) + l2 * w, float(g.sum() + 1e-4 * (b + 6.0))


def train(texts: pa.Array, labels: np.ndarray, bits: int = BITS, min_g2: float = MIN_G2, rounds: int = 300, leak: float = 0.05, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """Slots with a weight, their weights, and the bias. 

    A word gets a weight if its presence in documents depends on the label with a log-likelihood ratio of at least
    ``min_g2`` (20: about one word in 100,000 by chance), so that chance words of few documents explain no label.
    Full-batch Adam maximises the leaky noisy-or's likelihood.
    """
    first = first_of_copies(texts)
    texts, labels = texts.take(pa.array(first)), labels[first]
    if len(labels) == 0 or labels.min() == labels.max():
        return np.zeros(0, np.int64), np.zeros(0), -30.0
    batch, docs, bad = pa.RecordBatch.from_arrays([texts], ["text"]), len(texts), int((labels > 0).sum())
    n, k, base = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32), 0
    for p in slices(batch):  # in how many documents, and toxic ones, each word is
        slot, sentence, owner, *_ = features(p.column("text"), bits)
        pair = np.unique(slot.ravel() * p.num_rows + np.repeat(owner[sentence], 2))
        word, toxic = pair // p.num_rows, labels[base + pair % p.num_rows] > 0
        np.add.at(n, word, 1)
        np.add.at(k, word[toxic], 1)
        base += p.num_rows
    names = np.flatnonzero(n)
    names = names[_g2(k[names].astype(float), n[names].astype(float), bad, docs) >= min_g2]
    place = np.full(1 << bits, -1, np.int32)
    place[names] = np.arange(len(names))
    parts, base, sentences = [], 0, 0
    for p in slices(batch):  # only the chosen words' occurrences are kept
        slot, sentence, owner, *_ = features(p.column("text"), bits)
        at = place[slot.ravel()]
        parts.append((at[at >= 0], np.repeat(sentence, 2)[at >= 0] + sentences, owner + base))
        base, sentences = base + p.num_rows, sentences + len(owner)
    col, row, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
    y = labels.astype(float)
    w, b = np.zeros(len(names)), -6.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        _, gw, gb = loss_and_slopes(w, b, row, col, owner, y, leak, l2)
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        rate = 0.1
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-6)
    held = np.flatnonzero(w)
    return names[held], w[held], float(b)


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text", **params) -> tuple[np.ndarray, np.ndarray, float]:
    """The model from at most ``max_train`` labelled documents: least hash of the id first."""
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").alias("__toxic"))
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id").limit(max_train).select(F.col("__id").cast("string").alias("__key"), "__toxic")
    rows = docs.select(F.col(id_col).alias("__id"), F.col(id_col).cast("string").alias("__key"), F.col(text_col).cast("string").alias("__text")).join(F.broadcast(chosen), "__key").where("__text is not null")
    # at most max_train texts come here, whatever the corpus is
    rows = rows.groupBy("__text").agg(F.max("__toxic").alias("__toxic"), F.min("__id").alias("__id")).orderBy("__id").select("__text", "__toxic").toArrow()
    return train(rows.column("__text").combine_chunks(), np.asarray(rows.column("__toxic")).astype(np.int64), **params)


def judge(texts: pa.Array, table: np.ndarray, bias: float, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Probability of each document; of each sentence its document, probability and byte span."""
    slot, sentence, owner, lo, hi = features(texts, bits)
    score = np.bincount(sentence, table[slot].sum(axis=1), len(owner)) + bias
    evidence = np.maximum(np.logaddexp(0, score) - np.logaddexp(0, bias), 0)
    p = -np.expm1(-_passage(evidence, owner, len(texts)))
    return p, owner, 1 / (1 + np.exp(-np.clip(score, -60, 60))), lo, hi


def _score(model, bits: int, threshold: float, sentence: float):
    names, weights, bias = model
    OUT = pa.list_(pa.struct([("sentence", pa.int32()), ("byte_start", pa.int32()), ("byte_end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        table = np.zeros(1 << bits, np.float32)
        table[names] = weights
        for batch in batches:
            for part in slices(batch):
                p, owner, s, lo, hi = judge(part.column("text"), table, bias, bits)
                number = np.arange(len(owner)) - (np.searchsorted(owner, np.arange(len(p))))[owner] if len(owner) else owner
                bad = np.flatnonzero((s >= sentence) & (p[owner] >= threshold)) if len(owner) else owner
                value = pa.StructArray.from_arrays([pa.array(number[bad].astype(np.int32)), pa.array(lo[bad].astype(np.int32)), pa.array(hi[bad].astype(np.int32)), pa.array(np.round(s[bad], 6))], fields=list(OUT.value_type))
                found = list_rows(value, np.bincount(owner[bad], minlength=len(p)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names if c != "text"), pa.array(p), pa.array(p >= threshold), found.cast(OUT)], [*(c for c in part.schema.names if c != "text"), "p_toxic", "is_toxic", "sentences"])

    return run


_SCHEMA = "p_toxic double, is_toxic boolean, sentences array<struct<sentence:int,byte_start:int,byte_end:int,score:double>>"


def score(docs: DataFrame, model, bits: int = BITS, threshold: float = THRESHOLD, sentence: float = SENTENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, p_toxic, is_toxic, and of toxic documents the offending sentences (number, byte span in the lower-cased text, score). One row for each row of docs; no shuffle."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(_score(model, bits, threshold, sentence), f"doc_id {kind(docs, id_col)}, {_SCHEMA}")


def _keep(model, bits: int, threshold: float, text_col: str):
    names, weights, bias = model

    def run(batches):
        table = np.zeros(1 << bits, np.float32)
        table[names] = weights
        for batch in batches:
            at = batch.schema.names.index(text_col)
            for part in slices(batch, text_col):
                p = judge(pc.cast(part.column(at), pa.string()), table, bias, bits)[0]
                yield part.filter(pa.array(p < threshold))

    return run


def reject(docs: DataFrame, model, bits: int = BITS, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents that aren't toxic, with all their columns, in one pass without a shuffle."""
    return docs.mapInArrow(_keep(model, bits, threshold, text_col), docs.schema)
