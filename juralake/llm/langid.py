"""Language identification with hyperdimensional profiles.

Each letter has a random bipolar vector. A letter n-gram's vector is the
product of its letters' vectors, each permuted (rotated) by its place; a text is
the sum of its n-grams' vectors, a language the sum of its texts. A document
goes to the language whose prototype has the greatest cosine with it.

Bundling is linear, so prototypes come from n-gram counts over all labelled
documents: executors count, and what comes to the driver is bounded by
languages x letters**n, not by the corpus. Letters are what Unicode calls
letters, in lower case: a to z have a class each, all others share the
``CLASSES`` - 27 that remain (by code point); everything else (digits, signs,
quotes and stops of any script) is a boundary, and runs of boundaries are one.

Edge cases: null, empty and letterless texts get a null language and cosine, as
all do where no row has a label. Rows whose label is null don't train but are
classified; an empty table gives an empty result. Ties go to the language that
sorts first. Repeated rows count as often as they occur. Texts are read whole,
however long. Ids keep their type; columns other than the three named ones are
left alone, whatever their names.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kind, slices

N, DIM, CLASSES, SEED, BLOCK = 3, 1024, 40, 7, 512


@lru_cache(maxsize=4)
def letter_classes(classes: int = CLASSES) -> np.ndarray:
    """Class of every code point: 0 for what isn't a letter, a..z 1..26, other letters the rest by turns; upper and lower case agree."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for cp in range(len(out)):
        ch = chr(cp)
        if ch.isalpha():
            low = ord(ch.lower()[0])
            out[cp] = low - 96 if 97 <= low <= 122 else 27 + low % (classes - 27)
    return out


def codes(texts: pa.Array, n: int = N, classes: int = CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """n-gram codes of all texts and the text of each."""
    lower = pc.utf8_lower(pc.fill_null(texts, "")).to_pylist()
    cp = np.frombuffer("\n".join(lower).encode("utf-32-le"), np.uint32)
    size = np.array([len(t) for t in lower])
    doc = np.repeat(np.arange(len(lower)), size + 1)[: len(cp)]
    cls = letter_classes(classes)[cp].astype(np.int64)
    keep = np.ones(len(cls), bool)
    keep[1:] = (cls[1:] != 0) | (cls[:-1] != 0)
    cls, doc = cls[keep], doc[keep]
    if len(cls) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.zeros(len(cls) - n + 1, np.int64)
    for k in range(n):
        code = code * classes + cls[k : len(cls) - n + 1 + k]
    same = (doc[: len(code)] == doc[n - 1 :]) & (code != 0)
    return code[same], doc[: len(code)][same]


def gram_vectors(n: int = N, dim: int = DIM, classes: int = CLASSES, seed: int = SEED) -> np.ndarray:
    """int8 vectors of all classes**n n-grams: the product of the rotated letter vectors."""
    letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (classes, dim))
    out = letters
    for _ in range(n - 1):
        out = (np.roll(out, 1, axis=-1)[..., None, :] * letters).reshape(-1, dim)
    return out


def _count(n: int, classes: int):
    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch):
                code, doc = codes(part.column("text"), n, classes)
                langs = pc.dictionary_encode(part.column("lang"))
                which, names = np.asarray(langs.indices), langs.dictionary.to_pylist()
                both = np.bincount(which[doc] * classes**n + code, minlength=len(names) * classes**n).reshape(len(names), -1)
                for name, row in zip(names, both, strict=True):
                    total[name] = total.get(name, 0) + row
        for name, row in total.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(row[at].astype(np.int64))], ["lang", "code", "n"])

    return run


def prototypes(docs: DataFrame, n: int = N, dim: int = DIM, classes: int = CLASSES, seed: int = SEED, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages in order, and their unit prototype vectors, from all rows that have a language and a text."""
    d = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    rows = d.mapInArrow(_count(n, classes), "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    names = sorted(rows["lang"].unique())
    vectors = gram_vectors(n, dim, classes, seed)
    out = np.zeros((len(names), dim))
    for k, name in enumerate(names):
        own = rows[rows["lang"] == name]
        out[k] = own["n"].to_numpy(float) @ vectors[own["code"].to_numpy()].astype(np.float32)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return names, out / np.maximum(norm, 1e-12)


def cosines(texts: pa.Array, protos: np.ndarray, vectors: np.ndarray, n: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Cosine of each text with each prototype, and which texts have n-grams at all."""
    code, doc = codes(texts, n, classes)
    pair, count = np.unique(doc * classes**n + code, return_counts=True)
    doc, code = pair // classes**n, pair % classes**n
    bundle = np.zeros((len(texts), vectors.shape[1]), np.float32)
    for lo in range(0, len(texts), BLOCK):  # counts x vectors of the n-grams that occur, some texts at a time
        x, y = np.searchsorted(doc, [lo, lo + BLOCK])
        if x < y:
            seen, col = np.unique(code[x:y], return_inverse=True)
            table = np.zeros((min(BLOCK, len(texts) - lo), len(seen)), np.float32)
            table[doc[x:y] - lo, col] = count[x:y]
            bundle[lo : lo + BLOCK] = table @ vectors[seen].astype(np.float32)
    norm = np.linalg.norm(bundle, axis=1)
    return (bundle @ protos.T.astype(np.float32)) / np.maximum(norm, 1e-9)[:, None], norm > 0


def _classify(names, protos, n, dim, classes, seed):
    def run(batches):
        vectors = gram_vectors(n, dim, classes, seed)
        for batch in batches:
            for part in slices(batch):
                c, has = cosines(part.column("text"), protos, vectors, n, classes)
                best = np.argmax(c, axis=1)
                top = c[np.arange(len(c)), best]
                rest = np.sort(c, axis=1)[:, -2] if c.shape[1] > 1 else np.zeros(len(c))
                lang = pa.array([names[b] if h else None for b, h in zip(best, has, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lang, pa.array(np.round(top.astype(float), 6), mask=~has), pa.array(np.round((top - rest).astype(float), 6), mask=~has)], ["doc_id", "lang_pred", "cosine", "margin"])

    return run


def classify(docs: DataFrame, model: tuple[list[str], np.ndarray], n: int = N, dim: int = DIM, classes: int = CLASSES, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, cosine, margin (to the second language); a row for each row of docs, no shuffle."""
    names, protos = model
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if not names:
        return d.select("doc_id", F.lit(None).cast("string").alias("lang_pred"), F.lit(None).cast("double").alias("cosine"), F.lit(None).cast("double").alias("margin"))
    return d.mapInArrow(_classify(names, protos, n, dim, classes, seed), f"doc_id {kind(docs, id_col)}, lang_pred string, cosine double, margin double")
