"""MinHash near-duplicates with sequential Bayesian verification.

Texts become sets of hashed word n-grams (lower case, punctuation dropped).
Texts with the same set collapse first, so that thousands of copies cost one
signature. Banding proposes pairs; the signatures of a pair are compared batch
by batch, and it is pruned as soon as the posterior probability that its
similarity reaches the threshold falls below the chosen miss probability. What
survives is verified exactly on the full sets. Groups are the connected
components of the verified pairs.

Rows a band follow from ``hashes``, ``threshold`` and ``miss``: as many as still
let a pair at the threshold share a band with probability 1 - ``miss`` at least.
So each of the two steps that can lose a pair, banding and pruning, loses one at
the threshold with probability ``miss`` at most, and more alike ones less often.

Instead of all pairs of a bucket, each member is first compared with the
bucket's least member, and after that only members that still lie in different
components are compared with each other, all of them. Components are the same
as with all pairs, and a bucket of n near copies costs n comparisons. The second
round is dealt in blocks of ``BLOCK`` members: a task compares two blocks, however
many members their bucket has, and nothing is left out. A bucket of n texts that
are unlike each other costs n * n / 2 comparisons of 16 hashes.

Edge cases: a null id, and a null or wordless text, takes no part and is in no
group; an empty table gives no rows. A text of fewer words than the n-gram is one
n-gram; texts are compared whole, however long. Repeated rows (same id and text)
count as one document here; ``deduplicate`` keeps one of them, the first by all
its columns. Rows with one id and different texts are documents of their own.
Ties: of a group the document with the least id stays (then the least hash of the
text). Ids keep their type and order; columns other than id and text are left
alone, whatever their names.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, U64, Scratch, binary_rows, buffers, cut_lineage, fresh, i64, kind, mix, ragged, slices, small_or_shuffled, span_hash, words

NGRAM, HASHES, THRESHOLD, MISS, BATCH, BLOCK, PAIRS = 3, 128, 0.5, 0.005, 16, 1024, 1 << 18


def shingles(texts: pa.Array, ngram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word n-grams of all texts, in text order, and their number in each text."""
    import pyarrow.compute as pc

    data, off = buffers(pc.utf8_lower(texts))
    start, end, doc = words(data, off, ALNUM)
    n = np.bincount(doc, minlength=len(texts))
    h = span_hash(data, start, end)
    counts = np.where(n > 0, np.maximum(n - ngram + 1, 1), 0)
    first = np.repeat(np.cumsum(n) - n, counts) + ragged(counts)
    last = np.minimum(first + ngram, np.repeat(np.cumsum(n), counts))
    return span_hash(h, first, last), counts


@lru_cache
def _family(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    g = np.random.default_rng(20240229)
    return g.integers(1, 1 << 63, hashes, dtype=U64) * U64(2) + U64(1), g.integers(0, 1 << 63, hashes, dtype=U64)


def signatures(h: np.ndarray, counts: np.ndarray, hashes: int) -> np.ndarray:
    """MinHash signatures (32 bits a value) of the texts that have n-grams."""
    a, b = _family(hashes)
    start = (np.cumsum(counts) - counts)[counts > 0]
    out = np.empty((len(start), hashes), np.uint32)
    v = np.empty(len(h), U64)
    for k in range(hashes):
        np.multiply(h, a[k], out=v)
        np.add(v, b[k], out=v)
        out[:, k] = np.minimum.reduceat(v, start) >> U64(32)
    return out


def _sign(ngram: int, hashes: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                h, counts = shingles(part.column("text"), ngram)
                full = np.flatnonzero(counts)
                if not len(full):
                    continue
                # the set's fingerprint: sums over distinct n-grams
                owner = np.repeat(np.arange(len(counts)), counts)
                order = np.lexsort((h, owner))
                so, sh = owner[order], h[order]
                new = np.ones(len(sh), bool)
                new[1:] = (sh[1:] != sh[:-1]) | (so[1:] != so[:-1])
                so, sh = so[new], sh[new]
                size = np.bincount(so, minlength=len(counts))[full]
                first = np.cumsum(size) - size
                f1, f2 = np.add.reduceat(mix(sh), first), np.add.reduceat(mix(sh ^ U64(0xA5A5A5A5A5A5A5A5)), first)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(full)), part.column("row_key").take(pa.array(full)), i64(f1), i64(f2), binary_rows(signatures(sh, np.bincount(so, minlength=len(counts)), hashes))], ["doc_id", "row_key", "f1", "f2", "sig"])

    return run


def signature_table(docs: DataFrame, ngram: int = NGRAM, hashes: int = HASHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_key (hash of the text), f1, f2 (fingerprint of the n-gram set), sig; only texts that have words."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    return d.withColumn("row_key", F.xxhash64("text")).mapInArrow(_sign(ngram, hashes), f"doc_id {kind(docs, id_col)}, row_key long, f1 long, f2 long, sig binary")


def band_rows(hashes: int, threshold: float, miss: float) -> int:
    """The most rows a band at which a pair at the threshold shares none with probability ``miss`` at most."""
    fit = [r for r in range(1, hashes + 1) if (1 - threshold**r) ** (hashes // r) <= miss]
    if not fit:
        raise ValueError(f"{hashes} hashes are too few for a miss probability of {miss} at {threshold}")
    return max(fit)


def _bands(rows: int):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(b.num_rows, -1)
            bands = sig.shape[1] // rows
            key = np.zeros((len(sig), bands), U64)
            for r in range(rows):
                key = mix(key * U64(0x9E3779B97F4A7C15) + sig[:, r : bands * rows : rows].astype(U64) + U64(1))
            key = mix(key + np.arange(bands, dtype=U64))
            ids = np.repeat(np.asarray(b.column("rep")), bands)
            yield pa.RecordBatch.from_arrays([i64(key.ravel()), pa.array(ids)], ["key", "rep"])

    return run


def least_matches(n: int, threshold: float, miss: float) -> int:
    """Of n compared hashes, the fewest matches m at which P(similarity >= threshold | m of n) under a uniform prior is still at least ``miss``.

    The posterior is Beta(m+1, n-m+1); its upper tail at t is P(Binomial(n+1, t) <= m).
    """
    tail, m = 0.0, 0
    while m <= n:
        tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= miss:
            return m
        m += 1
    return n


def _prune(hashes: int, threshold: float, miss: float, batch: int):
    ends = [*range(batch, hashes, batch), hashes]
    bound = [least_matches(n, threshold, miss) for n in ends]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(b.num_rows, -1) for c in ("sig_a", "sig_b"))
            alive, matches, lo = np.arange(b.num_rows), np.zeros(b.num_rows, np.int64), 0
            for hi, least in zip(ends, bound, strict=True):
                matches[alive] += (left[alive, lo:hi] == right[alive, lo:hi]).sum(axis=1)
                alive, lo = alive[matches[alive] >= least], hi
            yield b.select(["a", "b"]).take(pa.array(alive))

    return run


def _exact(ngram: int, threshold: float):
    def sets(texts: pa.Array) -> list[np.ndarray]:
        h, counts = shingles(texts, ngram)
        cuts = np.cumsum(counts)[:-1]
        return [np.unique(x) for x in np.split(h, cuts)]

    def run(batches):
        for batch in batches:
            for b in slices(batch, "text_a"):
                out = []
                for x, y in zip(sets(b.column("text_a")), sets(b.column("text_b")), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    out.append(both / max(1, len(x) + len(y) - both))
                keep = pa.array(np.flatnonzero(np.array(out) >= threshold))
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(out, pa.float64())], ["a", "b", "jaccard"]).take(keep)

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for all nodes of edges(a, b): labels spread to neighbours and jump along themselves until none changes."""
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y")))
    both = cut_lineage(both.where("x <> y").distinct())
    label = cut_lineage(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        near = both.join(label.select(F.col("node").alias("y"), F.col("root").alias("other")), "y").groupBy(F.col("x").alias("node")).agg(F.min("other").alias("other"))
        step = label.join(near, "node", "left").select("node", F.col("root").alias("old"), F.least("root", "other").alias("root"))
        jump = label.select(F.col("node").alias("root"), F.col("root").alias("far"))
        step = cut_lineage(step.join(jump, "root", "left").select("node", "old", F.least("root", "far").alias("root")))
        changed = not step.where("old <> root").isEmpty()
        label = step.select("node", "root")
        if not changed:
            return label


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), -1)


def block_pairs(group: np.ndarray, side: np.ndarray, root: np.ndarray, sig: np.ndarray, ends: list[int], bound: list[int], pairs: int = PAIRS):
    """Places (a, b) of the pairs that survive pruning, ``pairs`` candidates at a time. Rows are sorted by group and side; a group with one side is compared with itself, one with two sides across. Equal roots aren't compared."""
    n = len(group)
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(start, n))
    first, last = np.repeat(start, size), np.repeat(start + size, size)
    ones = np.add.reduceat((side == 1).astype(np.int64), start).repeat(size)
    across = ones > 0
    begin = np.where(across, last - ones, np.arange(n) + 1)
    count = np.where(across & (side == 1), 0, last - begin)
    total = np.concatenate([[0], np.cumsum(count)])
    for lo in range(0, int(total[-1]), pairs):  # a row's partners may go on in the next run
        k = np.arange(lo, min(lo + pairs, total[-1]))
        a = np.searchsorted(total, k, "right") - 1
        b = begin[a] + k - total[a]
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
        matches, at = np.zeros(len(a), np.int64), 0
        for hi, least in zip(ends, bound, strict=True):
            matches += (sig[a, at:hi] == sig[b, at:hi]).sum(axis=1)
            keep = matches >= least
            a, b, matches, at = a[keep], b[keep], matches[keep], hi
        yield a, b


def _compare(hashes: int, threshold: float, miss: float, batch: int):
    ends = [*range(batch, hashes, batch), hashes]
    bound = [least_matches(n, threshold, miss) for n in ends]

    def pairs(t: pa.Table):
        key = [np.asarray(t.column(c)) for c in ("key", "lo", "hi")]
        new = np.concatenate([[False], np.any([x[1:] != x[:-1] for x in key], axis=0)])
        rep = np.asarray(t.column("rep"))
        for a, b in block_pairs(np.cumsum(new), np.asarray(t.column("side")), np.asarray(t.column("root")), _signatures(t.column("sig")), ends, bound):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[a], rep[b])), pa.array(np.maximum(rep[a], rep[b]))], ["a", "b"])

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            if not t.num_rows:
                continue
            other = np.flatnonzero(np.any([np.asarray(t.column(c)) != t.column(c)[-1].as_py() for c in ("key", "lo", "hi")], axis=0))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield from pairs(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None and held.num_rows:
            yield from pairs(held)

    return run


def _groups(s: Scratch, docs: DataFrame, ngram: int, hashes: int, threshold: float, miss: float, batch: int, block: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """near_duplicate_groups, and doc_id, row_key of rows that repeat; both cut from the scratch tables."""
    rows = band_rows(hashes, threshold, miss)
    # a representative is named by a key of its own, so that ids which repeat with other texts do no harm
    sigs = s.keep(signature_table(docs, ngram, hashes, id_col, text_col).withColumn("rep", F.xxhash64("f1", "f2")).drop("f1", "f2"))
    members = s.keep(sigs.groupBy("rep", "doc_id", "row_key").agg(F.count("*").alias("copies")))
    reps = s.keep(sigs.groupBy("rep").agg(F.min(F.struct("doc_id", "row_key", "sig")).alias("m")).select("rep", "m.*"))
    s.free(sigs)

    # only buckets of two or more go on
    bands = reps.select("rep", "sig").mapInArrow(_bands(rows), "key long, rep long")
    heads = s.keep(bands.groupBy("key").agg(F.min("rep").alias("head"), F.max("rep").alias("tail")).where("head <> tail").select("key", "head"))
    found = s.keep(bands.join(small_or_shuffled(heads, 16), "key").select("key", "rep", "head"))
    s.free(heads)

    def verified(pairs: DataFrame) -> DataFrame:
        """a, b, jaccard of the pairs that reach the threshold on their whole texts."""
        ids = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
        named = s.keep(ids.join(reps.select("rep", F.col("doc_id").alias("i"), F.col("row_key").alias("k")), "rep"))
        d = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("text")).withColumn("k", F.xxhash64("text"))
        texts = s.keep(d.join(small_or_shuffled(named, 48), ["i", "k"]).select("rep", "text").dropDuplicates(["rep"]))
        side = lambda x: texts.select(F.col("rep").alias(x), F.col("text").alias(f"text_{x}"))
        out = s.keep(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_exact(ngram, threshold), "a long, b long, jaccard double"))
        s.free(named, texts)
        return out

    star = found.where("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("sig").alias(f"sig_{x}"))
    edges = verified(s.keep(star.join(side("a"), "a").join(side("b"), "b").mapInArrow(_prune(hashes, threshold, miss, batch), "a long, b long")))
    label = components(edges)

    # second round: members of a bucket that lie in different components, in blocks; the head was compared with all
    root = F.coalesce("root", "rep").alias("root")
    placed = s.keep(found.where("rep <> head").join(label.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", root))
    mixed = s.keep(placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    rest = placed.join(small_or_shuffled(mixed, 16), "key").join(reps.select("rep", "sig"), "rep")
    rest = rest.withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"), "rep", "root", "sig")
    rest = rest.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "side").mapInArrow(_compare(hashes, threshold, miss, batch), "a long, b long")
    alive = s.keep(rest.distinct())
    if not alive.isEmpty():
        more = verified(alive)
        # the components' roots are the nodes now
        at = lambda x: label.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
        across = more.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
        joined = components(across).select(F.col("node").alias("root"), F.col("root").alias("top"))
        nodes = label.unionByName(more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(label, "node", "left_anti").select("node", F.col("node").alias("root")))
        label = cut_lineage(nodes.join(joined, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
        edges = edges.unionByName(more)

    grouped = s.keep(members.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "doc_id", "row_key", root))
    keep = grouped.groupBy("root").agg(F.min(F.struct("doc_id", "row_key", "rep")).alias("keep"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = edges.select("a", "b", "jaccard").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "jaccard"))
    out = grouped.join(keep, "root").where("doc_id <> keep.doc_id or row_key <> keep.row_key")
    out = out.select("doc_id", "row_key", "rep", F.col("keep.doc_id").alias("group_id"), F.col("keep.rep").alias("keep_rep"))
    out = out.join(pairs.select(F.col("a").alias("rep"), F.col("b").alias("keep_rep"), "jaccard"), ["rep", "keep_rep"], "left")
    out = out.select("doc_id", "row_key", "group_id", F.when(F.col("rep") == F.col("keep_rep"), 1.0).otherwise(F.col("jaccard")).alias("jaccard"))
    return cut_lineage(out), cut_lineage(members.where("copies > 1").select("doc_id", "row_key"))


def near_duplicate_groups(docs: DataFrame, ngram: int = NGRAM, hashes: int = HASHES, threshold: float = THRESHOLD, miss: float = MISS, batch: int = BATCH, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents that lie in a group of more than one: doc_id, row_key, group_id (least doc_id, which stays), jaccard with it where that pair was verified (1.0 for the same n-gram set).

    One row for each document but the group's first. See the module's text for edge cases.
    """
    with Scratch(docs.sparkSession, "near-duplicates") as s:
        return _groups(s, docs, ngram, hashes, threshold, miss, batch, block, id_col, text_col)[0]


def deduplicate(docs: DataFrame, ngram: int = NGRAM, hashes: int = HASHES, threshold: float = THRESHOLD, miss: float = MISS, batch: int = BATCH, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without all but the first of each group. Of rows that repeat an id and text one stays; null ids and null or wordless texts stay."""
    with Scratch(docs.sparkSession, "near-duplicates") as s:
        gone, twice = _groups(s, docs, ngram, hashes, threshold, miss, batch, block, id_col, text_col)
    i, k, what, n = fresh(docs, "gone_id", "gone_key", "gone_mark", "gone_place")
    mark = lambda d, x: d.select(F.col("doc_id").alias(i), F.col("row_key").alias(k), F.lit(x).alias(what))
    marks = cut_lineage(mark(gone, 0).unionByName(mark(twice.join(gone, ["doc_id", "row_key"], "left_anti"), 1)).distinct())
    marked = docs.join(small_or_shuffled(marks, 40), (F.col(id_col) == F.col(i)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(k)), "left")
    kept = marked.where(F.col(what).isNull()).select(docs.columns)
    if twice.isEmpty():
        return kept
    from pyspark.sql import Window

    # of equal ids and texts the first by all columns
    again = marked.where(F.col(what) == 1).withColumn(n, F.row_number().over(Window.partitionBy(i, k).orderBy(F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns))))))
    return kept.unionByName(again.where(F.col(n) == 1).select(docs.columns))
