"""Each operator against a brute-force version, and on messy and empty tables."""

import itertools
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from juralake.llm import bestfit, decontam, html_template, langid, media, minhash, nnls_pack, queries, suffix_dedup, toxicity, url_rules
from tests.llm.conftest import SCHEMA, words
from tests.oracle import check

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    check(spark, SF, queries.queries()[name], queries.oracle_sql()[name])


def test_span_hash_by_pieces():
    from juralake.llm import common

    rng = np.random.default_rng(18)
    values = rng.integers(0, 256, 3 * common.HASH_BLOCK).astype(np.uint8)
    start = np.sort(rng.integers(0, len(values) - 50, 5000))
    end = start + rng.integers(0, 50, 5000)
    end[7] = len(values)  # a span over several pieces
    assert (common.span_hash(values, start, end) == common._span_hash(values, start, end)).all()


# --- 6 MinHash


def grams(t, n=3):
    w = re.findall(r"[0-9a-z\u00c0-\u1fff\u2080-\u2fff\u3040-\U0010ffff]+", (t or "").lower())
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_groups(rows, t):
    """Least id of each connected component of documents (id, text)."""
    docs = sorted({(i, x) for i, x in rows if i is not None and grams(x)}, key=str)
    sets = [grams(x) for _, x in docs]
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]):
            up[find(b)] = find(a)
    out = {}
    for k, (i, x) in enumerate(docs):
        out.setdefault(find(k), []).append((i, x))
    return [sorted(g) for g in out.values() if len(g) > 1]


def test_minhash_brute_force(spark):
    rng = random.Random(1)
    rows, n = [], 0
    for base in range(25):
        t = words(rng, 80).split()
        for _ in range(rng.randrange(1, 7)):
            c = list(t)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 20])):
                c[rng.randrange(len(c))] = f"new{rng.randrange(10**6)}"
            rows.append((n, " ".join(c)))
            n += 1
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).repartition(4)
    got = {r["doc_id"]: r["group_id"] for r in minhash.near_duplicate_groups(d).collect()}
    want = {i: g[0][0] for g in brute_groups(rows, minhash.THRESHOLD) for i, _ in g[1:]}
    assert got == want


def test_minhash_recall_at_the_threshold(spark):
    """Pairs a little above the threshold, each alone in its group: banding and pruning may lose MISS of them each."""
    rng, rows = random.Random(15), []
    for i in range(400):
        t = words(rng, 100, 10**6).split()
        c = list(t)
        for k in rng.sample(range(5, 95, 9), 10)[: rng.randrange(8, 11)]:
            c[k] = f"new{i}x{k}"
        rows += [(2 * i, " ".join(t)), (2 * i + 1, " ".join(c))]
    near = {b for (a, s), (b, t) in zip(rows[::2], rows[1::2], strict=True) if minhash.THRESHOLD <= len(grams(s) & grams(t)) / len(grams(s) | grams(t)) < minhash.THRESHOLD + 0.12}
    got = {r["doc_id"] for r in minhash.near_duplicate_groups(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)).collect()}
    assert len(near) > 150 and len(near & got) >= (1 - 2 * minhash.MISS) * len(near) - 1


def test_band_rows():
    assert minhash.band_rows(128, 0.5, 0.005) == 3
    for t in (0.3, 0.5, 0.7, 0.9):
        r = minhash.band_rows(256, t, 0.01)
        assert (1 - t**r) ** (256 // r) <= 0.01 < (1 - t ** (r + 1)) ** (256 // (r + 1))
    with pytest.raises(ValueError):
        minhash.band_rows(4, 0.2, 0.001)


def test_block_pairs_brute_force():
    """All pairs of a block with itself, and across two, with other roots, that pass every batch."""
    rng = np.random.default_rng(16)
    group = np.repeat([0, 1, 2, 3], [7, 1, 9, 5])
    side = np.array([0] * 7 + [0] + [0] * 4 + [1] * 5 + [0] * 5)
    root, sig = rng.integers(0, 4, 22), rng.integers(0, 3, (22, 8)).astype(np.uint32)
    ends, bound = [4, 8], [1, 3]
    want = set()
    for a, b in itertools.combinations(range(22), 2):
        across = 1 in side[group == group[a]]
        if group[a] == group[b] and (side[a] != side[b] if across else True) and root[a] != root[b]:
            if all((sig[a, :e] == sig[b, :e]).sum() >= m for e, m in zip(ends, bound, strict=True)):
                want.add((a, b))
    for pairs in (1, 3, 1000):
        got = [(int(x), int(y)) for a, b in minhash.block_pairs(group, side, root, sig, ends, bound, pairs) for x, y in zip(a, b, strict=True)]
        assert len(got) == len(set(got)) and set(got) == want


def test_minhash_hot_band(spark):
    """Texts that share most of their words but are no copies, and pairs of copies among them, in small blocks."""
    rng = random.Random(17)
    common = words(rng, 60)
    rows = []
    for i in range(120):
        own = words(rng, 90, 10**6)
        rows.append((i, f"{common} {own}"))
        if i % 10 == 0:
            rows.append((1000 + i, f"{common} {own} more"))
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).repartition(4)
    got = {r["doc_id"]: r["group_id"] for r in minhash.near_duplicate_groups(d, block=8).collect()}
    assert got == {i: g[0][0] for g in brute_groups(rows, minhash.THRESHOLD) for i, _ in g[1:]} and len(got) == 12


def test_minhash_hot_group(spark):
    """A long chain of near copies in one bucket is one group."""
    rng = random.Random(2)
    t = words(rng, 200).split()
    rows = []
    for i in range(300):
        c = list(t)
        c[i % 200] = f"v{i}"
        rows.append((i, " ".join(c), None, None, None))
    got = minhash.near_duplicate_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 299 and {r["group_id"] for r in got} == {0}


def test_minhash_messy(messy, empty):
    got = sorted((r["doc_id"], r["group_id"]) for r in minhash.near_duplicate_groups(messy).collect())
    assert got == [(2, 1), (3, 1)]
    kept = [(r["doc_id"], r["text"]) for r in minhash.deduplicate(messy).collect()]
    assert sorted(i for i, _ in kept if i is not None) == [1, 4, 5, 6, 7, 8, 8, 9, 10, 11, 12] and sum(i is None for i, _ in kept) == 2
    assert minhash.deduplicate(messy).columns == messy.columns
    assert minhash.near_duplicate_groups(empty).count() == 0 == minhash.deduplicate(empty).count()


def test_minhash_string_ids_and_ties(spark):
    d = spark.createDataFrame([("b-2", "one two three four", "y", None, 2), ("a-1", "one two three four", "x", None, 1), ("a-1", "one two three four", "w", None, None), ("c", "other text stays here", None, None, None)], SCHEMA.replace("doc_id long", "doc_id string"))
    assert [(r["doc_id"], r["group_id"]) for r in minhash.near_duplicate_groups(d).collect()] == [("b-2", "a-1")]
    assert sorted((r["doc_id"], r["lang"]) for r in minhash.deduplicate(d).collect()) == [("a-1", "w"), ("c", None)]


def test_minhash_repeated_rows(spark):
    d = spark.createDataFrame([(1, "one two three four", "x", None, None)] * 3 + [(2, "other text stays here", None, None, None)], SCHEMA)
    assert sorted(r["doc_id"] for r in minhash.deduplicate(d).collect()) == [1, 2]


def test_posterior_bound():
    assert minhash.least_matches(16, 0.6, 0.005) <= minhash.least_matches(16, 0.8, 0.005)
    for n in (16, 64, 128):
        m = minhash.least_matches(n, 0.6, 0.005)
        assert 0 < m < 0.6 * n


# --- 1 suffix arrays


def brute_repeats(rows, length):
    """Per (id, text): words in repeated windows, words to cut; straight from the definition."""
    docs = sorted({(i, t) for i, t in rows if i is not None and t is not None}, key=lambda r: (r[0], r[1]))
    where = {}
    for d, (i, t) in enumerate(docs):
        w = t.split()
        for s in range(len(w) - length + 1):
            where.setdefault(tuple(w[s : s + length]), []).append((i, s, d))
    rep, stay = {}, {}
    for places in where.values():
        if len(places) > 1:
            for k, (_, s, d) in enumerate(sorted(places)):
                rep.setdefault(d, set()).update(range(s, s + length))
                if k == 0:
                    stay.setdefault(d, set()).update(range(s, s + length))
    return {docs[d]: (r, r - stay.get(d, set())) for d, r in rep.items()}


def test_suffix_brute_force(spark):
    rng = random.Random(3)
    shared = [words(rng, n) for n in (12, 20, 35, 60)]
    rows = [(i, " ".join([words(rng, rng.randrange(0, 40)), rng.choice(shared), words(rng, rng.randrange(0, 40)), rng.choice([*shared, ""])])) for i in range(80)] + [(90, "a b " * 60), (91, "a " * 40)]
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).repartition(5)
    got = {r["doc_id"]: r for r in suffix_dedup.repeat_spans(d, length=15, kmer=3, window=10).collect()}
    want = {i: v for (i, _), v in brute_repeats(rows, 15).items()}
    cover = lambda spans: {w for s in spans for w in range(s["first_word"], s["end_word"])}
    assert {i: (cover(r["repeats"]), cover(r["cuts"])) for i, r in got.items()} == want


def test_suffix_keeps_one_copy_of_every_passage(spark):
    rng = random.Random(4)
    p = words(rng, 60)
    d = spark.createDataFrame([(i, f"{words(rng, 30)} {p} {words(rng, 30)}", None, None, 7) for i in range(6)], SCHEMA)
    out = {r["doc_id"]: r for r in suffix_dedup.remove(d).collect()}
    assert p in out[0]["text"] and not any(p in out[i]["text"] for i in range(1, 6))
    assert out[1]["n_chars"] == len(out[1]["text"]) and out[0]["n_chars"] == 7
    assert all(len(out[i]["text"].split()) == 60 for i in range(1, 6))


def test_suffix_messy(messy, empty):
    out = suffix_dedup.remove(messy)
    assert out.columns == messy.columns
    rows = out.collect()
    assert {r["doc_id"] for r in rows} == {None, 1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12}  # 2 is a copy of 1 and nothing else
    assert sum(r["doc_id"] is None for r in rows) == 2
    assert suffix_dedup.repeats(empty).count() == 0 == suffix_dedup.remove(empty).count()


def test_cut_words():
    assert suffix_dedup.cut_words("a  b\nc d", [(1, 3)]) == "a d"
    assert suffix_dedup.cut_words("a b c", [(0, 3)]).strip() == ""


# --- 4 decontamination


def edit(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def norm(t):
    return " " + re.sub(r"[^a-z0-9\u00c0-\u1fff\u2080-\u2fff\u3040-\U0010ffff]+", " ", t.lower()).strip() + " "


def brute_decontam(texts, items, rate):
    """The definition: each item with a space on each side, anywhere in the text with at most rate * length edits."""
    out = set()
    for d, t in enumerate(texts):
        for k, i in enumerate(items):
            m = len(norm(i).strip())
            if m and edit(norm(i), norm(t)) <= int(m * rate):
                out.add((d, k))
    return out


@pytest.mark.parametrize("lengths,rate,hits", [((90, 130, 200, 61, 12), 0.08, 1 << 20), ((90, 130, 200, 61, 12), 0.08, 50), (tuple(range(1, 41)), 0.06, 1 << 20), (tuple(range(1, 41)), 0.2, 30)])
def test_decontam_brute_force(lengths, rate, hits):
    rng = random.Random(6)
    items = ["".join(rng.choice("abcd ") for _ in range(n)).strip() for n in lengths]
    index = decontam.build_index(list(range(len(items))), items, 10, rate)
    texts = []
    for n in range(120):
        x = list(items[n % len(items)])
        for _ in range(rng.randrange(0, 1 + max(1, int(1.5 * len(x) * rate))) if x else 0):
            k = rng.randrange(len(x)) if x else 0
            x[k : k + 1] = rng.choice([[], [rng.choice("abcd")], [*x[k : k + 1], rng.choice("abcd")]])
        inner = "".join(x).upper() if rng.random() < 0.3 else "".join(x)
        texts.append(rng.choice([f"zz yy {inner} qq", inner, f"zz{inner}yy", f"{inner}, {inner}"]))
    got = {(d, i) for d, i, _ in decontam.find(pa.array(texts), index, hits)}
    assert got == brute_decontam(texts, items, rate) and len(got) > 20


def test_decontam_one_rule():
    """Whole words without edits, whatever the length; edits from 17 bytes on."""
    def hit(item, text):
        return bool(decontam.find(pa.array([text]), decontam.build_index([0], [item])))

    assert not hit("catalogue", "xcataloguex") and not hit("catalogues", "xcataloguesx") and hit("catalogues", "(catalogues)") and hit("a", "a")
    assert hit("abcdefghijklmnopq", "abcdefghXjklmnopq") and not hit("abcdefghijklmnop", "abcdefghXjklmnop")
    assert hit("don\u2019t do that", "\u201cdon't do that\u201d")
    same = ["what is the sum of %d and %d when they are added" % (i, j) for i in range(40) for j in range(40)]  # items with much text in common
    index = decontam.build_index(list(range(1600)), same, rate=0.01)
    assert {i for _, i, _ in decontam.find(pa.array([same[77] + ". " + same[1599]]), index, 500)} == {77, 1599}


def test_banded_agrees():
    rng = random.Random(7)
    for _ in range(60):
        a = bytes(rng.choice(b"ab") for _ in range(20))
        b = bytes(rng.choice(b"ab") for _ in range(30))
        e = edit(a.decode(), b.decode())
        assert decontam.banded(np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8), -20, 30, 6) == (e if e <= 6 else None)


def test_decontam_messy(spark, messy, empty, messy_rows):
    b = spark.createDataFrame([(0, messy_rows[0][1]), (1, None), (2, ""), (None, "!!"), (3, "short"), (None, messy_rows[8][1])], "item_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["item_id"])) for r in decontam.contaminated(messy, b).collect())
    assert got == sorted([("1", "0"), ("2", "0"), ("2", "0"), ("3", "0"), ("None", "0"), ("None", "None"), ("8", "None"), ("10", "3")])
    one = sorted((str(r["doc_id"]), str(r["item_id"])) for r in decontam.contaminated(messy, b, shard_chars=50).collect())
    assert one == got
    kept = decontam.remove(messy, b)
    assert kept.columns == messy.columns and {r["doc_id"] for r in kept.collect()} == {4, 5, 6, 7, 8, 9, 11, 12}
    none = b.where("false")
    assert decontam.contaminated(messy, none).count() == 0 and decontam.remove(messy, none).count() == messy.count() and decontam.contaminated(empty, b).count() == 0


# --- 7 toxicity


def toxic_rows(n, seed=8):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = [words(rng, 10, 300) for _ in range(rng.randrange(1, 9))]
        bad = i % 4 == 0
        if bad:
            s[rng.randrange(len(s))] += " vile" + rng.choice(["", "ness", "st"])
        out.append((i, ". ".join(s), "en", None, int(bad), next((k for k, x in enumerate(s) if "vile" in x), None)))
    return out


def test_toxicity_finds_sentences(spark):
    rows = toxic_rows(800)
    d = spark.createDataFrame([r[:4] + (None,) for r in rows], SCHEMA)
    lab = spark.createDataFrame([(r[0], 1, r[4]) for r in rows if r[0] < 500], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(d, toxicity.fit(d, lab)).collect()}
    held = [r for r in rows if r[0] >= 500]
    assert np.mean([got[r[0]]["is_toxic"] == bool(r[4]) for r in held]) > 0.97
    hits = [r for r in held if r[4] and got[r[0]]["is_toxic"]]
    assert np.mean([[s["sentence"] for s in got[r[0]]["sentences"]] == [r[5]] for r in hits]) > 0.9


def test_noisy_or_brute_force():
    """The loss's value and slopes: products over sentences, and differences."""
    rng = np.random.default_rng(21)
    owner = np.repeat(np.arange(5), [3, 1, 4, 0, 2])
    row, col = rng.integers(0, 10, 30), rng.integers(0, 6, 30)
    y, w, b = np.array([1, 0, 1, 1, 0]), rng.normal(size=6), -1.5

    def loss(w, b):
        total = 0
        for d in range(5):
            none = 1 - 0.05
            for k in np.flatnonzero(owner == d):
                none *= 1 - 1 / (1 + np.exp(-(b + w[col[row == k]].sum())))
            total -= np.log(1 - none) if y[d] else np.log(none)
        return total / 5 + 1e-4 * (w @ w) / 2 + 1e-4 * (b + 6) ** 2 / 2

    value, gw, gb = toxicity.loss_and_slopes(w, b, row, col, owner, y, 0.05, 1e-4)
    assert abs(value - loss(w, b)) < 1e-9
    for k in range(6):
        e = np.eye(6)[k] * 1e-6
        assert abs(gw[k] - (loss(w + e, b) - loss(w - e, b)) / 2e-6) < 1e-6
    assert abs(gb - (loss(w, b + 1e-6) - loss(w, b - 1e-6)) / 2e-6) < 1e-6


def test_judge_brute_force():
    """Probabilities of documents and sentences from the definition, and the sentences' places."""
    rng = random.Random(22)
    table, bias = np.zeros(1 << toxicity.BITS), -2.0
    for x in ("bad", "worse", "meh"):
        table[toxicity.features(pa.array([x]))[0].ravel()] += {"bad": 1.0, "worse": 2.0, "meh": -0.5}[x]
    texts = [". ".join(" ".join(rng.choice(["bad", "worse", "meh", "fine", "day"]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(0, 7))) for _ in range(40)] + [None, "", "!!"]
    score = lambda s: bias + sum(table[toxicity.features(pa.array([x]))[0].ravel()].sum() for x in s.split())
    p, owner, got, lo, hi = toxicity.judge(pa.array(texts), table, bias, toxicity.BITS)
    sentences = [[x for x in re.split("[.!?\\n]+ *", t or "") if x.strip()] for t in texts]
    none = [np.prod([min(1.0, (1 + np.exp(bias)) / (1 + np.exp(score(s)))) for s in x]) for x in sentences]
    assert np.allclose(p, 1 - np.array(none)) and np.allclose(got, [1 / (1 + np.exp(-score(s))) for x in sentences for s in x])
    assert [texts[d][a:b] for d, a, b in zip(owner, lo, hi, strict=True)] == [s for x in sentences for s in x]


def test_toxicity_messy(spark, messy, empty):
    none = spark.createDataFrame([(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    m = toxicity.fit(messy, none)
    assert toxicity.reject(messy, m).count() == messy.count() and toxicity.reject(messy, m).columns == messy.columns
    r = toxicity.score(messy, m).collect()
    assert len(r) == messy.count() and not any(x["is_toxic"] for x in r)
    assert toxicity.score(empty, m).count() == 0 == toxicity.reject(empty, toxicity.fit(empty, none)).count()


def test_toxicity_length_alone_is_clean(spark):
    rows = toxic_rows(500)
    model = toxicity.fit(spark.createDataFrame([r[:4] + (None,) for r in rows], SCHEMA), spark.createDataFrame([(r[0], 1, r[4]) for r in rows], "doc_id long, quality int, toxic int"))
    rng = random.Random(9)
    clean = [words(rng, 10, 300) for _ in range(20_000)]
    bad = clean.copy()
    bad[12_345] += " vile"
    d = spark.createDataFrame([(1, ". ".join(clean), "en", "s", None), (2, ". ".join(bad), "en", "s", None)], SCHEMA)
    got = {r["doc_id"]: r for r in toxicity.score(d, model).collect()}
    assert not got[1]["is_toxic"] and got[2]["is_toxic"] and [s["sentence"] for s in got[2]["sentences"]] == [12_345]
    assert [r["doc_id"] for r in toxicity.reject(d, model).collect()] == [1]


@pytest.mark.parametrize("word,bias", [(0.0, -6.0), (2.0, -8.5)])
def test_toxicity_bias_and_faint_words_do_not_add_up(word, bias):
    slot = toxicity.features(pa.array(["faint"]))[0].ravel()
    table = np.zeros(1 << toxicity.BITS)
    table[slot[0]] = word
    texts = pa.array(["faint. " * 20_000, "", None, "faint. faint"])
    assert (toxicity.judge(texts, table, bias, toxicity.BITS)[0] < 0.5).all()


def test_passage_brute_force():
    rng = np.random.default_rng(3)
    n = np.array([0, 5, 1, 0, 12, 3, 0])
    owner, e = np.repeat(np.arange(7), n), rng.random(21)
    want = [max((e[owner == d][i : i + 4].sum() for i in range(k)), default=0) for d, k in enumerate(n)]
    assert np.allclose(toxicity._passage(e, owner, 7, 4), want)
    assert (toxicity._passage(np.zeros(0), np.zeros(0, int), 2) == 0).all()


# --- 9 language


def test_language_held_out(spark):
    d = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    model = langid.prototypes(d.where("doc_id % 4 <> 0"))
    r = langid.classify(d.where("doc_id % 4 = 0"), model).join(d.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([x["lang_pred"] == x["lang"] for x in r]) > 0.95


def test_cosine_is_the_definition():
    """Bundled counts equal a sum of bound vectors, letter by letter."""
    rng = np.random.default_rng(langid.SEED).choice(np.array([-1, 1], np.int8), (langid.CLASSES, 64))
    cls = lambda c: int(langid.letter_classes()[ord(c)])
    t = "ab cá"
    k = [cls(c) for c in t]
    want = sum(np.roll(rng[k[i]], 2).astype(int) * np.roll(rng[k[i + 1]], 1) * rng[k[i + 2]] for i in range(len(k) - 2))
    v = langid.gram_vectors(3, 64)
    code, _ = langid.codes(pa.array([t]))
    assert (v[code].astype(int).sum(axis=0) == want).all()


def test_classify_brute_force(spark):
    """Predictions, cosines and margins from sums of rotated products, letter by letter."""
    rng = random.Random(14)
    langs = {"aa": "abcdeé", "bb": "defghß", "cc": "kλμνx"}
    rows = [(i, ". ".join("".join(rng.choice(langs[g]) for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(0, 30))) + " \u201c\u2026\u3002 7", g) for i, g in enumerate(list(langs) * 12)]
    letters = np.random.default_rng(langid.SEED).choice(np.array([-1, 1], np.int8), (langid.CLASSES, langid.DIM)).astype(int)

    def bundle(t):
        k = [int(langid.letter_classes()[ord(c)]) for c in t.lower()]
        k = [c for j, c in enumerate(k) if c or j == 0 or k[j - 1]]
        return sum((np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c] for a, b, c in zip(k, k[1:], k[2:])), np.zeros(langid.DIM, int))

    assert not bundle("\u201c\u2026\u3002 77 \u2014").any()
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    proto = [unit(sum(bundle(t) for _, t, g in rows if g == n)) for n in sorted(langs)]
    d = spark.createDataFrame([(i, t, g, None, None) for i, t, g in rows], SCHEMA).repartition(3)
    for r in langid.classify(d, langid.prototypes(d)).collect():
        v = bundle(rows[r["doc_id"]][1])
        c = sorted(((float(unit(v) @ p), -k) for k, p in enumerate(proto)), reverse=True)
        if v.any():
            assert r["lang_pred"] == sorted(langs)[-c[0][1]] and abs(r["cosine"] - c[0][0]) < 1e-4 and abs(r["margin"] - (c[0][0] - c[1][0])) < 1e-4
        else:
            assert r["lang_pred"] is None


def test_language_messy(messy, empty):
    r = {x["doc_id"]: x for x in langid.classify(messy, langid.prototypes(messy)).collect()}
    assert r[4]["lang_pred"] is None and r[6]["cosine"] is None and r[12]["lang_pred"] == "es" and r[10]["lang_pred"] is not None
    assert langid.classify(empty, langid.prototypes(empty)).count() == 0 and langid.classify(messy, langid.prototypes(empty)).where("lang_pred is not null").count() == 0


# --- 8 token packing


def naive_bins(lengths, window):
    cap = []
    for n in sorted(lengths, reverse=True):
        fit = [(c, k) for k, c in enumerate(cap) if c >= n]
        if fit:
            cap[min(fit)[1]] -= n
        else:
            cap.append(window - n)
    return sorted(cap)


def test_best_fit_is_best_fit():
    rng = np.random.default_rng(9)
    for w in (7, 64, 513):
        x = rng.integers(1, w + 1, 400)
        b = bestfit.best_fit_decreasing(x, w)
        assert sorted(w - np.bincount(b, x).astype(int)) == naive_bins(x.tolist(), w)


def unpack(rows, window):
    docs = {}
    for r in rows:
        ids, pos, cu = np.frombuffer(r["token_ids"], np.uint16), np.frombuffer(r["position_ids"], np.uint16), r["cu_seqlens"]
        assert len(ids) == window and cu[0] == 0 and cu[-1] == r["n_tokens"] <= window and (ids[r["n_tokens"] :] == bestfit.EOT).all()
        for s, a, b in zip(r["segments"], cu[:-1], cu[1:], strict=True):
            assert b - a == s["length"] and (pos[a:b] == np.arange(b - a)).all()
            docs.setdefault(s["doc_id"], []).append((s["offset"], ids[a:b].tolist()))
    return {k: sorted(v) for k, v in docs.items()}


@pytest.mark.parametrize("window,pool", [(128, 1000), (2048, 10**6)])
def test_tokens_round_trip(messy, messy_rows, empty, window, pool, tmp_path):
    enc = bestfit.encoder()
    packed = bestfit.pack_tokens(messy, window=window, pool_tokens=pool)
    got = unpack(packed.collect(), window)
    want = {}
    for i, t, *_ in messy_rows:
        if t:
            x = enc.encode_ordinary(t)
            want.setdefault(i, []).extend((o, x[o : o + window]) for o in range(0, len(x), window))
    assert got == {k: sorted(v) for k, v in want.items()}
    assert bestfit.pack_tokens(empty).count() == 0
    folder = ("file://" if pool == 1000 else "") + str(tmp_path / "bin")
    files = bestfit.write_binary(packed, folder).cache()
    assert sum(r["tokens"] for r in files.collect()) == sum(len(x) for v in want.values() for _, x in v)
    back = bestfit.read_binary(files, "bigint", window).collect()
    assert sorted(map(str, back)) == sorted(map(str, packed.collect()))
    ids = np.concatenate([np.fromfile(f"{tmp_path}/bin/{r['path'].rsplit('/', 1)[1]}.ids", np.uint16).reshape(-1, window) for r in files.collect()])
    assert len(ids) == len(back) and not [f for f in os.listdir(tmp_path / "bin") if f.rsplit(".", 1)[1] not in bestfit.PARTS]
    assert bestfit.write_binary(bestfit.pack_tokens(empty), str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("op", ["suffix", "decontam", "tokens", "language", "packing", "toxicity"])
def test_string_ids_and_own_names(spark, op):
    """Ids that are no numbers, and other names for the columns."""
    rng = random.Random(23)
    t = words(rng, 70)
    d = spark.createDataFrame([("b-1", f"{t} {words(rng, 9)}", "x"), ("a-2", t, "y"), (None, "short", "x"), ("c", None, "y")], "key string, body string, doc_id string")
    item = spark.createDataFrame([("i", t)], "item_id string, text string")
    at = {"id_col": "key", "text_col": "body"}
    lab = spark.createDataFrame([("b-1", 1, 1), ("a-2", 1, 0)], "doc_id string, quality int, toxic int")
    if op == "suffix":
        assert sorted((r["doc_id"], r["n_cut"]) for r in suffix_dedup.repeats(d, **at).collect()) == [("a-2", 0), ("b-1", 70)]
        assert {(r["key"], len((r["body"] or "").split())) for r in suffix_dedup.remove(d, **at).collect()} == {("a-2", 70), ("b-1", 9), (None, 1), ("c", 0)}
    elif op == "decontam":
        assert sorted((r["doc_id"], r["item_id"]) for r in decontam.contaminated(d, item, **at).collect()) == [("a-2", "i"), ("b-1", "i")]
        assert sorted(str(r["key"]) for r in decontam.remove(d, item, text_col="body").collect()) == ["None", "c"]
    elif op == "tokens":
        assert {x["doc_id"] for r in bestfit.pack_tokens(d, **at).collect() for x in r["segments"]} == {"b-1", "a-2", None}
    elif op == "language":
        assert {r["doc_id"]: r["lang_pred"] for r in langid.classify(d, langid.prototypes(d, lang_col="doc_id", text_col="body"), **at).collect()}["c"] is None
    elif op == "packing":
        assert {r["doc_id"] for r in nnls_pack.pack(d, **at).collect()} == {"b-1", "a-2", None}
    else:
        m = toxicity.fit(d, lab, **at)
        assert {r["doc_id"] for r in toxicity.score(d, m, **at).collect()} == {"b-1", "a-2", None, "c"} and toxicity.reject(d, m, text_col="body").count() == 4


# --- 10 NNLS packing


def test_nnls_optimal():
    rng = np.random.default_rng(10)
    for _ in range(20):
        a, b = rng.random((8, 12)), rng.random(8)
        x = nnls_pack.nnls(a, b)
        g = a.T @ (b - a @ x)
        assert (x >= 0).all() and (g[x == 0] <= 1e-6).all() and np.abs(g[x > 0]).max(initial=0) < 1e-6


def test_plan_uses_all_and_fills_well():
    rng = np.random.default_rng(11)
    for size, n in ((16, 5), (64, 0), (64, 3000), (128, 100000)):
        h = np.bincount(np.clip(rng.lognormal(2.5, 1, n).astype(int) + 1, 1, size), minlength=size + 1)
        plan = nnls_pack.plan(h, size)
        used = np.zeros(size + 1, int)
        for lengths, k in plan:
            assert sum(lengths) <= size
            np.add.at(used, list(lengths), k)
        assert (used == h).all()
        if n > 1000:
            assert (h * np.arange(size + 1)).sum() > 0.98 * size * sum(k for _, k in plan)


def test_packing_messy(messy, messy_rows, empty):
    enc = bestfit.encoder()
    got = [r.asDict() for r in nnls_pack.pack(messy, rank_rows=5).collect()]
    want = sorted((str(i), o) for i, t, *_ in messy_rows if t for o in range(0, len(enc.encode_ordinary(t)), nnls_pack.WINDOW))
    assert sorted((str(r["doc_id"]), r["offset"]) for r in got) == want
    slots = [(r["pack_id"], r["slot"]) for r in got]
    assert len(set(slots)) == len(slots)
    for _, g in itertools.groupby(sorted(got, key=lambda r: r["pack_id"]), lambda r: r["pack_id"]):
        assert sum(r["length"] for r in g) <= nnls_pack.WINDOW
    assert nnls_pack.pack(empty).count() == 0


# --- 3 URL rules


def test_url_rules(spark):
    pages = [(i, f"https://{'spam' if i % 3 == 0 else 'ok'}{i % 2}.example.com/{'buy' if i % 3 == 0 else 'read'}/{i}") for i in range(300)] + [(None, None), (None, ""), (7, "https://ok.example.com/read/7"), (1, "::::"), (301, "https://ok.example.com/" + "x/" * 50_000)]
    p = spark.createDataFrame(pages, "page_id long, url string")
    lab = spark.createDataFrame([(i, 0 if i % 3 == 0 else 1, None) for i in range(150)] + [(None, 0, 1)], "doc_id long, quality int, toxic int")
    rules = url_rules.mine_rules(p, lab, 10, 0.9).collect()
    # one token tells it all, so longer rules are redundant
    assert sorted(r["rule"] for r in rules) == [["h:spam#"], ["p:buy"]] and {(r["support"], r["total"]) for r in rules} == {(50, 50)}
    r = url_rules.filter_urls(p, lab, 10, 0.9).collect()
    assert len(r) == len(pages)
    assert all(x["rejected"] == (x["page_id"] % 3 == 0) for x in r if x["page_id"] is not None and 150 <= x["page_id"] < 300)
    assert not any(x["rejected"] for x in r if x["page_id"] is None or x["page_id"] > 300)
    assert url_rules.filter_urls(p, lab.where("false")).where("rejected").count() == 0 and url_rules.filter_urls(p.where("false"), lab).count() == 0


def brute_rules(pages, bad, least, confidence, z):
    """Every subset of every labelled page's tokens."""
    total, hits = {}, {}
    for i, tokens in pages:
        for n in range(1, len(tokens) + 1):
            for c in itertools.combinations(tokens, n):
                total[c] = total.get(c, 0) + 1
                hits[c] = hits.get(c, 0) + bad[i]
    share = sum(bad[i] for i, _ in pages) / len(pages)

    def strong(c):
        n, p = total[c], hits[c] / total[c]
        return hits[c] >= least and round(p, 6) >= confidence and (p + z * z / 2 / n - z * (p * (1 - p) / n + z * z / 4 / n / n) ** 0.5) / (1 + z * z / n) > share

    good = {c: round(hits[c] / total[c], 6) for c in total if strong(c)}
    return {c: v for c, v in good.items() if not any(set(d) < set(c) and w >= v for d, w in good.items())}


def test_url_rules_brute_force(spark):
    """Rules of a small host in a larger corpus, of a pair of tokens that neither has alone, and none by chance; string ids and clashing columns."""
    from pyspark.sql import functions as F

    rng = random.Random(19)
    rows, bad = [], {}
    for i in range(1500):
        host, path, q = rng.choice("abcd"), rng.choice("uvwx"), rng.choice(["", "?k&m", "?k"])
        if i % 100 < 2:
            host = "rare"
        rows.append((f"p{i}", f"http://{host}.org/{path}/{rng.randrange(9)}{q}"))
        bad[f"p{i}"] = int(rng.random() < (0.95 if host == "rare" or (host == "a" and path == "u") else 0.2))
    d = spark.createDataFrame(rows, "page_id string, url string").select("*", *(F.lit(1).alias(c) for c in ("id", "bad", "tokens", "token", "rule", "confidence", "items")))
    lab = spark.createDataFrame([(i, 1 - b, None) for i, b in bad.items()], "doc_id string, quality int, toxic int")
    tokens = {r["page_id"]: r["t"] for r in d.select("page_id", url_rules.url_tokens(F.col("url")).alias("t")).collect()}
    want = brute_rules(list(tokens.items()), bad, 10, 0.5, 4.0)
    assert {tuple(r["rule"]): r["confidence"] for r in url_rules.mine_rules(d, lab).collect()} == want and ("h:rare",) in want and ("h:a", "p:u") in want
    for r in url_rules.filter_urls(d, lab).collect():
        hit = [v for c, v in want.items() if set(c) <= set(tokens[r["page_id"]])]
        assert (r["n_rules"], r["confidence"], r["rejected"]) == (len(hit), max(hit, default=None), bool(hit))
    # labels that don't depend on URLs give no rules
    mixed = list(bad.values())
    rng.shuffle(mixed)
    assert url_rules.mine_rules(d, spark.createDataFrame([(i, 1 - b, None) for i, b in zip(bad, mixed, strict=True)], "doc_id string, quality int, toxic int")).count() == 0


# --- 2 media


def test_wav_widths_and_tone():
    import io
    import wave

    t = np.arange(8000) / 8000
    x = 0.5 * np.sin(2 * np.pi * 1000 * t)
    for width, scale in ((1, 127), (2, 32767), (3, (1 << 23) - 1), (4, (1 << 31) - 1)):
        v = (x * scale).astype(np.int64) + (128 if width == 1 else 0)
        raw = np.repeat(v, 2).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(2)
            w.setsampwidth(width)
            w.setframerate(8000)
            w.writeframes(raw)
        y, rate, channels = media.read_wav(out.getvalue())
        assert (rate, channels, len(y)) == (8000, 2, 8000) and np.abs(y - x).max() < 0.02
    s = media.spectrogram(x.astype(np.float32))
    assert s.shape == (30, 257) and (s[5].argmax() == round(1000 * 512 / 8000))
    direct = np.abs(np.fft.rfft(x[256:768] * np.hanning(512)))
    assert np.allclose(s[1], direct, atol=1e-2)


def brute_fingerprint(x, rate):
    """Frames, a direct Fourier sum, every cell against its neighbourhood, every pair of peaks."""
    n, hop = media.FRAME, media.HOP
    x = np.concatenate([x, np.zeros(max(0, n - len(x)))])
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1))
    wave_ = np.exp(-2j * np.pi * np.outer(np.arange(n // 2 + 1), np.arange(n)) / n)
    s = np.array([np.abs(wave_ @ (x[a : a + n] * window)) for a in range(0, len(x) - n + 1, hop)])
    level, peaks = s.mean() + s.std(), []
    for t, f in itertools.product(range(s.shape[0]), range(s.shape[1])):
        around = s[max(0, t - media.NEAR_T) : t + media.NEAR_T + 1, max(0, f - media.NEAR_F) : f + media.NEAR_F + 1]
        if s[t, f] > level and s[t, f] > 1e-4 and s[t, f] >= around.max():
            peaks.append((t, f))
    return sorted((t * hop * 1000 // rate, f << 24 | g << 8 | u - t) for t, f in peaks for u, g in peaks if 0 < u - t <= media.REACH and abs(g - f) <= media.SPAN)


def test_fingerprint_brute_force(spark):
    rng = np.random.default_rng(20)
    clips = []
    for k in range(12):
        size, rate = ((6000, 8000), (300, 8000), (6000, 11025), (4096, 8000))[k % 4]
        t = np.arange(size) / rate
        x = sum(rng.random() * np.sin(2 * np.pi * rng.integers(100, rate // 2 - 200) * t) * (t > rng.random() * t[-1]) for _ in range(6))
        clips.append((media.write_wav(0.9 * x / np.abs(x).max(), rate), rate))
    d = spark.createDataFrame([(f"c{i}", c, "x") for i, (c, _) in enumerate(clips)] * 2, "id string, media binary, fingerprint string").repartition(2)
    total = 0
    for r in media.fingerprints(d, "id").collect():
        data, rate = clips[int(r["media_id"][1:])]
        got, want = [(p["t_ms"], p["hash"]) for p in r["fingerprint"]], brute_fingerprint(media.read_wav(data)[0].astype(float), rate)
        total += len(want)
        assert got == sorted(got) and len(set(got) ^ set(want)) <= 0.02 * len(want), r["media_id"]  # a cell at the level may round either way
    assert total > 500


def test_media_long_clip():
    x = np.tile(media.read_wav(media.render(np.sin(np.arange(64))))[0], 120)  # two minutes
    ms, code = media.fingerprint(x, 8000)
    assert ms[-1] > 118_000 and len(code) > 1000


def test_media_messy(spark):
    clip = media.render(np.sin(np.arange(64)))
    late = media.write_wav(np.concatenate([np.zeros(2560), media.read_wav(clip)[0]]))
    d = spark.createDataFrame([(1, clip), (2, None), (3, b"junk"), (4, media.write_wav(np.zeros(10))), (None, clip), (5, late), (1, clip), (6, b"")], "media_id long, media binary")
    r = media.fingerprints(d).collect()
    by = {x["media_id"]: x for x in r}
    assert len(r) == 8 and by[2]["sample_rate"] is None and by[2]["error"] is None and by[3]["error"] and by[6]["error"] and by[4]["fingerprint"] == []
    a, b = ({p["hash"] for p in by[k]["fingerprint"]} for k in (1, 5))
    assert len(a & b) > 0.7 * len(a)  # the same clip later on
    assert media.fingerprints(d.where("false")).count() == 0


# --- 5 HTML


def page(i, items, body):
    lis = "".join(f"<li><a href='/{x}'>{x}</a></li>" for x in items)
    return f"<html><head><title>T {i}</title></head><body><nav><ul>{lis}</ul></nav><div class=ad>Ad by us</div><article><h1>{i}</h1><p>{body}</p></article><footer>All rights held</footer></body></html>"


def test_template(spark):
    rng = random.Random(12)
    rows = [(i, f"https://h.example.com/{i}", page(f"n{i}", [words(rng, 1) for _ in range(1 + i % 4)], words(rng, 20) + f" &lt;{i}")) for i in range(40)]
    rows += [(100, "https://lone.example.com/", "<p>only <b>one</b></p>"), (101, None, "<p>x</p>"), (102, "https://h.example.com/null", None), (None, "https://h.example.com/e", ""), (103, "https://lone2.example.com/", "a < b <i")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_template.extract_slots(d, chunk=16).collect()}
    assert len(got) == len(rows)
    for i in (0, 17, 39):
        text = [s["text"] for s in got[i]["slots"]]
        assert got[i]["template_tokens"] > 10 and f"n{i}" in text and any(t.endswith(f"<{i}") for t in text)
        assert not any("rights" in t or "Ad by" in t for t in text)
        assert sum(s["before"] == "<a" for s in got[i]["slots"]) == 1 + i % 4
    assert [s["text"] for s in got[100]["slots"]] == ["only one"] and got[100]["template_tokens"] == 0
    assert got[102]["slots"] == [] == got[None]["slots"] and "a < b" in got[103]["slots"][0]["text"]
    assert html_template.extract_slots(d.where("false")).count() == 0


def brute_template(pages, share=0.9, least=4):
    """Classes, conflicts, gaps and nest of one host's token lists, from the definition: every page, every pair, every occurrence."""
    if len(pages) < least:
        return None
    vectors = {t: tuple(p.count(t) for p in pages) for t in {t for p in pages for t in p}}
    vectors = {t: v for t, v in vectors.items() if sum(n > 0 for n in v) >= share * len(pages)}
    place = {t: round(sum(p.index(t) / len(p) for p in pages if t in p) / sum(n > 0 for n in vectors[t]), 6) for t in vectors}
    groups = {}
    for t, v in vectors.items():
        groups.setdefault(v, []).append((place[t], t))
    groups = sorted((sorted(g) for g in groups.values() if len(g) > 1), key=lambda g: (g[0], [t for _, t in g]))
    classes = []
    for g in groups:
        c = [t for _, t in g]

        def wrong(a, b):
            return any(x and "".join(x) != "ab" * (len(x) // 2) for x in (["a" if t == a else "b" for t in p if t in (a, b)] for p in pages))

        bad = {(a, b) for a, b in itertools.combinations(c, 2) if wrong(a, b)}
        while bad:
            n = {t: sum(t in e for e in bad) for t in c}
            t = max(c, key=lambda t: (n[t], c.index(t)))
            c = [x for x in c if x != t]
            bad = {e for e in bad if t not in e}
        if len(c) > 1:
            classes.append(c)

    def gap(c, d):
        seen = set()
        for p in pages:
            last = 0
            for t in p:
                if t in c:
                    last = c.index(t) + 1
                elif t in d:
                    seen.add(last)
        return seen.pop() if len(seen) == 1 else None

    kept = []
    for c in sorted(classes, key=lambda c: -len(c)):
        if all(gap(k, c) is not None or gap(c, k) is not None for k in kept):
            kept.append(c)
    inside = lambda c, k: c is not k and gap(k, c) not in (None, 0, len(k))
    out = []
    for c in kept:
        around = [k for k in kept if inside(c, k)]
        up = max(around, key=lambda k: (sum(inside(k, j) for j in around), -kept.index(k)), default=None)
        out.append({"tokens": c, "parent": -1 if up is None else kept.index(up), "gap": 0 if up is None else gap(up, c)})
    return out


def template_rows(kind):
    rng = random.Random(13)
    if kind == "swapped":  # no class: half of the pages have the other order
        return [(i, "https://h.org/", "x y z" if i % 2 else "z y x") for i in range(24)]
    if kind == "rare":  # on 90 % of the pages, but none of the last ones
        return [(i, "https://h.org/", "<p>a b</p>" + ("c d" if i < 36 else "")) for i in range(40)]
    if kind == "copies":  # rows that repeat, and clashing columns
        return [(i % 3, "https://h.org/", ["<i>a b</i> u <b>v</b>", "<i>b a</i> u <b>v</b>", "<i>a b</i> w <b>v</b>"][i % 3]) for i in range(90)]
    out = []
    for i in range(150):
        host = rng.choice("aab")
        items = "".join(f"<li><a>{words(rng, 1)}</a> <em>by</em> {words(rng, rng.randrange(3))}</li>" for _ in range(rng.randrange(1, 5)))
        ads = rng.sample(["<q>one</q>", "<u>two</u>", "<s>three</s>"], 3)
        out.append((i, f"http://{host}.net/{i}", f"<html><body>{ads[0]}<nav><ul>{items}</ul>{ads[1]}</nav><h1>{i}</h1>{ads[2]}<p>{words(rng, 8, 50)}</p>" + ("<hr>" if rng.random() < 0.95 else "") + "<footer>all rights held</footer></body></html>"))
    return out


@pytest.mark.parametrize("kind", ["swapped", "rare", "copies", "mixed", "sf0.001"])
def test_template_matches_brute_force(spark, kind):
    """The same template, in both directions, whatever the chunk."""
    import json

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()] if kind == "sf0.001" else template_rows(kind)
    hosts = {}
    for _, url, h in rows:
        hosts.setdefault(re.search("://([^/?#:]+)", url)[1].lower(), []).append(html_template.tokens(h)[0])
    want = {k: brute_template(v) for k, v in hosts.items()}
    want = {k: v for k, v in want.items() if v}
    d = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for chunk in (8, 64, 512):
        got = {r["host"]: json.loads(r["template"]) for r in html_template.templates(d, chunk=chunk).collect()}
        assert {k: v for k, v in got.items() if v} == want, chunk


def test_template_of_clashing_columns_and_string_ids(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(f"p{i % 10}", "https://h.org/", f"<p>n{i % 10}</p><b>end</b>") for i in range(20)], "page_id string, url string, html string")
    d = d.select("*", *(F.lit("x").alias(c) for c in ("host", "key", "salt", "row", "classes", "template", "token", "pages")))
    got = html_template.extract_slots(d, chunk=8).collect()
    assert len(got) == 20 and all([s["text"] for s in r["slots"]] == ["n" + r["page_id"][1:]] and r["host"] == "h.org" for r in got)


def test_slots_by_hand():
    import json

    t = json.dumps([{"tokens": ["<ul", "</ul"], "parent": -1, "gap": 0}, {"tokens": ["<li", "</li"], "parent": 0, "gap": 1}])
    assert html_template.extract("x &amp; y<ul>a<li>b <i>c</i></li><li>\nd<p>e</li></ul> z", t) == [(None, "<ul", 0, "x & y"), ("<ul", "<li", 0, "a"), ("<li", "</li", 1, "b c"), ("<li", "</li", 1, "d\ne"), ("</ul", None, 0, "z")]


@pytest.mark.parametrize("piece", ["<!-- ", "<script ", "<style>a</style", "<a <b", "<", "</script "])
def test_broken_pages_take_linear_time(piece):
    import time

    begin = time.perf_counter()
    names, raw = html_template.tokens(piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - begin < 5 and len(names) == len(raw) and sum(map(len, raw)) > 500_000


def test_tokens_of_marked_sections():
    assert html_template.tokens("<p>a<!-- x <b> -->b<script>x<y</script >c<style>z")[0] == ["<p", "<p\x1fa", "<!--", "<p\x1fb", "<script", "<script\x1fc", "<style", "<style\x1fz"]
