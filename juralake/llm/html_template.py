"""HTML extraction by equivalence-class template deduction.

Pages of one host share a template. A token (a tag, or a word, told apart by the
tag it stands behind) has an occurrence vector: how often it occurs in each page
of the host. Tokens with the same vector, on at least ``SHARE`` of the host's
pages, form an equivalence class. A class is valid if its tokens come in one
order on every page, round after round; where two of its tokens don't, the one
in more such conflicts goes (ties: the later in order) until none is left. A
class nests in a gap of another if all its occurrences on all pages lie in that
one gap; of two classes that cross, the smaller goes. The nested classes are the
template; what stands between their tokens on a page are its slots.

All of this is defined over the host's pages and doesn't depend on how they are
spread. Vectors are compared by sums of hashes over pages: pages are dealt, by
row and not by content, to chunks of about ``CHUNK``; each chunk adds up its
tokens' sums, and the parts are summed, so no task holds a whole host. A chunk
leaves out tokens on less than half the share of its pages. Where a token that
was left out somewhere could still reach the share, its host is counted again
without leaving out any, so the sums are exact. A second pass over the pages,
without a shuffle, gathers facts about the classes: pairs out of order, and the
gaps in which classes lie. Hosts with conflicts have their gaps gathered once
more for what is left of their classes.

Edge cases: a null or empty page, or null URL, gives no slots; a host of fewer
than ``MIN_PAGES`` pages has no template, and its pages are one slot each; an
empty table gives no rows. Null page ids stay null, and ids keep their type.
Repeated rows count as pages of their own. Classes of equal size nest in the
order of their first token's mean place, then its name. Broken markup is read as
far as it goes, in time linear in its length: a comment, script or tag that is
never closed is text or an ordinary tag. Pages are read whole, however long.
Columns other than page_id, url and html are left alone, whatever their names.
"""

from __future__ import annotations

import html as _html
import json
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, cut_lineage, kind, mix, small_or_shuffled

CHUNK, SHARE, MIN_PAGES, CHUNKS_A_TASK, MOST_TASKS = 512, 0.9, 4, 4, 100_000
_PLAIN = re.compile(r"</?[a-zA-Z!][^<>]*>|[^<\s]+|<")
_OPEN = re.compile(r"<!--|<(?:script|style)\b", re.I)
_CLOSE = re.compile(r"</(?:script|style)\s*>", re.I)
_NAME = re.compile(r"</?[a-zA-Z!][a-zA-Z0-9]*")
_BLOCK = frozenset("<p <div <li <tr <br <h1 <h2 <h3 <h4 <h5 <h6 <article <section <footer <header <nav <ul <ol <table <title".split()) | {"</p", "</div", "</li", "</tr"}


def _split(page: str) -> list[str]:
    """Source text of the tokens. Comments, scripts and styles that are closed are one token each."""
    if not _OPEN.search(page):
        return _PLAIN.findall(page)
    comments, scripts = [m.end() for m in re.finditer("-->", page)], [(m.start(), m.end()) for m in _CLOSE.finditer(page)]
    starts, out, at = [a for a, _ in scripts], [], 0
    for m in _OPEN.finditer(page):
        if m.start() < at:
            continue
        if m[0] == "<!--":
            k = bisect_left(comments, m.end() + 3)
            end = comments[k] if k < len(comments) else 0
        else:
            k = bisect_left(starts, m.end())
            end = scripts[k][1] if k < len(scripts) else 0
        if end:
            out += _PLAIN.findall(page, at, m.start())
            out.append(page[m.start() : end])
            at = end
    return out + _PLAIN.findall(page, at)


@lru_cache(maxsize=1 << 16)
def _tag(source: str) -> str:
    return "<!--" if source.startswith("<!--") else _NAME.match(source)[0].lower()


def tokens(page: str) -> tuple[list[str], list[str]]:
    """Tokens of a page (tags as ``<name``, words as ``tag\x1fword``) and their source text."""
    names, raw, tag = [], _split(page), ""
    for t in raw:
        if t[0] == "<" and len(t) > 1:
            name = _tag(t) if len(t) < 256 else _tag(t[:255] + ">")
            names.append(name)
            if name != "<!--":
                tag = name
        else:
            names.append(f"{tag}\x1f{t}")
    return names, raw


def chunk_sums(keys: list[int], pages: list[str], share: float) -> list[tuple]:
    """(token, pages, v1, v2, place) of the tokens on at least half the share of the pages: on how many, two sums of hashes of (page, count), and the sum of its first relative places."""
    ids: dict[str, int] = {}
    rows = [[ids.setdefault(x, len(ids)) for x in tokens(page)[0]] for page in pages]
    size = np.array([len(r) for r in rows])
    flat = np.fromiter((i for r in rows for i in r), np.int64, int(size.sum()))
    page = np.repeat(np.arange(len(rows)), size)
    pair, first, n = np.unique(page * max(1, len(ids)) + flat, return_index=True, return_counts=True)
    page, token = pair // max(1, len(ids)), pair % max(1, len(ids))
    held = np.bincount(token, minlength=len(ids))
    keep = held[token] >= share / 2 * len(rows)
    page, token, first, n = page[keep], token[keep], first[keep], n[keep]
    h = mix(np.array(keys, np.int64).view(U64)[page] * U64(0x9E3779B97F4A7C15) + n.astype(U64) * U64(0xD6E8FEB86659FD93))
    v1, v2, place = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.zeros(len(ids))
    np.add.at(v1, token, (h & U64(0x7FFFFFFF)).astype(np.int64))
    np.add.at(v2, token, (h >> U64(33)).astype(np.int64))
    np.add.at(place, token, (first - (np.cumsum(size) - size)[page]) / size[page])
    names = list(ids)
    return [(names[i], int(held[i]), int(v1[i]), int(v2[i]), float(place[i])) for i in np.unique(token).tolist()]


_SUMS = "host string, token string, pages long, v1 long, v2 long, place double, seen long"


def _sums(share: float):
    """Rows of chunk_sums with ``seen``, the pages of the chunk; input comes sorted by host and salt."""

    def run(batches):
        group, keys, pages = None, [], []

        def flush():
            rows = [(group[0], *r, len(pages)) for r in chunk_sums(keys, pages, share)] if pages else []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], ["host", "token", "pages", "v1", "v2", "place", "seen"])

        for b in batches:
            for host, salt, key, page in zip(*(b.column(c).to_pylist() for c in ("host", "salt", "key")), b.column("html"), strict=True):
                if (host, salt) != group:
                    yield from flush()
                    group, keys, pages = (host, salt), [], []
                keys.append(key)
                pages.append(page.as_py())
        yield from flush()

    return run


class Facts:
    """What pages say about a host's classes (lists of tokens in order).

    ``ok[c][a, b]``: on every page so far, tokens a and b of class c take turns and a starts. ``gap[c, d]``: the gap of c (0 before its first token, i behind its i-th) in which every occurrence of d so far lies; UNSET before there is one, CROSS if there are several.
    """

    UNSET, CROSS, SEEN = -1, -2, 20_000

    def __init__(self, classes: list[list[str]]):
        self.place = {t: (c, i) for c, tokens_ in enumerate(classes) for i, t in enumerate(tokens_)}
        self.size = [len(c) for c in classes]
        self.ok = [np.triu(np.ones((n, n), bool), 1) for n in self.size]
        self.gap = [[self.UNSET] * len(classes) for _ in classes]
        self.seen: set[tuple] = set()

    def add(self, names: list[str]) -> None:
        place = self.place
        row = tuple(place[x] for x in names if x in place)
        if row in self.seen:  # most pages repeat what another said
            return
        if len(self.seen) >= self.SEEN:
            self.seen.clear()
        self.seen.add(row)
        last, loose, n = [0] * len(self.size), set(), len(self.size)
        gap = self.gap
        for c, i in row:
            for k in range(n):
                if k != c:
                    g = gap[k]
                    if g[c] != last[k]:
                        g[c] = last[k] if g[c] == self.UNSET else self.CROSS
            if last[c] % self.size[c] != i:
                loose.add(c)
            last[c] = i + 1
        for c in range(n):
            if last[c] and last[c] != self.size[c]:
                loose.add(c)
        for c in loose:
            self._order(c, [i for k, i in row if k == c])

    def _order(self, c: int, seq: list[int]) -> None:
        at: dict[int, list[int]] = {}
        for p, i in enumerate(seq):
            at.setdefault(i, []).append(p)
        if len(at) < self.size[c] or len({len(x) for x in at.values()}) > 1:  # can't be: the vectors are equal (but for colliding hashes)
            self.ok[c][:] = False
            return
        p = np.array([at[i] for i in range(self.size[c])])
        before = (p[:, None, :] < p[None, :, :]).all(axis=2)
        if p.shape[1] > 1:
            before &= (p[None, :, :-1] < p[:, None, 1:]).all(axis=2)
        self.ok[c] &= before

    def dump(self) -> str:
        full = [bool((ok == np.triu(np.ones_like(ok), 1)).all()) for ok in self.ok]
        return json.dumps({"ok": [None if f else np.packbits(ok).tobytes().hex() for f, ok in zip(full, self.ok, strict=True)], "gap": self.gap})


def merged(sizes: list[int], dumps: list[str]) -> tuple[list[np.ndarray], list[list[int]]]:
    """ok and gap of Facts over all parts."""
    ok = [np.triu(np.ones((n, n), bool), 1) for n in sizes]
    gap = [[Facts.UNSET] * len(sizes) for _ in sizes]
    for text in dumps:
        d = json.loads(text)
        for c, bits in enumerate(d["ok"]):
            if bits is not None:
                n = sizes[c]
                ok[c] &= np.unpackbits(np.frombuffer(bytes.fromhex(bits), np.uint8), count=n * n).reshape(n, n).astype(bool)
        for a, b in zip(gap, d["gap"], strict=True):
            for k, g in enumerate(b):
                if g != Facts.UNSET and a[k] != g:
                    a[k] = g if a[k] == Facts.UNSET else Facts.CROSS
    return ok, gap


def valid(classes: list[list[str]], ok: list[np.ndarray]) -> list[list[str]]:
    """The classes without tokens that are out of order: of each class the one in most conflicts goes (ties: the later) until none is left."""
    out = []
    for tokens_, good in zip(classes, ok, strict=True):
        bad = np.triu(~good, 1)
        bad = bad | bad.T
        while bad.any():
            k = len(bad) - 1 - int(np.argmax(bad.sum(axis=1)[::-1]))
            bad = np.delete(np.delete(bad, k, 0), k, 1)
            tokens_ = tokens_[:k] + tokens_[k + 1 :]
        out.append(tokens_)
    return out


def nest(classes: list[list[str]], gap: list[list[int]]) -> list[dict]:
    """Of classes, largest first, those that lie in one gap of each that stays, or have it in one gap of theirs: tokens, parent (place in the list of the smallest class around it, or -1) and the parent's gap."""
    kept: list[int] = []
    for c in sorted(range(len(classes)), key=lambda c: -len(classes[c])):
        if len(classes[c]) > 1 and all(gap[k][c] != Facts.CROSS or gap[c][k] != Facts.CROSS for k in kept):
            kept.append(c)
    out = []
    for c in kept:
        around = [k for k in kept if k != c and 0 < gap[k][c] < len(classes[k])]
        inner = max(around, key=lambda k: (sum(0 < gap[j][k] < len(classes[j]) for j in around if j != k), -kept.index(k)), default=None)
        out.append({"tokens": classes[c], "parent": -1 if inner is None else kept.index(inner), "gap": 0 if inner is None else gap[inner][c]})
    return out


HOSTS_HELD = 256


def _facts(batches):
    held: dict[str, Facts] = {}

    def flush():
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([f.dump() for f in held.values()], pa.string())], ["host", "facts"])
            held.clear()

    for b in batches:
        for host, page, classes in zip(b.column("host").to_pylist(), b.column("html"), b.column("classes").to_pylist(), strict=True):
            if host not in held:
                if len(held) >= HOSTS_HELD:
                    yield from flush()
                held[host] = Facts(json.loads(classes))
            held[host].add(tokens(page.as_py())[0])
    yield from flush()


def _judge(batches):
    """Cleaned classes of each host (null where nothing had to go) and its template."""
    for b in batches:
        again, out = [], []
        for text, dumps in zip(b.column("classes").to_pylist(), b.column("facts").to_pylist(), strict=True):
            classes = json.loads(text)
            ok, gap = merged([len(c) for c in classes], dumps)
            clean = valid(classes, ok)
            again.append(json.dumps([c for c in clean if len(c) > 1]) if clean != classes else None)
            out.append(json.dumps(nest(classes, gap)) if clean == classes else None)
        yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(again, pa.string()), pa.array(out, pa.string())], ["host", "classes", "template"])


def _hosts(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))
    return pages.select("page_id", host.alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))


def _totals(p: DataFrame, size: DataFrame, chunk: int, share: float) -> DataFrame:
    """host, token, host_pages and the sums over the host's chunks."""
    chunks = size.agg(F.sum(F.ceil(F.col("host_pages") / chunk))).first()[0] or 0
    # a few chunks a task; with very many, tasks get more of them, one at a time
    parts = max(int(p.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-chunks // CHUNKS_A_TASK), MOST_TASKS))
    # rows are dealt before any shuffle, where their numbers are the same whenever they are computed
    keyed = p.select("host", F.xxhash64("page_id", "html").alias("key"), F.monotonically_increasing_id().alias("row"), "html").join(small_or_shuffled(size, 64), "host")
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("row"), F.ceil(F.col("host_pages") / chunk)).cast("int"))
    spread = keyed.select("host", "salt", "key", "html").repartition(parts, "host", "salt").sortWithinPartitions("host", "salt")
    sums = spread.mapInArrow(_sums(share), _SUMS).groupBy("host", "token").agg(*(F.sum(c).alias(c) for c in ("pages", "v1", "v2", "place", "seen")))
    return sums.join(small_or_shuffled(size, 64), "host")


def classes_of(pages: DataFrame, chunk: int = CHUNK, share: float = SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, classes (JSON lists of tokens with one occurrence vector, in the order of their mean first place) of every host of at least ``min_pages`` pages that has any."""
    p = _hosts(pages).where("host <> ''")
    size = _hosts(pages.select("page_id", "url", F.lit("").alias("html"))).where("host <> ''").groupBy("host").agg(F.count("*").alias("host_pages"))
    size = cut_lineage(size.where(F.col("host_pages") >= min_pages))
    total = cut_lineage(_totals(p, size, chunk, share).where(f"pages + {share / 2} * (host_pages - seen) >= {share} * host_pages"))
    # left out by some chunk, and yet perhaps common enough
    open_ = cut_lineage(total.where("seen < host_pages").select("host").distinct())
    if not open_.isEmpty():
        exact = _totals(p.join(open_, "host", "left_semi"), size.join(open_, "host", "left_semi"), chunk, 0.0)
        total = cut_lineage(total.join(open_, "host", "left_anti").unionByName(exact))
    common = total.where(f"pages >= {share} * host_pages").withColumn("place", F.round(F.col("place") / F.col("pages"), 6))
    one = common.groupBy("host", "pages", "v1", "v2").agg(F.array_sort(F.collect_list(F.struct("place", "token"))).alias("x")).where("size(x) > 1")
    one = one.select("host", F.struct(F.col("x")[0].alias("first"), F.transform("x", lambda t: t["token"]).alias("tokens")).alias("c"))
    return one.groupBy("host").agg(F.to_json(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["tokens"])).alias("classes"))


def templates(pages: DataFrame, chunk: int = CHUNK, share: float = SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, template: JSON list of the valid classes that nest, largest first, each {tokens, parent, gap}."""
    p = _hosts(pages).where("host <> ''")

    def judged(classes: DataFrame) -> DataFrame:
        small = small_or_shuffled(classes, F.length("classes") + 64)
        facts = p.select("host", "html").join(small, "host").mapInArrow(_facts, "host string, facts string")
        facts = facts.groupBy("host").agg(F.collect_set("facts").alias("facts"))
        return cut_lineage(facts.join(small, "host").select("host", "classes", "facts").mapInArrow(_judge, "host string, classes string, template string"))

    done = judged(cut_lineage(classes_of(pages, chunk, share, min_pages)))
    again = cut_lineage(done.where("classes is not null").select("host", "classes"))
    done = done.where("template is not null").select("host", "template")
    if not again.isEmpty():
        done = done.unionByName(judged(again).select("host", "template"))
    return done


@lru_cache(maxsize=1024)
def _parsed(template: str) -> dict[str, int]:
    """Level of each template token: 0 for classes in no other, 1 for those in one of these, and so on."""
    classes, level = json.loads(template), []
    for c in classes:
        up, n = c["parent"], 0
        while up >= 0:
            up, n = classes[up]["parent"], n + 1
        level.append(n)
    return {t: n for c, n in zip(classes, level, strict=True) for t in c["tokens"]}


def extract(page: str, template: str | None) -> list[tuple[str | None, str | None, int, str]]:
    """Slots of a page: (template token before, template token behind, level of the token before, text), those with text only."""
    names, raw = tokens(page)
    known = _parsed(template) if template else {}
    out, words, before = [], [], None

    def close(behind):
        text = re.sub(r"[ \t]*\n[ \t\n]*", "\n", " ".join(words)).strip() if words else ""
        if text:
            out.append((before, behind, known.get(before, 0), _html.unescape(text)))
        words.clear()

    for x, t in zip(names, raw, strict=True):
        if x in known:
            close(x)
            before = x
        elif x[0] != "<" or "\x1f" in x:
            words.append(t)
        elif x in _BLOCK:
            words.append("\n")
    close(None)
    return out


_SLOT = pa.list_(pa.struct([("before", pa.string()), ("behind", pa.string()), ("level", pa.int32()), ("text", pa.string())]))


def _extract(batches):
    for b in batches:
        for lo in range(0, b.num_rows, 512):
            part = b.slice(lo, 512)
            slots, size = [], []
            for page, template in zip(part.column("html").to_pylist(), part.column("template").to_pylist(), strict=True):
                slots.append([{"before": x, "behind": y, "level": n, "text": t} for x, y, n, t in extract(page, template)])
                size.append(len(_parsed(template)) if template else 0)
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("host"), pa.array(size, pa.int32()), pa.array(slots, _SLOT)], ["page_id", "host", "template_tokens", "slots"])


def extract_slots(pages: DataFrame, chunk: int = CHUNK, share: float = SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, host, template_tokens, slots (template token before and behind, level in the nest, text) of every page."""
    t = cut_lineage(templates(pages, chunk, share, min_pages))
    joined = _hosts(pages).join(small_or_shuffled(t, F.length("template")), "host", "left").select("page_id", "host", "html", "template")
    return joined.mapInArrow(_extract, f"page_id {kind(pages, 'page_id')}, host string, template_tokens int, slots array<struct<before:string,behind:string,level:int,text:string>>")
