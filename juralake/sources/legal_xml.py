"""Legal XML (Akoma Ntoso) to one row per element.

The one place where Python runs per document: mixed content keeps its order only
in a parser. Everything after works on the node table with DataFrame operators;
``ord`` and ``end_ord`` make "lies within" a comparison of numbers, ``owner_ord`` names the nearest element above that has an id, and ``above`` all
that have one, structure the text, or are tables, mods, notes or islands: what
lies in such an element is found by equal numbers.

Text rules: notes (authorialNote) and foreign islands aren't running text; a
space follows num, td and th, a line break follows block elements; soft hyphens
go and no-break spaces become spaces; lines are trimmed and empty ones dropped.

``text`` is the whole running text of an element. Its variants are there only
where they say something else: ``text_no_tables`` of elements that hold a table,
and ``text_notes`` (with notes, without the spaces and breaks) of references,
whose label it is, or of all elements on demand.

A row is made when its element ends, and rows go out in batches of bounded size,
so a task holds a document's source and the texts of what is open, not its tree or
its rows. Paths name labels that may come later, and a document that can't be read
gives no rows: a long document is read twice, first for its faults and labels; the
rows of a short one wait for its end.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import HIERARCHY_TAGS

_STEP = "struct<ord:int,eid:string,kind:string,num:string,heading:string>"
NODE_SCHEMA = f"doc_id string, ord int, end_ord int, parent_ord int, owner_ord int, depth int, tag string, attrs map<string,string>, eid string, nearest_eid string, text string, text_notes string, text_no_tables string, num string, heading string, path array<{_STEP}>, is_eid_leaf boolean, component int, error string, above array<int>"
_H = frozenset(HIERARCHY_TAGS)
_SPACE = frozenset(("num", "td", "th"))
_BREAK = frozenset("block content heading intro item listIntroduction p paragraph tr".split())
_NOTE_BREAK = frozenset(("p", "paragraph", "heading", "item"))
_END = {t: " " for t in _SPACE} | {t: "\n" for t in _BREAK}
_APART = frozenset(("authorialNote", "foreign"))
#: What operators look into: these, and whatever has an id.
_HOLDERS = _H | _APART | {"table", "mod"}
_BLOCK = 1 << 20
_ENDS, _UNCLEAN, _REFERENCES = re.compile(rb">\s*(?=</)"), re.compile(rb"\xc2[\xad\xa0]"), re.compile(rb"&#|<!ENTITY")


def clean(t: str | None) -> str:
    return t.replace("\u00ad", "").replace("\u00a0", " ") if t else ""


def tidy(t: str) -> str:
    if "\n" not in t:
        return t.strip()
    if len(t) > _BLOCK:  # the lines of one block at a time
        blocks, i = [], 0
        while i < len(t):
            j = t.find("\n", i + _BLOCK // 2)
            j = len(t) if j < 0 else j
            blocks.append(_tidy_lines(t[i:j]))
            i = j + 1
        return "\n".join([x for x in blocks if x])
    return _tidy_lines(t)


def _tidy_lines(t: str) -> str:
    return "\n".join([x for x in [line.strip() for line in t.split("\n")] if x])


def _local(tag) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


_FIELDS = tuple(x.split()[0] for x in NODE_SCHEMA.replace(_STEP, "step").replace("map<string,string>", "map").split(", "))
_KINDS = {n: pa.int32() for n in ("ord", "end_ord", "parent_ord", "owner_ord", "depth", "component")} | {"is_eid_leaf": pa.bool_()}
#: A batch goes out at so many rows or characters of text; a document of more bytes is read twice, and in pieces of CHUNK; so many pieces of text are made one.
_EMIT, _EMIT_CHARS, _LONG, _CHUNK, _PIECES = 8000, 4 << 20, 256 << 10, 64 << 10, 1024


def _joined(pieces: list, tabled: bool):
    """One piece of many. A piece that holds a table is a pair: its text, and what of it isn't in tables."""
    if not tabled:
        return "".join(pieces)
    return "".join([p if type(p) is str else p[0] for p in pieces]), "".join([p if type(p) is str else p[1] for p in pieces])


class _Open:
    """An element that hasn't ended."""

    __slots__ = ("attrs", "begin", "component", "eid", "heading", "held", "inside", "leaf", "merged", "near", "note_begin", "notes", "num", "ord", "owner", "path", "step", "stream", "tabled", "tag")


class _Walk:
    """The parser's target: rows of one document, or with ``rows`` None only the labels of what structures the text."""

    def __init__(self, rows: Rows | None, doc_id, marked: bool, all_notes: bool, labels: dict, out: list | None):
        self.rows, self.doc_id, self.marked, self.all_notes, self.labels, self.out = rows, doc_id, marked, all_notes, labels, out
        self.frames: list[_Open] = []
        self.names: dict[str, str] = {}
        self.n = self.components = self.state = self.chars = 0
        self.wrong: str | None = None

    def start(self, name: str, attrib: dict) -> None:
        tag = self.names.get(name)
        if tag is None:
            tag = self.names[name] = _local(name)
        frames = self.frames
        if not frames:
            # the document's element, then its first child; what comes behind that is read and left
            if self.state == 0:
                self.state, self.wrong = (1, 'NotAkn("empty")') if tag == "akomaNtoso" else (2, f'NotAkn("{tag}")')
                return
            if self.state == 2:
                return
            self.state, self.wrong = 2, None
        f = _Open()
        f.tag, f.ord = tag, self.n
        self.n += 1
        f.attrs = {_local(k): clean(v) if self.marked else v for k, v in attrib.items()} if attrib else attrib
        f.eid = f.near = eid = f.attrs.get("eId")
        f.leaf = eid is not None
        f.num = f.heading = f.step = f.notes = None
        f.tabled = False
        if frames:
            up = frames[-1]
            f.owner = up if up.eid is not None else up.owner
            if eid is None:
                f.near = up.near
            elif f.owner is not None:
                f.owner.leaf = False
            f.path, f.component, f.held, f.stream, f.notes = up.path, up.component, up.inside, up.stream, up.notes
        else:
            f.owner = f.component = None
            f.path, f.held, f.stream = (), (), []
        f.inside = (*f.held, f.ord) if f.leaf or tag in _HOLDERS else f.held
        if tag == "component":
            f.component, self.components = self.components, self.components + 1
        elif tag == "table":
            for x in reversed(frames):
                if x.tabled:
                    break
                x.tabled = True
        if tag in _H:
            f.step = [f.ord, eid, tag, *self.labels.pop(f.ord, (None, None))]
            f.path = (*f.path, f.step)
        if tag in _APART:
            f.stream = []
            if tag == "foreign":
                f.notes = None
        if f.notes is None and (self.all_notes or tag == "ref"):
            f.notes = []
        f.begin = f.merged = len(f.stream)
        f.note_begin = len(f.notes) if f.notes is not None else 0
        frames.append(f)

    def data(self, text: str) -> None:
        if not self.frames:
            return
        f = self.frames[-1]
        if self.marked:
            text = clean(text)
        self.chars += len(text)
        f.stream.append(text)
        if f.notes is not None:
            f.notes.append(text)

    def end(self, name: str) -> None:
        frames = self.frames
        if not frames:
            return
        f = frames.pop()
        tag, rows = f.tag, self.rows
        piece = _joined(f.stream[f.begin :], f.tabled)
        del f.stream[f.begin :]
        raw, bare = piece if f.tabled else (piece, None)
        text = tidy(raw) if rows is not None or tag in ("num", "heading") else None
        notes = None
        if f.notes is not None:
            told = "".join(f.notes[f.note_begin :])
            f.notes[f.note_begin :] = (told,)
            if tag == "ref" or self.all_notes:
                notes = tidy(told)
        up = frames[-1] if frames else None
        if up is not None:
            if tag == "num":
                if up.num is None:
                    up.num = text
                    if up.step:
                        up.step[3] = text
            elif tag == "heading" and up.heading is None:
                up.heading = text
                if up.step:
                    up.step[4] = text
            if tag not in _APART:
                up.stream.append((raw, "") if tag == "table" else piece)
            if tag in _END:
                up.stream.append(_END[tag])
            if up.notes is not None and tag in _NOTE_BREAK:
                up.notes.append("\n")
            if len(up.stream) - up.merged > _PIECES:
                up.stream[up.merged :] = (_joined(up.stream[up.merged :], up.tabled),)
                up.merged = len(up.stream)
        if rows is None:
            if f.step and (f.num is not None or f.heading is not None):
                self.labels[f.ord] = (f.num, f.heading)
            return
        rows.add((self.doc_id, f.ord, self.n - 1, up.ord if up else None, f.owner.ord if f.owner else None, len(frames), tag, f.attrs, f.eid, f.near, text, notes, tidy(bare) if bare is not None else None, f.num, f.heading, f.path, f.leaf, f.component, None, f.held))
        if self.out is not None and rows.full():
            self.out.append(rows.batch())

    def close(self) -> None:
        pass


class Rows:
    """Rows in the schema's order, until they are made a batch."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.chars = 0

    def full(self) -> bool:
        return len(self.rows) >= _EMIT or self.chars >= _EMIT_CHARS

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        self.chars += sum([len(x) for x in row[10:13] if x])

    def fail(self, doc_id, error: str) -> None:
        self.rows.append((doc_id, *[error if n == "error" else None for n in _FIELDS[1:]]))

    def document(self, doc_id, xml, marked: bool, all_notes: bool = False):
        """Adds the rows of one document; yields batches of a long one. Raises ValueError (not legal XML) or ET.ParseError, and then there are none."""
        xml = memoryview(xml)
        long = len(xml) > _LONG
        labels: dict[int, tuple] = {}
        out: list[pa.RecordBatch] = []
        mine = Rows()
        for rows in (None, self) if long else (mine,):
            walk = _Walk(rows, doc_id, marked, all_notes, labels, out if long else None)
            parser = ET.XMLParser(target=walk)
            for piece in _pieces(xml, walk):
                parser.feed(piece)
                yield from out
                out.clear()
            parser.close()  # which can still end elements
            yield from out
            if walk.wrong:
                raise ValueError(walk.wrong)
        self.rows += mine.rows
        self.chars += mine.chars

    def batch(self) -> pa.RecordBatch:
        cols = dict(zip(_FIELDS, zip(*self.rows, strict=True), strict=True))
        self.rows, self.chars = [], 0
        strings = pa.string()
        offsets = lambda x: pa.array(np.concatenate([[0], np.cumsum([len(v) if v else 0 for v in x])]).astype(np.int32), mask=np.array([v is None for v in x] + [False]))
        attrs, path, above = cols["attrs"], cols["path"], cols["above"]
        at: dict[int, int] = {}
        steps: list[list] = []
        places = []
        for p in path:
            for s in p or ():
                if id(s) not in at:
                    at[id(s)] = len(steps)
                    steps.append(s)
                places.append(at[id(s)])
        made = {n: pa.array(v, _KINDS.get(n, strings)) for n, v in cols.items() if n not in ("attrs", "path", "above")}
        made["attrs"] = pa.MapArray.from_arrays(offsets(attrs), pa.array([k for a in attrs if a for k in a], strings), pa.array([v for a in attrs if a for v in a.values()], strings))
        step = pa.StructArray.from_arrays([pa.array([s[k] for s in steps], pa.int32() if k == 0 else strings) for k in range(5)], ["ord", "eid", "kind", "num", "heading"])
        made["path"] = pa.ListArray.from_arrays(offsets(path), step.take(pa.array(places, pa.int64())))
        made["above"] = pa.ListArray.from_arrays(offsets(above), pa.array([i for a in above if a for i in a], pa.int32()))
        return pa.RecordBatch.from_arrays([made[n] for n in _FIELDS], list(_FIELDS))


def _pieces(xml: memoryview, walk: _Walk):
    """The source in pieces. Where much text was read, elements that end together come one by one, as each may hold all of it."""
    for i in range(0, max(1, len(xml)), _CHUNK):
        chunk, begin = xml[i : i + _CHUNK], 0
        if walk.chars > _EMIT_CHARS:
            for m in _ENDS.finditer(chunk):
                yield chunk[begin : m.end()]
                begin = m.end()
        yield chunk[begin:]


def _source(xml) -> tuple:
    """UTF-8 without the characters that ``clean`` replaces, and whether references may bring others. Not copied without need."""
    if _UNCLEAN.search(xml):
        xml = bytes(xml).replace(b"\xc2\xad", b"").replace(b"\xc2\xa0", b" ")
    return xml, _REFERENCES.search(xml) is not None


def document_rows(xml: str | bytes) -> list[dict]:
    """Rows of one document with all texts, in order, for looking at. Raises ValueError (not legal XML) or ET.ParseError."""
    r = Rows()
    batches = list(r.document(None, *((xml, True) if isinstance(xml, bytes) else _source(xml.encode())), True))
    batches += [r.batch()] if r.rows else []
    return sorted([x for b in batches for x in b.to_pylist()], key=lambda x: x["ord"])


def _parse(all_notes: bool):
    def run(batches):
        r = Rows()
        for b in batches:
            for i, xml in zip(b.column("doc_id").to_pylist(), b.column("xml"), strict=True):
                try:
                    yield from r.document(i, *_source(xml.as_buffer() if xml.is_valid else b""), all_notes)
                except ET.ParseError as e:
                    r.fail(i, f"Parse({e})")
                except ValueError as e:
                    r.fail(i, str(e))
                if r.full():
                    yield r.batch()
        if r.rows:
            yield r.batch()

    return run


def parse_nodes(docs: DataFrame, id_col: str = "doc_id", xml_col: str = "xml", all_notes: bool = False) -> DataFrame:
    """The node table of docs(doc_id, xml). A document that can't be read gives one row with ``error`` and no node."""
    return docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(xml_col).cast("string").alias("xml")).mapInArrow(_parse(all_notes), NODE_SCHEMA)
