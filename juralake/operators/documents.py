"""Document operators over the node table (one row per element, see sources.legal_xml).

All take nodes of many documents. ``ord`` is the preorder number and
``[ord, end_ord]`` a subtree, so scopes are comparisons on one document's rows.
Rows with an error and no node are left out first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import HIERARCHY_TAGS, normalize_eid, snippet, unlinked_ref, work_eli_path
from ..plans.lineage import cut

FOREIGN_KINDS = tuple((kind, tuple(tags.split())) for kind, tags in (
    ("svg", "circle g path rect svg"),
    ("mathml", "math mfrac mi mn mo mrow msub msup mtext"),
    ("skos", "Concept altLabel notation prefLabel"),
    ("ooxml", "AlternateContent Choice Fallback"),
))
STUB_CHARS, OVERSIZED_ROWS = 100, 100
_MARKS = ("chapter", "section", "title", "part", "book")


def _ok(nodes: DataFrame) -> DataFrame:
    return nodes.where("ord is not null")


def body_of(nodes: DataFrame) -> DataFrame:
    """doc_id, body_ord, body_end of each document: its body, or else its mainBody."""
    b = _ok(nodes).where("parent_ord = 0 and tag in ('body', 'mainBody')").groupBy("doc_id")
    pick = F.min(F.struct(F.when(F.col("tag") == "body", 0).otherwise(1).alias("k"), F.col("ord").alias("body_ord"), F.col("end_ord").alias("body_end")))
    return b.agg(pick.alias("b")).select("doc_id", "b.body_ord", "b.body_end")


def within_body(nodes: DataFrame) -> DataFrame:
    return _ok(nodes).join(body_of(nodes), "doc_id").where("ord >= body_ord and ord <= body_end")


def holders(rows: DataFrame, name: str) -> DataFrame:
    """rows, once for each element above that can hold others, with its number as ``name``: a subtree's rows by equi-join, however many a document has."""
    return rows.withColumn(name, F.explode("above")).drop("above")


def errors(nodes: DataFrame) -> DataFrame:
    return nodes.where("error is not null").select("doc_id", "error")


def frbr_metadata(nodes: DataFrame) -> DataFrame:
    """doc_id, eli_work, eli_expression, eli_manifestation, number, title, language, dates, author, expression_count. Documents without a work id are absent.

    One pass: the block's elements of a document are collected in order into arrays, and values picked from them.
    """
    keep = ("meta", "identification", "FRBRWork", "FRBRExpression", "FRBRManifestation", "FRBRuri", "FRBRthis", "FRBRname", "FRBRnumber", "FRBRlanguage", "FRBRdate", "FRBRauthor", "TLCOrganization")
    n = _ok(nodes).where(F.col("tag").isin(*keep) & F.col("component").isNull())
    item = F.struct("ord", "tag", F.col("parent_ord").alias("up"), "end_ord", F.col("attrs")["value"].alias("value"), F.col("attrs")["language"].alias("language"), F.col("attrs")["lang"].alias("lang"), F.col("attrs")["name"].alias("name"), F.col("attrs")["date"].alias("date"), F.col("attrs")["href"].alias("href"), F.col("eid"), F.col("attrs")["showAs"].alias("show"))
    d = n.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("x"))

    def first(cond) -> Column:
        return F.get(F.filter("x", cond), F.lit(0))

    def inside(tag: str, up: str, field: str) -> Column:
        return F.get(F.filter("x", lambda e: (e["tag"] == tag) & (e["up"] == F.col(up)["ord"])), F.lit(0))[field]

    d = d.withColumn("meta", first(lambda e: (e["tag"] == "meta") & (e["up"] == 0)))
    d = d.withColumn("ident", first(lambda e: (e["tag"] == "identification") & (e["up"] == F.col("meta")["ord"])))
    d = d.withColumn("work", first(lambda e: (e["tag"] == "FRBRWork") & (e["up"] == F.col("ident")["ord"])))
    exprs = F.filter("x", lambda e: (e["tag"] == "FRBRExpression") & (e["ord"] > F.col("ident")["ord"]) & (e["ord"] <= F.col("ident")["end_ord"]))
    d = d.withColumn("expr", F.get(exprs, F.lit(0))).withColumn("expression_count", F.size(exprs))
    d = d.withColumn("mani", first(lambda e: (e["tag"] == "FRBRManifestation") & (e["up"] == F.col("ident")["ord"])))
    uri = lambda up: F.coalesce(inside("FRBRuri", up, "value"), inside("FRBRthis", up, "value"))
    d = d.withColumn("language", inside("FRBRlanguage", "expr", "language"))
    names = F.filter("x", lambda e: (e["tag"] == "FRBRname") & (e["up"] == F.col("work")["ord"]))
    own = F.filter(names, lambda e: e["lang"].eqNullSafe(F.col("language")))
    dates = F.transform(F.filter("x", lambda e: (e["tag"] == "FRBRdate") & (e["ord"] > F.col("work")["ord"]) & (e["ord"] <= F.col("work")["end_ord"]) & e["name"].isNotNull() & e["date"].isNotNull()), lambda e: F.struct(e["name"].alias("name"), e["date"].alias("date")))
    anchor = F.regexp_replace(inside("FRBRauthor", "work", "href"), "^#+", "")
    author = F.get(F.filter("x", lambda e: (e["tag"] == "TLCOrganization") & (e["eid"] == anchor) & (e["ord"] <= F.col("meta")["end_ord"])), F.lit(0))["show"]
    out = d.select("doc_id", uri("work").alias("eli_work"), uri("expr").alias("eli_expression"), uri("mani").alias("eli_manifestation"), inside("FRBRnumber", "work", "value").alias("number"), F.coalesce(F.get(own, F.lit(0)), F.get(names, F.lit(0)))["value"].alias("title"), "language", dates.alias("dates"), author.alias("author"), "expression_count")
    return out.where("eli_work is not null")


def classify(nodes: DataFrame) -> DataFrame:
    """doc_id, pattern, has_body and counts of articles, levels, mods (in the body) and components (anywhere).

    What lies below one parent is in the body or outside it together, so rows are counted by parent where they are read, and these counts, not the rows, meet the body.
    """
    # the root stands for documents without any of these; what is next below it is never in the body
    n = _ok(nodes).where((F.col("ord") == 0) | F.col("tag").isin("article", "level", "mod", "component", *_MARKS))
    count = lambda *tags: F.count(F.when(F.col("tag").isin(*tags), 1))
    n = n.groupBy("doc_id", F.coalesce("parent_ord", F.lit(0)).alias("up")).agg(count("article").alias("articles"), count("level").alias("levels"), count("mod").alias("mods"), count(*_MARKS).alias("marks"), count("component").alias("components"))
    n = n.join(body_of(nodes), "doc_id", "left")
    inside = F.coalesce((F.col("up") >= F.col("body_ord")) & (F.col("up") <= F.col("body_end")), F.lit(False))
    total = lambda name: F.coalesce(F.sum(F.when(inside, F.col(name))), F.lit(0)).cast("int")
    d = n.groupBy("doc_id").agg(F.max(F.col("body_ord").isNotNull()).alias("has_body"), total("articles").alias("article_count"), total("levels").alias("level_count"), total("mods").alias("mod_count"), total("marks").alias("marks"), F.coalesce(F.sum("components"), F.lit(0)).cast("int").alias("component_count"))
    pattern = F.when(~F.col("has_body"), "NoBody").when((F.col("article_count") > 0) & (F.col("marks") > 0), "Structured").when(F.col("article_count") > 0, "FlatArticles").when(F.col("level_count") > 0, "LevelBased").when(F.col("mod_count") > 0, "Amendment").otherwise("Other")
    return d.select("doc_id", pattern.alias("pattern"), "has_body", "article_count", "level_count", "mod_count", "component_count")


def structure(nodes: DataFrame, kind: str | None = None) -> DataFrame:
    """doc_id, ord, depth, parent_ord, eid, kind, num, heading: the body's outline as flat rows; depth and parent count structuring elements only. ``kind`` keeps one sort, flat."""
    b = within_body(nodes).where(F.col("tag").isin(*HIERARCHY_TAGS))
    if kind is not None:
        return b.where(F.col("tag") == kind).select("doc_id", "ord", F.lit(0).alias("depth"), F.lit(None).cast("int").alias("parent_ord"), "eid", F.col("tag").alias("kind"), "num", "heading")
    parent = F.get("path", F.size("path") - 2)["ord"]
    return b.select("doc_id", "ord", (F.size("path") - 1).alias("depth"), F.when(F.size("path") > 1, parent).alias("parent_ord"), "eid", F.col("tag").alias("kind"), "num", "heading")


def resolve_eids(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """doc_id, requested, ord, duplicates, via_normalization for requests(doc_id, eid): the first element with the id; only without one, the first whose normalised id is equal. Requests without any are absent."""
    n = _ok(nodes).where("eid is not null").select("doc_id", "ord", "eid", normalize_eid(F.col("eid")).alias("norm"))
    r = requests.select("doc_id", F.col("eid").alias("requested"), normalize_eid(F.col("eid")).alias("norm")).distinct()
    # equal ids have equal normal forms, so one join serves both steps
    d = n.join(r, ["doc_id", "norm"]).withColumn("exact", F.col("eid") == F.col("requested")).groupBy("doc_id", "requested")
    d = d.agg(F.min(F.when(F.col("exact"), F.col("ord"))).alias("a"), F.count(F.when(F.col("exact"), 1)).alias("na"), F.min("ord").alias("b"), F.count("*").alias("nb"))
    hit = F.col("na") > 0
    return d.select("doc_id", "requested", F.when(hit, F.col("a")).otherwise(F.col("b")).alias("ord"), (F.when(hit, F.col("na")).otherwise(F.col("nb")) - 1).cast("int").alias("duplicates"), (~hit).alias("via_normalization"))


def section_paths(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """doc_id, requested, path: structuring elements from the root to the element, itself included."""
    return resolve_eids(nodes, requests).join(_ok(nodes).select("doc_id", "ord", "path"), ["doc_id", "ord"]).select("doc_id", "requested", "path")


def _notes(nodes: DataFrame) -> DataFrame:
    """doc_id, at, marker, text, refs of all notes."""
    n = _ok(nodes)
    notes = n.where("tag = 'authorialNote'").select("doc_id", F.col("ord").alias("at"), F.col("attrs")["marker"].alias("marker"), "text")
    refs = holders(n.where("tag = 'ref' and attrs['href'] is not null").select("doc_id", F.col("ord").alias("ref_ord"), F.col("attrs")["href"].alias("href"), "above"), "at")
    got = refs.groupBy("doc_id", "at").agg(F.transform(F.array_sort(F.collect_list(F.struct("ref_ord", "href"))), lambda x: x["href"]).alias("refs"))
    return notes.join(got, ["doc_id", "at"], "left").withColumn("refs", F.coalesce("refs", F.array().cast("array<string>")))


def element_texts(nodes: DataFrame, requests: DataFrame | None = None, kind: str | None = None) -> DataFrame:
    """doc_id, ord, eid, kind, num, heading, text, notes, section_path of requested elements (None: of every element with an id, or of those of a kind). Notes are apart from the text; steps without an id aren't in the path."""
    n = _ok(nodes)
    if requests is not None:
        n = n.join(resolve_eids(nodes, requests).select("doc_id", "ord"), ["doc_id", "ord"], "left_semi")
    n = n.where("eid is not null") if kind is None else n.where((F.col("tag") == kind) & F.col("eid").isNotNull())
    # a note is in each element above it; texts come in by key at the end
    where = holders(_ok(nodes).where("tag = 'authorialNote'").select("doc_id", F.col("ord").alias("at"), "above"), "ord")
    notes = _notes(nodes).withColumnRenamed("text", "note")
    j = where.join(n.select("doc_id", "ord"), ["doc_id", "ord"], "left_semi").join(notes, ["doc_id", "at"])
    got = j.groupBy("doc_id", "ord").agg(F.array_sort(F.collect_list(F.struct("at", "marker", F.col("note").alias("text"), "refs"))).alias("notes"))
    listed = F.transform("notes", lambda x: F.struct(x["marker"].alias("marker"), x["text"].alias("text"), x["refs"].alias("refs")))
    e = n.select("doc_id", "ord", "eid", F.col("tag").alias("kind"), "num", "heading", "text", F.filter(F.transform("path", lambda s: s["eid"]), lambda x: x.isNotNull()).alias("section_path"))
    none = F.array().cast("array<struct<marker:string,text:string,refs:array<string>>>")
    return e.join(got, ["doc_id", "ord"], "left").withColumn("notes", F.coalesce(listed, none))


def article_texts(nodes: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """element_texts of articles. With requests, an element of another kind gives a row with ``error`` instead of text."""
    if requests is None:
        return element_texts(nodes, kind="article").withColumn("error", F.lit(None).cast("string"))
    d = element_texts(nodes, requests)
    wrong = F.col("kind") != "article"
    return d.withColumn("error", F.when(wrong, F.concat(F.lit("WrongElementKind("), "kind", F.lit(")")))).withColumn("text", F.when(~wrong, F.col("text")))


def readable(nodes: DataFrame) -> DataFrame:
    """doc_id, markdown: title and number, preamble, then the body: labels of structuring elements that hold others as headings, the rest as blocks of text."""
    n = _ok(nodes)
    meta = frbr_metadata(nodes).select("doc_id", "title", "number")
    b = within_body(nodes).where("ord > body_ord").select("doc_id", "ord", "end_ord", "tag", "text", "num", "heading", "path", "body_ord", F.col("tag").isin(*HIERARCHY_TAGS).alias("h"))
    # holds others: the next structuring element in order lies inside. Below a leaf nothing is rendered, and leaves hold none, so structuring elements are enough
    hier = b.where("h").withColumn("next", F.lead("ord").over(Window.partitionBy("doc_id").orderBy("ord")))
    holds = F.coalesce(F.col("next") <= F.col("end_ord"), F.lit(False))
    label = F.concat_ws(" ", "num", "heading")
    hidden = n.where("tag in ('authorialNote', 'foreign')").select("doc_id", F.col("ord").alias("at"))
    under = holders(n.where(F.col("tag").isin(*HIERARCHY_TAGS)).select("doc_id", "ord", "above"), "at").join(hidden, ["doc_id", "at"], "left_semi").select("doc_id", "ord")
    hier = hier.join(under, ["doc_id", "ord"], "left_anti")
    block = F.when(holds, F.when(label != "", F.concat(F.repeat(F.lit("#"), F.least(F.size("path") + 1, F.lit(6))), F.lit(" "), label))).otherwise(F.when(F.col("text") != "", F.col("text")))
    blocks = hier.select("doc_id", "ord", block.alias("block")).where("block is not null")
    preamble = n.where("tag = 'preamble' and parent_ord = 0 and text <> ''").select("doc_id", F.lit(-1).alias("ord"), F.col("text").alias("block"))
    head = meta.select("doc_id", F.explode(F.array(F.struct(F.lit(-3).alias("ord"), F.concat(F.lit("# "), "title").alias("block")), F.struct(F.lit(-2).alias("ord"), F.concat(F.lit("**"), "number", F.lit("**")).alias("block")))).alias("x")).select("doc_id", "x.ord", "x.block").where("block is not null")
    all_ = head.unionByName(preamble).unionByName(blocks).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "block"))).alias("x"))
    return all_.select("doc_id", F.regexp_replace(F.array_join(F.transform("x", lambda x: x["block"]), "\n\n"), r"\s+\z", "").alias("markdown"))


def search(nodes: DataFrame, query: str, max_hits: int | None = 20) -> DataFrame:
    """doc_id, ord, eid, kind, snippet: the first match in each element with an id but none below it; per document the first ``max_hits`` (at most 100). An empty query finds nothing."""
    d = _ok(nodes).where("is_eid_leaf")
    d = d.where(F.lit(False)) if not query else d.where(F.contains(F.lower("text"), F.lit(query.lower())))
    d = d.select("doc_id", "ord", "eid", F.col("tag").alias("kind"), snippet(F.col("text"), query or " ").alias("snippet"))
    if max_hits is None:
        return d
    return d.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))).where(F.col("_n") <= min(max_hits, 100)).drop("_n")


def modifications(nodes: DataFrame) -> DataFrame:
    """doc_id, mod_ord, mod_eid, quoted_root_kind, quoted_eid, new_text of every mod: its first quotedStructure's first child. Without one, nulls and an empty text."""
    n = _ok(nodes)
    mods = n.where("tag = 'mod'").select("doc_id", F.col("ord").alias("mod_ord"), F.col("eid").alias("mod_eid"))
    q = holders(n.where("tag = 'quotedStructure'").select("doc_id", F.col("ord").alias("q_ord"), "above"), "mod_ord").groupBy("doc_id", "mod_ord").agg(F.min("q_ord").alias("q_ord"))
    first = mods.join(q, ["doc_id", "mod_ord"], "left")
    # the first element below another has the next number
    child = n.where("parent_ord = ord - 1").select("doc_id", F.col("parent_ord").alias("q_ord"), F.struct("tag", "eid", "text").alias("c"))
    return first.join(child, ["doc_id", "q_ord"], "left").select("doc_id", "mod_ord", "mod_eid", F.col("c.tag").alias("quoted_root_kind"), F.col("c.eid").alias("quoted_eid"), F.coalesce("c.text", F.lit("")).alias("new_text"))


def _with_parent_eid(rows: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    up = _ok(nodes).select("doc_id", F.col("ord").alias("parent_ord"), F.col("nearest_eid").alias(name))
    return rows.join(up, ["doc_id", "parent_ord"], "left")


def _scope(rows: DataFrame, nodes: DataFrame, within: DataFrame | None) -> DataFrame:
    """Rows inside the elements that within(doc_id, eid) names."""
    if within is None:
        return rows
    s = resolve_eids(nodes, within).select("doc_id", F.col("ord").alias("lo")).distinct()
    above = _ok(nodes).select("doc_id", "ord", F.array_append("above", F.col("ord")).alias("above"))
    inside = holders(above.join(rows.select("doc_id", "ord"), ["doc_id", "ord"], "left_semi"), "lo").join(s, ["doc_id", "lo"], "left_semi")
    return rows.join(inside.select("doc_id", "ord"), ["doc_id", "ord"], "left_semi")


def change_notes(nodes: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """doc_id, ord, anchor_eid, marker, text, refs of all notes in scope; the anchor is the nearest id of the note's parent."""
    n = _scope(_ok(nodes).where("tag = 'authorialNote'").select("doc_id", "ord", "parent_ord"), nodes, within)
    d = _with_parent_eid(n, nodes, "anchor_eid").join(_notes(nodes).withColumnRenamed("at", "ord"), ["doc_id", "ord"])
    return d.select("doc_id", "ord", "anchor_eid", "marker", "text", "refs")


def references(nodes: DataFrame) -> DataFrame:
    """doc_id, ord, source_eid, href, label of every reference, notes and components included; for those without a link, ``parsed`` is the label's kind and value."""
    r = _ok(nodes).where("tag = 'ref'").select("doc_id", "ord", "parent_ord", F.col("attrs")["href"].alias("href"), F.col("text_notes").alias("label"))
    d = _with_parent_eid(r, nodes, "source_eid")
    return d.select("doc_id", "ord", "source_eid", "href", "label", F.when(F.col("href").isNull(), unlinked_ref(F.col("label"))).alias("parsed"))


_HEAD = ("mainBody", "meta", "identification", "FRBRWork", "FRBRuri", "FRBRthis", "FRBRname")


def _inner_documents(nodes: DataFrame) -> DataFrame:
    """doc_id, index, c_ord, outer (the component's own number) and d, the document inside, of each component.

    The first element below another has the next number, so it is found by key; no text is read. Joins on components are by sort: their ids compress well, and what looks small enough to broadcast would be ten times that in the driver.
    """
    n = _ok(nodes)
    comp = n.where("tag = 'component'").select("doc_id", F.col("component").alias("outer"), F.col("ord").alias("c_ord"), F.col("parent_ord").alias("c_up"))
    comp = comp.withColumn("index", F.row_number().over(Window.partitionBy("doc_id").orderBy("c_ord")) - 1)
    d = F.struct("ord", "end_ord", "depth", F.size("path").alias("steps"), "tag", "component", F.col("attrs")["name"].alias("name")).alias("d")
    first = n.where("parent_ord = ord - 1").select("doc_id", F.col("parent_ord").alias("c_ord"), d)
    return comp.join(first.hint("merge"), ["doc_id", "c_ord"], "left")


def components(nodes: DataFrame) -> DataFrame:
    """doc_id, index, ord (of the inner document), doc_name, eli_work, title, is_empty_stub for each component.

    The few elements that tell about a component are collected in order by its number, and values picked from them.
    """
    item = F.struct("ord", "tag", F.col("parent_ord").alias("up"), F.col("attrs")["value"].alias("value"), F.when(F.col("tag") == "mainBody", F.length("text")).alias("chars"))
    head = _ok(nodes).where(F.col("tag").isin(*_HEAD) & F.col("component").isNotNull()).groupBy("doc_id", "component").agg(F.array_sort(F.collect_list(item)).alias("x"))
    c = _inner_documents(nodes).withColumn("component", F.col("d.component")).join(head.hint("merge"), ["doc_id", "component"], "left")

    def child(up: Column, tag: str) -> Column:
        return F.get(F.filter("x", lambda e: (e["tag"] == tag) & (e["up"] == up)), F.lit(0))

    c = c.withColumn("m", child(F.col("d.ord"), "meta")["ord"]).withColumn("i", child(F.col("m"), "identification")["ord"]).withColumn("w", child(F.col("i"), "FRBRWork")["ord"])
    value = lambda tag: child(F.col("w"), tag)["value"]
    stub = F.coalesce(child(F.col("d.ord"), "mainBody")["chars"], F.lit(0)) < STUB_CHARS
    return c.select("doc_id", F.col("index").cast("int").alias("index"), F.col("d.ord").alias("ord"), F.col("d.name").alias("doc_name"), F.coalesce(value("FRBRuri"), value("FRBRthis")).alias("eli_work"), value("FRBRname").alias("title"), stub.alias("is_empty_stub"))


def component_documents(nodes: DataFrame, keep_stubs: bool = True) -> DataFrame:
    """The node table of all components as documents of their own: doc_id ``<doc>#<index>``, numbers counted from the inner document, paths and nearest ids without what lies above.

    Elements carry the number of their component, so they are found by key; only components in components are followed upwards, once a level. Components are computed once, and checkpointed.
    """
    every = cut(_inner_documents(nodes).where("d is not null"))
    tops = every
    if not keep_stubs:
        tops = tops.join(components(nodes).where("not is_empty_stub").select("doc_id", "index").hint("merge"), ["doc_id", "index"], "left_semi")
    tops = tops.select("doc_id", "index", F.col("outer").alias("up"), F.col("d.ord").alias("base"), F.col("d.end_ord").alias("hi"), F.col("d.depth").alias("d0"), F.col("d.steps").alias("p0"), F.col("d.tag").alias("t0"), F.col("d.component").alias("c0"))
    # number of a component, and of each around it
    around = _ok(nodes).where("component is not null").select("doc_id", F.col("ord").alias("c_up"), F.col("component").alias("next"))
    outside = cut(every.select("doc_id", "outer", "c_up").join(around.hint("merge"), ["doc_id", "c_up"]).select("doc_id", F.col("outer").alias("up"), "next"))
    chain = level = every.select("doc_id", F.col("outer").alias("component"), F.col("outer").alias("up"))
    while not outside.isEmpty():
        level = cut(level.join(outside, ["doc_id", "up"]).select("doc_id", "component", F.col("next").alias("up")))
        if level.isEmpty():
            break
        chain = chain.unionByName(level)
    n = _ok(nodes).join(chain.join(tops.hint("merge"), ["doc_id", "up"]).drop("up").hint("merge"), ["doc_id", "component"]).where("ord >= base and ord <= hi")
    inner_owner = F.col("owner_ord") >= F.col("base")
    above = F.col("p0") - F.when(F.col("t0").isin(*HIERARCHY_TAGS), 1).otherwise(0)
    return n.select(
        F.concat("doc_id", F.lit("#"), "index").alias("doc_id"), (F.col("ord") - F.col("base")).alias("ord"), (F.col("end_ord") - F.col("base")).alias("end_ord"),
        F.when(F.col("ord") > F.col("base"), F.col("parent_ord") - F.col("base")).alias("parent_ord"), F.when(inner_owner, F.col("owner_ord") - F.col("base")).alias("owner_ord"), (F.col("depth") - F.col("d0")).alias("depth"), "tag", "attrs", "eid", F.coalesce("eid", F.when(inner_owner, F.col("nearest_eid"))).alias("nearest_eid"), "text", "text_notes", "text_no_tables", "num", "heading",
        F.transform(F.slice("path", above + 1, F.greatest(F.size("path") - above, F.lit(0))), lambda x: x.withField("ord", x["ord"] - F.col("base"))).alias("path"), "is_eid_leaf", F.when(F.col("component") != F.col("c0"), F.col("component")).alias("component"), "error",
        F.transform(F.filter("above", lambda x: x >= F.col("base")), lambda x: x - F.col("base")).alias("above"),
    )


def component_document(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(doc_id, index) with the component's document id, or an error that tells how many there are."""
    have = components(nodes).groupBy("doc_id").agg(F.count("*").cast("int").alias("available"))
    d = requests.select("doc_id", "index").distinct().join(have, "doc_id", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    ok = (F.col("index") >= 0) & (F.col("index") < F.col("available"))
    return d.select("doc_id", "index", F.when(ok, F.concat("doc_id", F.lit("#"), "index")).alias("component_id"), F.when(~ok, F.concat(F.lit("no component "), "index", F.lit("; available: "), "available")).alias("error"))


def tables(nodes: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """doc_id, ord, context_eid, rows, cols, header, data, oversized of every table. Rows are all tr below it; only the first may be a header; rows without td are dropped."""
    n = _ok(nodes)
    t = _scope(n.where("tag = 'table'").select("doc_id", "ord", "nearest_eid"), nodes, within).select("doc_id", F.col("ord").alias("t_ord"), F.col("nearest_eid").alias("context_eid"))
    cells = n.where("tag in ('th', 'td')").select("doc_id", "parent_ord", "ord", "tag", "text").groupBy("doc_id", F.col("parent_ord").alias("r_ord")).agg(F.array_sort(F.collect_list(F.struct("ord", "tag", "text"))).alias("cells"))
    tr = n.where("tag = 'tr'").select("doc_id", F.col("ord").alias("r_ord"), "above").join(cells, ["doc_id", "r_ord"], "left")
    pick = lambda tag: F.transform(F.filter("cells", lambda c: c["tag"] == tag), lambda c: c["text"])
    none = F.array().cast("array<string>")
    tr = holders(tr.select("doc_id", "r_ord", F.coalesce(pick("th"), none).alias("ths"), F.coalesce(pick("td"), none).alias("tds"), "above"), "t_ord")
    j = t.join(tr, ["doc_id", "t_ord"], "left")
    d = j.groupBy("doc_id", "t_ord", "context_eid").agg(F.array_sort(F.collect_list(F.when(F.col("r_ord").isNotNull(), F.struct("r_ord", "ths", "tds")))).alias("r"))
    head = F.size(F.get("r", F.lit(0))["ths"]) > 0
    data = F.transform(F.filter("r", lambda x, i: (F.size(x["tds"]) > 0) & ~((i == 0) & (F.size(x["ths"]) > 0))), lambda x: x["tds"])
    cols = F.coalesce(F.array_max(F.transform("r", lambda x: F.size(x["ths"]) + F.size(x["tds"]))), F.lit(0))
    return d.select("doc_id", F.col("t_ord").alias("ord"), "context_eid", F.size("r").alias("rows"), cols.alias("cols"), F.when(head, F.get("r", F.lit(0))["ths"]).otherwise(none).alias("header"), data.alias("data"), (F.size("r") > OVERSIZED_ROWS).alias("oversized"))


def foreign_content(nodes: DataFrame) -> DataFrame:
    """doc_id, ord, context_eid, kind, element_count of every foreign island."""
    n = _ok(nodes)
    f = n.where("tag = 'foreign'").select("doc_id", "ord", F.col("nearest_eid").alias("context_eid"))
    j = f.join(holders(n.select("doc_id", F.col("tag").alias("i_tag"), "above"), "ord"), ["doc_id", "ord"], "left")
    d = j.groupBy("doc_id", "ord", "context_eid").agg(F.collect_set("i_tag").alias("tags"), F.count("i_tag").cast("int").alias("element_count"))
    kind = F.coalesce(*[F.when(F.arrays_overlap("tags", F.array(*map(F.lit, names))), F.lit(k)) for k, names in FOREIGN_KINDS], F.lit("other"))
    return d.select("doc_id", "ord", "context_eid", kind.alias("kind"), "element_count")


def hollow(nodes: DataFrame) -> DataFrame:
    """doc_id, ord, eid, kind, is_leaf, text of every element with an id: leaves keep their text, others name the elements with ids next below, breadth first.

    The parser names each element's nearest one above with an id, so names are gathered by it; no text is shuffled.
    """
    e = _ok(nodes).where("eid is not null")
    out = lambda d, text: d.select("doc_id", "ord", "eid", F.col("tag").alias("kind"), F.col("is_eid_leaf").alias("is_leaf"), text.alias("text"))
    below = e.where("owner_ord is not null").groupBy("doc_id", F.col("owner_ord").alias("ord")).agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", F.col("ord").alias("o"), "eid"))), lambda x: x["eid"]).alias("kids"))
    stubs = e.where("not is_eid_leaf").select("doc_id", "ord", "eid", "tag", "is_eid_leaf").join(below, ["doc_id", "ord"])
    return out(e.where("is_eid_leaf"), F.col("text")).unionByName(out(stubs, F.concat(F.lit("[Siehe Unterelemente: "), F.array_join("kids", ", "), F.lit("]"))))


def provenance_id(meta: DataFrame) -> DataFrame:
    """doc_id, eli: the undated work path that answers about a document refer to."""
    return meta.select("doc_id", F.coalesce(work_eli_path(F.col("eli_work")), F.col("eli_work")).alias("eli"))


def regex_search(texts: DataFrame, pattern: str, text_col: str = "text", max_pattern: int = 200) -> DataFrame:
    """texts with ``matches``. Java's engine backtracks, so nested repeats and back references are refused and patterns are short. Texts of every length are searched; a null text gives null."""
    import re

    if len(pattern) > max_pattern or re.search(r"[+*}]\)?[+*{]|\([^)]*[+*][^)]*\)[+*{]|\\[1-9]|\(\?[=!<]", pattern):
        raise ValueError("pattern not allowed")
    return texts.withColumn("matches", F.regexp_extract_all(text_col, F.lit(pattern), F.lit(0)))

