"""Subdivisions, impacts (amendments) and citations.

Tables: parts(child, parent, type); impacts(impact, source, target, type, date, comment); citations(source, target, description).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalize_eid
from ..plans.lineage import cut

ANNEX = "subdivision-type/annex"


def subdivisions(parts: DataFrame, type_uri: str | None = None, roots: DataFrame | None = None) -> DataFrame:
    """work, sub, type: everything that is part of a work, directly or not, however deep (roots(work): only below these).

    Semi-naive with doubling: pairs found in the last round are extended by all known paths, so a chain of n links takes about log2(n) rounds; known pairs are taken off, so cycles end. With roots, only what hangs below them is followed, a level at a time. Each round is checkpointed.
    """
    edges = cut(parts.select("child", "parent").where("child is not null and parent is not null").distinct())
    start = edges if roots is None else edges.join(roots.select(F.col("work").alias("parent")).distinct(), "parent", "left_semi")
    fresh = known = cut(start.select(F.col("parent").alias("work"), F.col("child").alias("sub")))
    while not fresh.isEmpty():
        onward = edges.select("parent", "child") if roots is not None else known.select(F.col("work").alias("parent"), F.col("sub").alias("child"))
        step = fresh.join(onward, fresh["sub"] == onward["parent"]).select("work", F.col("child").alias("sub")).distinct()
        fresh = cut(step.join(known, ["work", "sub"], "left_anti"))
        known = cut(known.unionByName(fresh))
    types = parts.groupBy(F.col("child").alias("sub")).agg(F.min("type").alias("type"))
    out = known.join(types, "sub", "left").select("work", "sub", "type")
    return out if type_uri is None else out.where(F.col("type") == type_uri)


def annexes(parts: DataFrame, **params) -> DataFrame:
    return subdivisions(parts, ANNEX, **params)


def works_of(ids: DataFrame, col: str, works: DataFrame, strict: bool) -> DataFrame:
    """col, work: the works whose id an id starts with, for the distinct ids in ``col``; as an equi-join on the work.

    A prefix join over many works would compare every pair. An id starts with a work if its first n characters are the work, n being the work's length; works have few lengths, so an id has a few candidates, which are looked up by hash. Ids of any depth, with or without a host, are alike. ``strict``: the id is the work or goes on with a slash.
    """
    w = works.select("work").where("work <> ''").distinct()
    sizes = w.agg(F.collect_set(F.length("work")).alias("sizes"))  # one row
    i = ids.select(col).where(F.col(col).isNotNull()).distinct().join(F.broadcast(sizes))
    fits = lambda n: (n <= F.length(col)) & (F.substring(F.col(col), n + 1, F.lit(1)).isin("", "/") if strict else F.lit(True))
    return i.select(col, F.explode(F.transform(F.filter("sizes", fits), lambda n: F.substring(F.col(col), F.lit(1), n))).alias("work")).join(w, "work").select(col, "work")


def _by_prefix(rows: DataFrame, col: str, works: DataFrame, strict: bool) -> DataFrame:
    """rows whose id in ``col`` starts with a work's id, once for each such work. Ids repeat far more than works do, so works are looked up once an id."""
    return rows.join(works_of(rows, col, works, strict), col)


def impacts_on(works: DataFrame, impacts: DataFrame, strict: bool = False) -> DataFrame:
    """work, impact, source, target, type, date, comment of changes to a work; neither distinct nor limited. Sort by date to show.

    By default an id that merely starts with the work's (…/76 and …/762) counts too; ``strict`` wants the work itself or a part of it.
    """
    return _by_prefix(impacts, "target", works, strict).select("work", "impact", "source", "target", "type", "date", "comment")


def article_history(requests: DataFrame, impacts: DataFrame, strict: bool = False) -> DataFrame:
    """Impacts on an element, for requests(work, eid): the target lies under the work and holds the normalised eid anywhere (``strict``: as whole steps)."""
    asked = requests.select("work", "eid").distinct()
    under = works_of(impacts, "target", requests, True).where(F.length("target") > F.length("work"))
    eid = normalize_eid(F.col("eid"))
    held = F.contains(F.concat("target", F.lit("/")), F.concat(F.lit("/"), eid, F.lit("/"))) if strict else F.contains("target", eid)
    hits = under.join(asked, "work").where(held)
    return impacts.join(hits, "target").select("work", "eid", "impact", "source", "target", "type", "date", "comment")


def outgoing_impacts(acts: DataFrame, impacts: DataFrame, strict: bool = False) -> DataFrame:
    """work, impact, target, type, date of the changes that an act makes elsewhere."""
    return _by_prefix(impacts.where("target is not null"), "source", acts, strict).select("work", "impact", "target", "type", "date")


def citations_of(works: DataFrame, citations: DataFrame, direction: str = "both", strict: bool = False) -> DataFrame:
    """work, source, target, description; one row for each (source, target), with the least description."""
    sides = {"out": ["source"], "in": ["target"], "both": ["source", "target"]}[direction]
    # a work depends on source and target alone, so copies of a pair go first
    c = citations.where("source is not null and target is not null").groupBy("source", "target").agg(F.min("description").alias("description"))
    # an id's works are listed once an id, and a pair's lists are united in its row: no copies of results are looked for
    for side in sides:
        lists = works_of(c, side, works, strict).groupBy(side).agg(F.collect_list("work").alias(f"_{side}"))
        c = c.join(lists, side, "left")
    none = F.array().cast("array<string>")
    every = [F.coalesce(f"_{side}", none) for side in sides]
    found = c.withColumn("work", F.explode(every[0] if len(every) == 1 else F.array_union(*every)))
    return found.select("work", "source", "target", "description")
