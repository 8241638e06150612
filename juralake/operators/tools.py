"""The 25 tools: named operators with a pool, the least role that may call them, and a schema of their arguments.

``surface(tables)`` registers them over a source of tables: tables(name) gives an
input table by name, tables.nodes() the node table. A call names a law (or a
document) and gives a DataFrame; nothing is collected here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import catalogue, chunking, diff, documents, relations, resolve, temporal
from .service import Registry, Tool

NAMES = {
    "LocalNavigation": ("read_article", "read_element", "get_structure", "search_text", "get_metadata", "get_references", "get_modifications", "compare_versions", "extract_tables", "list_components", "detect_foreign_content", "read_document"),
    "Discovery": ("search_law", "resolve_sr_number", "find_related_topic"),
    "JoluxMetadata": ("check_in_force", "get_article_history", "get_citations", "get_impacts", "get_outgoing_impacts", "get_subdivisions", "get_taxonomy", "list_annexes", "list_versions", "resolve_consolidation_at"),
}
_TYPES = {str: "string", int: "integer", bool: "boolean"}


def schema(required: dict, optional: dict | None = None) -> dict:
    """JSON schema of a tool's arguments."""
    both = required | (optional or {})
    return {"type": "object", "properties": {k: {"type": _TYPES[t]} for k, t in both.items()}, "required": list(required), "additionalProperties": False}


def surface(t) -> Registry:
    """All tools over the tables of t."""
    reg = Registry()
    one = lambda **kw: t.spark.createDataFrame([tuple(kw.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in kw.items()))

    def doc(doc_id: str) -> DataFrame:
        return t.nodes().where(F.col("doc_id") == doc_id)

    def of(d: DataFrame, **keys) -> DataFrame:
        for k, v in keys.items():
            d = d.where(F.col(k) == v)
        return d

    def compare(doc_id: str, other: str) -> DataFrame:
        arts = lambda i: documents.article_texts(doc(i)).select(F.lit(doc_id).alias("work"), "eid", "text", "ord")
        return diff.compare_versions(arts(doc_id), arts(other))

    local = {
        "read_article": (lambda doc_id, eid: documents.article_texts(doc(doc_id), one(doc_id=doc_id, eid=eid)), {"doc_id": str, "eid": str}, {}),
        "read_element": (lambda doc_id, eid: documents.element_texts(doc(doc_id), one(doc_id=doc_id, eid=eid)), {"doc_id": str, "eid": str}, {}),
        "get_structure": (lambda doc_id, kind=None: documents.structure(doc(doc_id), kind), {"doc_id": str}, {"kind": str}),
        "search_text": (lambda doc_id, query, max_hits=None: documents.search(doc(doc_id), query, diff.clamp(max_hits, 20, 1, 100)), {"doc_id": str, "query": str}, {"max_hits": int}),
        "get_metadata": (lambda doc_id: documents.frbr_metadata(doc(doc_id)), {"doc_id": str}, {}),
        "get_references": (lambda doc_id: documents.references(doc(doc_id)), {"doc_id": str}, {}),
        "get_modifications": (lambda doc_id: documents.modifications(doc(doc_id)), {"doc_id": str}, {}),
        "compare_versions": (compare, {"doc_id": str, "other": str}, {}),
        "extract_tables": (lambda doc_id, eid=None: documents.tables(doc(doc_id), one(doc_id=doc_id, eid=eid) if eid else None), {"doc_id": str}, {"eid": str}),
        "list_components": (lambda doc_id: documents.components(doc(doc_id)), {"doc_id": str}, {}),
        "detect_foreign_content": (lambda doc_id: documents.foreign_content(doc(doc_id)), {"doc_id": str}, {}),
        "read_document": (lambda doc_id, chunks=False: chunking.chunk_documents(doc(doc_id)) if chunks else documents.readable(doc(doc_id)), {"doc_id": str}, {"chunks": bool}),
    }
    found = {
        "search_law": (lambda query, lang="de", limit=None: resolve.search_titles(t("works"), t("titles"), query, lang, diff.clamp(limit)), {"query": str}, {"lang": str, "limit": int}),
        "resolve_sr_number": (lambda number, lang="de": resolve.resolve_number(t("works"), t("titles"), number, lang), {"number": str}, {"lang": str}),
        "find_related_topic": (lambda work: catalogue.related_by_topic(t("work_topics"), t("topic_parents"), t("works"), one(work=work)), {"work": str}, {}),
    }
    graph = {
        "check_in_force": (lambda work, as_of: temporal.in_force(one(work=work), t("works"), as_of), {"work": str, "as_of": str}, {}),
        "list_versions": (lambda work: temporal.list_versions(of(t("consolidations"), work=work)), {"work": str}, {}),
        "resolve_consolidation_at": (lambda work, as_of, lang="de": temporal.consolidation_at(t("consolidations"), t("expressions"), t("manifestations"), as_of, lang, one(work=work)), {"work": str, "as_of": str}, {"lang": str}),
        "get_impacts": (lambda work, strict=False: relations.impacts_on(one(work=work), t("impacts"), strict), {"work": str}, {"strict": bool}),
        "get_outgoing_impacts": (lambda work, strict=False: relations.outgoing_impacts(one(work=work), t("impacts"), strict), {"work": str}, {"strict": bool}),
        "get_article_history": (lambda work, eid, strict=False: relations.article_history(one(work=work, eid=eid), t("impacts"), strict), {"work": str, "eid": str}, {"strict": bool}),
        "get_citations": (lambda work, direction="both": relations.citations_of(one(work=work), t("citations"), direction), {"work": str}, {"direction": str}),
        "get_taxonomy": (lambda work: catalogue.taxonomy(of(t("work_topics"), work=work), t("topic_labels"), t("topic_parents")), {"work": str}, {}),
        "get_subdivisions": (lambda work, type_uri=None: relations.subdivisions(t("parts"), type_uri, one(work=work)), {"work": str}, {"type_uri": str}),
        "list_annexes": (lambda work: relations.annexes(t("parts"), roots=one(work=work)), {"work": str}, {}),
    }
    for pool, tools, role in (("LocalNavigation", local, "Reader"), ("Discovery", found, "Navigator"), ("JoluxMetadata", graph, "Navigator")):
        for name, (run, required, optional) in tools.items():
            reg.register(Tool(name, pool, run, role, schema(required, optional)))
    return reg
