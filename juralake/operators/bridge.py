"""From a law's id and a date to its text: as-of resolution, files, parsing, elements, as one plan for all requests.

files(url, xml) stands for what a downloader has fetched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalize_eid
from ..plans.context import QueryStamp, with_provenance
from ..plans.lineage import stored
from ..sources import parse_nodes
from . import diff, documents, temporal


def fetch_documents(resolved: DataFrame, files: DataFrame) -> DataFrame:
    """Node table by URL of the resolved versions' files; a URL that several requests share is parsed once."""
    urls = resolved.select("url").distinct()
    return parse_nodes(files.join(urls, "url").dropDuplicates(["url"]), "url", "xml")


FEW_IDS = 100_000


def _asked_for(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of the parser's rows what answers about wanted(doc_id, eid) are made of: elements whose id, in its normal form, anyone asks for, and all notes and references. Parsed once and stored, so no other text is moved. Where ids are too many to be sent around, all elements with an id stay."""
    norms = wanted.select(normalize_eid(F.col("eid")).alias("norm")).distinct()
    n = nodes.where("ord is not null and (eid is not null or tag in ('authorialNote', 'ref'))").withColumn("norm", normalize_eid(F.col("eid")))
    if norms.limit(FEW_IDS + 1).count() <= FEW_IDS:
        n = n.join(F.broadcast(norms.withColumn("hit", F.lit(True))), "norm", "left").where("hit or tag in ('authorialNote', 'ref')")
    path = F.when(F.col("eid").isNotNull(), F.col("path")).alias("path")
    return stored(n.select("doc_id", "ord", "tag", "attrs", "eid", "num", "heading", "text", path, "above"))


def read_articles(requests: DataFrame, consolidations: DataFrame, expressions: DataFrame, manifestations: DataFrame, files: DataFrame, stamp: QueryStamp, lang: str = "de") -> DataFrame:
    """For requests(work, eid): work, requested, eid, num, heading, text, notes, section_path, error, provenance. Requests without version, file or element have an error and no text."""
    found = temporal.consolidation_at(consolidations, expressions, manifestations, stamp.as_of, lang, requests.select("work")).select("work", "url")
    asked = requests.select("work", F.col("eid").alias("requested")).distinct().join(found, "work", "left")
    wanted = asked.where("url is not null").select(F.col("url").alias("doc_id"), F.col("requested").alias("eid"))
    nodes = _asked_for(fetch_documents(found, files), wanted)
    hit = documents.resolve_eids(nodes, wanted)
    texts = documents.article_texts(nodes, wanted)
    got = hit.join(texts, ["doc_id", "ord"]).withColumnRenamed("doc_id", "url")
    out = asked.join(got, ["url", "requested"], "left")
    error = F.when(F.col("url").isNull(), "NotFound(version)").when(F.col("eid").isNull(), "NotFound(element)").otherwise(F.col("error"))
    return with_provenance(out.select("work", "requested", "eid", "num", "heading", "text", "notes", "section_path", error.alias("error")), "work", stamp)


def compare_at(works: DataFrame, consolidations: DataFrame, expressions: DataFrame, manifestations: DataFrame, files: DataFrame, base: QueryStamp, other: QueryStamp, lang: str = "de") -> DataFrame:
    """compare_versions of the articles in force at two dates."""

    def articles(stamp: QueryStamp) -> DataFrame:
        v = temporal.consolidation_at(consolidations, expressions, manifestations, stamp.as_of, lang, works).select("work", F.col("url").alias("doc_id"))
        n = fetch_documents(v.withColumnRenamed("doc_id", "url"), files).where("tag = 'article' and eid is not null")
        return n.join(v, "doc_id").select("work", "eid", "text", "ord")

    return diff.compare_versions(articles(base), articles(other))
