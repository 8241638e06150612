"""Text rules as Column -> Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that structure a document's body.
HIERARCHY_TAGS = tuple("article book chapter level paragraph part proviso section subdivision title transitional".split())
#: code, end of the vocabulary URI, tag. Rumantsch differs in both encodings.
LANGUAGES = (("de", "DEU", "de"), ("fr", "FRA", "fr"), ("it", "ITA", "it"), ("en", "ENG", "en"), ("roh", "ROH", "rm"))


def normalize_text(c: Column) -> Column:
    """Soft hyphens go, no-break spaces become spaces."""
    return F.replace(F.replace(c, F.lit("\u00ad"), F.lit("")), F.lit("\u00a0"), F.lit(" "))


def strip_ws(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def tidy(c: Column) -> Column:
    """Lines trimmed, empty ones dropped."""
    return F.array_join(F.filter(F.transform(F.split(c, "\n"), strip_ws), lambda x: x != ""), "\n")


def is_hierarchy_tag(c: Column) -> Column:
    return c.isin(*HIERARCHY_TAGS)


def parse_iso_date(c: Column) -> Column:
    """Strict YYYY-MM-DD; anything else is null."""
    return F.try_to_date(F.when(c.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), c), "yyyy-MM-dd")


def parse_language(c: Column) -> Column:
    """Language code of de, fr, it, en, rm or roh in any case; de for null; null for anything else."""
    low = F.lower(F.trim(c))
    return F.when(c.isNull(), "de").when(low.isin("de", "fr", "it", "en"), low).when(low.isin("rm", "roh"), "roh")


def snippet(text: Column, query: str, around: int = 60) -> Column:
    """The first match, case ignored, with up to ``around`` characters on each side; line ends become spaces. Null without a match."""
    at = F.locate(query.lower(), F.lower(text))
    begin = F.greatest(at - around, F.lit(1))
    cut = F.substring(text, begin, at - begin + len(query) + around)
    return F.when(at > 0, F.replace(cut, F.lit("\n"), F.lit(" ")))


def unlinked_ref(label: Column) -> Column:
    """struct(kind, value) of a reference label without a link: Article, AsCitation, SrNumber or Unknown."""
    t = F.trim(label)
    art = F.regexp_extract(t, r"(?s)\A(?:Artikel|Art\.)\s*(.+)\z", 1)
    cite = F.regexp_extract(t, r"(?s)\AAS\s+([0-9]{4}.*)\z", 1)
    return (
        F.when(art != "", F.struct(F.lit("Article").alias("kind"), F.trim(art).alias("value")))
        .when(cite != "", F.struct(F.lit("AsCitation").alias("kind"), F.trim(cite).alias("value")))
        .when(t.rlike(r"\A[0-9.]*[0-9][0-9.]*\z"), F.struct(F.lit("SrNumber").alias("kind"), t.alias("value")))
        .otherwise(F.struct(F.lit("Unknown").alias("kind"), t.alias("value")))
    )
