"""Laws by number and title, their metadata, languages and files.

Tables, all nullable but the keys:
works(work, legal_id, status, type_document, date_document, date_entry, date_no_longer, date_end)
titles(work, lang, title); consolidations(cons, work, date)
expressions(cons, expr, lang); manifestations(expr, url)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a file's URL holds for each format.
FORMAT_MARKERS = {"xml": "/xml/", "pdf": "/pdf/", "html": "/html/"}


def sanitize(term: str) -> str:
    """Quotes and backslashes of a search term become spaces, as lookups by number and title expect."""
    return term.replace('"', " ").replace("\\", " ")


def resolve_number(works: DataFrame, titles: DataFrame, number: str | None = None, lang: str = "de", limit: int = 20) -> DataFrame:
    """work, legal_id, title, status of the laws with a number (None: of every law). Numbers are reused, so one may name several laws; at most ``limit`` for a number."""
    w = works.where(F.col("legal_id").isNotNull()) if number is None else works.where(F.col("legal_id") == sanitize(number))
    hits = w.join(titles.where(F.col("lang") == lang).select("work", "title"), "work", "left").select("work", "legal_id", "title", "status").distinct()
    order = Window.partitionBy("legal_id").orderBy("work", F.col("title").asc_nulls_first(), F.col("status").asc_nulls_first())
    return hits.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")


def search_titles(works: DataFrame, titles: DataFrame, query: str, lang: str = "de", limit: int | None = 20) -> DataFrame:
    """work, legal_id, title where the title holds the query literally, case ignored; needs number and title. Least ids first."""
    t = titles.where((F.col("lang") == lang) & F.contains(F.lower("title"), F.lit(sanitize(query).lower()))).select("work", "title")
    hits = works.where(F.col("legal_id").isNotNull()).select("work", "legal_id").join(t, "work").distinct()
    return hits.orderBy("work", "legal_id", "title").limit(limit) if limit is not None else hits


def law_metadata(keys: DataFrame, works: DataFrame, titles: DataFrame, lang: str = "de") -> DataFrame:
    """One row for each work in keys(work): number, title, dates, type. An unknown work has nulls and is no error."""
    w = works.groupBy("work").agg(*(F.min(c).alias(c) for c in ("legal_id", "date_document", "date_entry", "type_document")))
    t = titles.where(F.col("lang") == lang).groupBy("work").agg(F.min("title").alias("title"))
    return keys.select("work").distinct().join(w, "work", "left").join(t, "work", "left").select("work", "legal_id", "title", "date_document", "date_entry", "type_document")


def latest(df: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def manifestation_at(consolidations: DataFrame, expressions: DataFrame, manifestations: DataFrame, as_of, lang: str = "de", fmt: str = "xml", keys: DataFrame | None = None) -> DataFrame:
    """work, cons, date, lang, url: the newest version in force on ``as_of`` that has a file of the language and format.

    Language and format come before "newest": an older version with the file wins over a newer one without. Works without any are absent (not found).
    """
    v = consolidations.where(F.col("date") <= F.lit(as_of).cast("date"))
    if keys is not None:
        v = v.join(keys.select("work").distinct(), "work", "left_semi")
    e = expressions.where(F.col("lang") == lang).select("cons", "expr", "lang")
    m = manifestations.where(F.contains("url", F.lit(FORMAT_MARKERS[fmt]))).select("expr", "url")
    found = v.select("work", "cons", "date").join(e, "cons").join(m, "expr")
    best = found.groupBy("work").agg(F.max(F.struct(F.col("date"), F.col("cons"), F.col("lang"), F.col("url"))).alias("v"))
    return best.select("work", "v.cons", "v.date", "v.lang", "v.url")


def languages_of(consolidations: DataFrame, expressions: DataFrame, limit: int = 10) -> DataFrame:
    """work, lang: distinct languages over all versions of a work, at most ``limit`` for each."""
    d = consolidations.select("work", "cons").join(expressions.select("cons", "lang"), "cons").select("work", "lang").where("lang is not null").distinct()
    return d.withColumn("_n", F.row_number().over(Window.partitionBy("work").orderBy("lang"))).where(F.col("_n") <= limit).drop("_n")
