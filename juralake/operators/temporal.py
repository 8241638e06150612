"""Versions of laws in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .resolve import manifestation_at


def list_versions(consolidations: DataFrame, limit: int = 200) -> DataFrame:
    """work, cons, date: distinct dated versions; of each work the ``limit`` earliest."""
    d = consolidations.where("cons is not null and date is not null").select("work", "cons", "date").distinct()
    return d.withColumn("_n", F.row_number().over(Window.partitionBy("work").orderBy("date", "cons"))).where(F.col("_n") <= limit).drop("_n")


def consolidation_at(consolidations: DataFrame, expressions: DataFrame, manifestations: DataFrame, as_of, lang: str = "de", keys: DataFrame | None = None) -> DataFrame:
    """work, cons, date, lang, url of the version in force on ``as_of`` that exists as XML in the language."""
    return manifestation_at(consolidations, expressions, manifestations, as_of, lang, "xml", keys)


def in_force(keys: DataFrame, works: DataFrame, as_of) -> DataFrame:
    """work, in_force, status, date_entry, date_no_longer, date_end for each work in keys.

    With an entry date: entered by then, and neither end date reached (a law that ends on the day isn't in force on it). Without one: the status ends in ``/0``. An unknown work isn't in force.
    """
    d = F.lit(as_of).cast("date")
    w = works.groupBy("work").agg(F.min("status").alias("status"), F.min("date_entry").alias("date_entry"), F.min("date_no_longer").alias("date_no_longer"), F.min("date_end").alias("date_end"))
    j = keys.select("work").distinct().join(w, "work", "left")
    over = F.coalesce(F.col("date_no_longer") <= d, F.lit(False)) | F.coalesce(F.col("date_end") <= d, F.lit(False))
    by_date = (F.col("date_entry") <= d) & ~over
    return j.select("work", F.when(F.col("date_entry").isNotNull(), by_date).otherwise(F.coalesce(F.col("status").endswith("/0"), F.lit(False))).alias("in_force"), "status", "date_entry", "date_no_longer", "date_end")
