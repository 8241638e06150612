"""Comparison of two versions, and pages of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _first(articles: DataFrame) -> DataFrame:
    """Ids may repeat in a document; the first text (by ``ord`` if there is one) counts."""
    if "ord" in articles.columns:
        return articles.groupBy("work", "eid").agg(F.min_by("text", "ord").alias("text"))
    return articles.groupBy("work", "eid").agg(F.min("text").alias("text"))


def diff_articles(left: DataFrame, right: DataFrame) -> DataFrame:
    """work, eid, change (added: in right only; removed: in left only; changed), of two tables (work, eid, text). Unchanged articles are left out."""
    a, b = _first(left).withColumnRenamed("text", "a"), _first(right).withColumnRenamed("text", "b")
    j = a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), ["work", "eid"], "full_outer")
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return j.select("work", "eid", change.alias("change")).where("change is not null")


def _lists(changes: DataFrame) -> DataFrame:
    pick = lambda kind: F.sort_array(F.collect_list(F.when(F.col("change") == kind, F.col("eid")))).alias(kind)
    return changes.groupBy("work").agg(pick("added"), pick("changed"), pick("removed"))


def _markdown(title: str) -> F.Column:
    part = lambda name, col: F.when(F.size(col) > 0, F.concat(F.lit(f"## {name}\n"), F.array_join(F.transform(col, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n\n"))).otherwise("")
    return F.regexp_replace(F.concat(F.lit(f"# {title}\n\n"), part("Added", "added"), part("Changed", "changed"), part("Removed", "removed")), r"\s+\z", "")


def compare_versions(base: DataFrame, other: DataFrame) -> DataFrame:
    """work, added, changed, removed, markdown: what the base version has that the other lacks is added."""
    return _lists(diff_articles(other, base)).withColumn("markdown", _markdown("Comparison of versions"))


def diff_to_markdown(old: DataFrame, new: DataFrame) -> DataFrame:
    """work, added, changed, removed, markdown: what the new version has that the old lacks is added."""
    return _lists(diff_articles(old, new)).withColumn("markdown", _markdown("Changes"))


def paginate(df: DataFrame, page: int, page_size: int, *order, key: str | None = None) -> DataFrame:
    """Rows of a page (from 0) of each key, with has_more and next_page. A page size of 0 counts as 1.

    Without a key, each task keeps its first rows and only a page and one row more come together.
    """
    size = max(1, page_size)
    if key is None:
        d = df.orderBy(*order).offset(page * size).limit(size + 1)
        w = Window.partitionBy(F.lit(0))  # over a page
        d = d.withColumn("_n", F.row_number().over(w.orderBy(*order)) + page * size).withColumn("_all", F.count("*").over(w) + page * size)
    else:
        w = Window.partitionBy(key)
        d = df.withColumn("_n", F.row_number().over(w.orderBy(*order))).withColumn("_all", F.count("*").over(w))
    more = F.col("_all") > (page + 1) * size
    d = d.where((F.col("_n") > page * size) & (F.col("_n") <= (page + 1) * size))
    return d.withColumn("has_more", more).withColumn("next_page", F.when(more, F.lit(page + 1))).drop("_n", "_all")


def clamp(value: int | None, default: int = 20, low: int = 1, high: int = 50) -> int:
    """A limit argument: the default if absent, else within bounds."""
    return default if value is None else max(low, min(high, value))


def clamped(value: Column, default: int = 20, low: int = 1, high: int = 50) -> Column:
    """clamp as a Column."""
    return F.coalesce(F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value))), F.lit(default))
