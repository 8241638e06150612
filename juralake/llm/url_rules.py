"""Association rules over URL tokens, mined with FP-growth from labelled pages.

A URL becomes a set of tokens: host labels (``h:``), path segments (``p:``,
digits replaced by #), query parameters (``q:``) and the scheme (``s:``). FP-growth
mines the token sets of labelled pages with the label as one more item. A rule
"these tokens -> bad" stays if

- at least ``min_count`` bad pages have its tokens (a count, not a share, so that
  a small host in a large corpus can be found),
- its confidence, the share of bad pages among those with its tokens, is at least
  ``min_confidence``,
- that is no chance: the lower bound of Wilson's interval for it, ``z`` standard
  errors out, lies above the share of bad pages among all,
- no rule with fewer of its tokens has at least its confidence (it would add
  nothing).

Rules match by an inverted index: each is filed under its longest token, URLs
look up their tokens, and the rule's other tokens are then checked. URLs are
matched by distinct token set, which repeats far more than URLs do.

Edge cases: a null or empty URL has no tokens and no rule matches it (such rows
stay in the result, not rejected), however long a URL is, all of it is read; null
labels and ids don't train; an id with several labels is bad if any is; without
labelled pages there are no rules, and an empty table of pages gives no rows.
Repeated pages each get their row, and count in mining as often as they occur.
Tokens of equal length are filed by name. Page ids keep their type (labels are
found by the id as text); other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kind

MIN_COUNT, MIN_CONFIDENCE, Z = 10, 0.5, 4.0
LABEL = "label=bad"
RULES = "rule array<string>, support long, total long, confidence double"


def url_tokens(url: Column) -> Column:
    """Sorted distinct tokens of a URL; an empty array for null."""
    u = F.lower(F.trim(F.coalesce(url.cast("string"), F.lit(""))))
    part = lambda pattern: F.regexp_extract(u, pattern, 1)
    each = lambda text, sep, mark: F.transform(F.filter(F.split(text, sep), lambda x: x != ""), lambda x: F.concat(F.lit(mark), F.regexp_replace(x, "[0-9]+", "#")))
    return F.array_sort(F.array_distinct(F.concat(
        each(part("^([a-z]+)://"), ":", "s:"),
        each(part("^[a-z]+://([^/?#:]+)"), r"\.", "h:"),
        each(part("^[a-z]+://[^/?#]+([^?#]*)"), "/", "p:"),
        each(part(r"\?([^#]*)"), "&", "q:"),
    )))


def wilson_lower(hits: Column, total: Column, z: float) -> Column:
    """Lower end of Wilson's interval of a share."""
    n, p, z2 = total.cast("double"), hits / total, z * z
    return (p + z2 / (2 * n) - z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def _filed(rules: DataFrame) -> DataFrame:
    """Each rule under its longest token: a fixed choice that needs no counts, and long tokens are rare."""
    return rules.withColumn("token", F.element_at(F.array_sort(F.transform("rule", lambda x: F.struct((-F.length(x)).alias("n"), x.alias("t")))), 1)["t"])


def not_redundant(rules: DataFrame) -> DataFrame:
    """rules without those that hold all tokens of another of at least their confidence."""
    short = _filed(rules).select("token", F.col("rule").alias("less"), F.col("confidence").alias("theirs"))
    long = rules.select("rule", "confidence", F.explode("rule").alias("token"))
    beaten = long.join(short, "token").where((F.size("less") < F.size("rule")) & (F.col("theirs") >= F.col("confidence")) & (F.size(F.array_except("less", "rule")) == 0))
    return rules.join(beaten.select("rule").distinct(), "rule", "left_anti")


def mine_rules(pages: DataFrame, labels: DataFrame, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE, z: float = Z) -> DataFrame:
    """rule (its tokens, sorted), support (bad pages with it), total (labelled pages with it), confidence.

    pages: page_id, url; labels: doc_id (names a page_id), quality (0 is bad), toxic (1 is bad).
    """
    from pyspark.ml.fpm import FPGrowth

    lab = labels.select(F.col("doc_id").cast("string").alias("id"), ((F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)).alias("bad")).where("id is not null").groupBy("id").agg(F.max("bad").alias("bad"))
    p = pages.select(F.col("page_id").cast("string").alias("id"), url_tokens(F.col("url")).alias("tokens")).where("size(tokens) > 0").join(lab, "id")
    rows = p.select("bad", F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(LABEL)))).otherwise(F.col("tokens")).alias("items"))
    all_ = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("bad"), 1)).alias("bad")).first()
    if all_["bad"] < min_count:
        return pages.sparkSession.createDataFrame([], RULES)
    # half a page less, so that rounding loses no rule of just min_count
    sets = FPGrowth(itemsCol="items", minSupport=(min_count - 0.5) / all_["n"], minConfidence=min_confidence).fit(rows).freqItemsets
    sets = sets.select(F.array_sort(F.filter("items", lambda x: x != LABEL)).alias("rule"), F.array_contains("items", LABEL).alias("labelled"), "freq")
    both = sets.where("size(rule) > 0").groupBy("rule").agg(F.max(F.when(F.col("labelled"), F.col("freq"))).alias("support"), F.max(F.when(~F.col("labelled"), F.col("freq"))).alias("total"))
    out = both.where(F.col("support") >= min_count).withColumn("confidence", F.round(F.col("support") / F.col("total"), 6))
    out = out.where((F.col("confidence") >= min_confidence) & (wilson_lower(F.col("support"), F.col("total"), z) > all_["bad"] / all_["n"]))
    return not_redundant(out)


def match(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, n_rules (rules that match), confidence (the greatest, null if none), rejected. One row for each page."""
    filed = _filed(rules).select("token", "rule", "confidence")
    p = pages.select("page_id", url_tokens(F.col("url")).alias("tokens"))
    kinds = p.select("tokens").where("size(tokens) > 0").distinct()
    hits = kinds.select("tokens", F.explode("tokens").alias("token")).join(filed, "token").where(F.size(F.array_except("rule", "tokens")) == 0)
    verdict = hits.groupBy("tokens").agg(F.count("*").alias("n_rules"), F.max("confidence").alias("confidence"))
    out = p.join(verdict, "tokens", "left")
    return out.select(F.col("page_id").cast(kind(pages, "page_id")).alias("page_id"), F.coalesce("n_rules", F.lit(0)).cast("long").alias("n_rules"), "confidence", F.col("n_rules").isNotNull().alias("rejected"))


def filter_urls(pages: DataFrame, labels: DataFrame, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE, z: float = Z) -> DataFrame:
    """Mines rules from the labelled pages and matches all pages."""
    return match(pages, mine_rules(pages, labels, min_count, min_confidence, z))
