"""The ten operators over their whole tables with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from . import bestfit, decontam, html_template, langid, media, minhash, nnls_pack, suffix_dedup, toxicity, url_rules
from .common import cut_lineage, ensure_checkpoint_dir


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated passage of at least 50 words: document and word span."""
    return suffix_dedup.repeats(_t(spark, sf_dir, "documents"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of a WAV clip for each embedding; the tables have no audio of their own."""
    return media.fingerprints(media.from_vectors(_t(spark, sf_dir, "embeddings")))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with the number of rules that match its URL, their greatest confidence and the verdict."""
    return url_rules.filter_urls(_t(spark, sf_dir, "pages").select("page_id", "url"), _t(spark, sf_dir, "labels"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds."""
    return decontam.contaminated(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's slots."""
    return html_template.extract_slots(_t(spark, sf_dir, "pages"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that has an earlier near copy, with the document of its group that stays."""
    return minhash.near_duplicate_groups(_t(spark, sf_dir, "documents")).select("doc_id", "group_id", "jaccard")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every toxic document with its probability and offending sentences."""
    docs = _t(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _t(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("is_toxic").select("doc_id", "p_toxic", "sentences")


def op8_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed windows of token ids: written as binary files to the shared folder, and read from there."""
    folder = f"{ensure_checkpoint_dir(spark)}/token-binary-{uuid.uuid4().hex}"
    files = cut_lineage(bestfit.write_binary(bestfit.pack_tokens(_t(spark, sf_dir, "documents")), folder))
    return bestfit.read_binary(files)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by hyperdimensional profiles of all labelled documents."""
    docs = _t(spark, sf_dir, "documents")
    return langid.classify(docs, langid.prototypes(docs))


def op10_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window and slot of every piece of every document."""
    return nnls_pack.pack(_t(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    ops = (op1_suffix_array_dedup, op2_media_columns, op3_url_filters, op4_benchmark_decontamination, op5_html_extraction, op6_minhash_near_dedup, op7_toxicity, op8_token_binary, op9_language_id, op10_nnls_packing, pipeline)
    return {f.__name__: f for f in ops}


_OP1 = r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\r\v\f]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), windows AS (
  SELECT doc_id, CAST(i AS INTEGER) AS s, hash(list_slice(w, i + 1, i + 50)) AS h, md5(array_to_string(list_slice(w, i + 1, i + 50), ' ')) AS m
  FROM words, LATERAL (SELECT unnest(range(0, len(w) - 49)) AS i)
), marked AS (
  SELECT doc_id, s, count(*) OVER (PARTITION BY h, m) > 1 AS rep, row_number() OVER (PARTITION BY h, m ORDER BY doc_id, s) = 1 AS first FROM windows
), runs AS (
  SELECT doc_id, s, first FROM marked WHERE rep
), islands AS (
  SELECT doc_id, s, first, sum(CASE WHEN s <= prev + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS g
  FROM (SELECT doc_id, s, first, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS prev FROM runs)
), spans AS (
  SELECT doc_id, g, CAST(min(s) AS INTEGER) AS first_word, CAST(max(s) + 50 AS INTEGER) AS end_word FROM islands GROUP BY doc_id, g
), covered AS (
  SELECT doc_id, g, s + k AS word, bool_or(first) AS stays FROM islands, LATERAL (SELECT unnest(range(0, 50)) AS k) GROUP BY doc_id, g, s + k
), cut AS (
  SELECT doc_id, g, CAST(count(*) FILTER (WHERE NOT stays) AS INTEGER) AS n_cut FROM covered GROUP BY doc_id, g
)
SELECT doc_id, first_word, end_word, end_word - first_word AS n_words, n_cut FROM spans JOIN cut USING (doc_id, g)
"""

_OP3 = r"""
WITH parts AS (
  SELECT page_id, lower(trim(coalesce(url, ''))) AS u FROM pages
), tok AS (
  SELECT page_id, list_sort(list_distinct(list_concat(list_concat(
    list_transform(list_filter(string_split(regexp_extract(u, '^([a-z]+)://', 1), ':'), lambda x: x <> ''), lambda x: 's:' || regexp_replace(x, '[0-9]+', '#', 'g')),
    list_transform(list_filter(string_split(regexp_extract(u, '^[a-z]+://([^/?#:]+)', 1), '.'), lambda x: x <> ''), lambda x: 'h:' || regexp_replace(x, '[0-9]+', '#', 'g'))), list_concat(
    list_transform(list_filter(string_split(regexp_extract(u, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> ''), lambda x: 'p:' || regexp_replace(x, '[0-9]+', '#', 'g')),
    list_transform(list_filter(string_split(regexp_extract(u, '\?([^#]*)', 1), '&'), lambda x: x <> ''), lambda x: 'q:' || regexp_replace(x, '[0-9]+', '#', 'g')))))) AS t FROM parts
), lab AS (
  SELECT doc_id, bool_or(coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), tx AS (
  SELECT t, bad FROM tok JOIN lab ON tok.page_id = lab.doc_id WHERE len(t) > 0
), base AS (
  SELECT count(*) FILTER (WHERE bad) / CAST(count(*) AS DOUBLE) AS share FROM tx
), subsets AS (
  SELECT list_filter(t, lambda x, i: (b // CAST(power(2, i - 1) AS BIGINT)) % 2 = 1) AS rule, bad FROM tx, LATERAL (SELECT unnest(range(1, CAST(power(2, len(t)) AS BIGINT))) AS b)
), rules AS (
  SELECT rule, count(*) FILTER (WHERE bad) / CAST(count(*) AS DOUBLE) AS p, CAST(count(*) AS DOUBLE) AS n FROM subsets GROUP BY rule HAVING count(*) FILTER (WHERE bad) >= 10
), strong AS (
  SELECT rule, round(p, 6) AS confidence FROM rules, base WHERE round(p, 6) >= 0.5 AND (p + 16 / (2 * n) - 4 * sqrt(p * (1 - p) / n + 16 / (4 * n * n))) / (1 + 16 / n) > share
), good AS (
  SELECT * FROM strong a WHERE NOT EXISTS (SELECT 1 FROM strong b WHERE len(b.rule) < len(a.rule) AND b.confidence >= a.confidence AND list_has_all(a.rule, b.rule))
), hit AS (
  SELECT t, count(*) AS n_rules, max(confidence) AS confidence FROM (SELECT DISTINCT t FROM tok), good WHERE list_has_all(t, rule) GROUP BY t
)
SELECT page_id, coalesce(n_rules, 0) AS n_rules, confidence, n_rules IS NOT NULL AS rejected FROM tok LEFT JOIN hit USING (t)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_array_dedup": _OP1, "op3_url_filters": _OP3}
