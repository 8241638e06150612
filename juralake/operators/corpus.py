"""Append-only bitemporal corpus: versions(eli, version_id, valid_from, transaction_time, text), and its snapshot as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "eli string, version_id string, valid_from date, transaction_time timestamp, text string"
SNAPSHOT_VERSION = 1


def append_versions(versions: DataFrame, path: str) -> None:
    """Adds versions; nothing is overwritten, and a version_id may come again."""
    versions.select("eli", "version_id", F.col("valid_from").cast("date"), F.col("transaction_time").cast("timestamp"), "text").write.mode("append").parquet(path)


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def resolve_as_of(versions: DataFrame, as_of, known_at=None, keys: DataFrame | None = None) -> DataFrame:
    """eli, version_id, valid_from, transaction_time, text valid on ``as_of``: the latest valid_from, of equal ones the latest recorded. ``known_at`` also leaves out what was recorded later.

    One hash-free aggregate with a partial step: each partition sends one row for a law.
    """
    v = versions.where(F.col("valid_from") <= F.lit(as_of).cast("date"))
    if known_at is not None:
        v = v.where(F.col("transaction_time") <= F.lit(known_at).cast("timestamp"))
    if keys is not None:
        v = v.join(keys.select("eli").distinct(), "eli", "left_semi")
    best = v.groupBy("eli").agg(F.max(F.struct("valid_from", "transaction_time", "version_id", "text")).alias("v"))
    return best.select("eli", "v.version_id", "v.valid_from", "v.transaction_time", "v.text")


def contains_versions(versions: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(eli, version_id) with ``present``."""
    have = versions.select("eli", "version_id").distinct().withColumn("present", F.lit(True))
    return requests.select("eli", "version_id").distinct().join(have, ["eli", "version_id"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def version_count(versions: DataFrame) -> DataFrame:
    return versions.groupBy("eli").agg(F.count("*").alias("versions"))


def _escape(c: Column) -> Column:
    for raw, esc in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(raw), F.lit(esc))
    return c


def _unescape(c: Column) -> Column:
    """Undoes _escape; an escape that isn't known stays as it is."""
    pairs = F.split(c, r"\\\\", -1)  # at escaped backslashes, from the left
    plain = lambda x: F.replace(F.replace(F.replace(x, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))
    return F.array_join(F.transform(pairs, plain), "\\")


def snapshot_lines(versions: DataFrame) -> DataFrame:
    """value: one escaped, tab-separated line for each version, in the order that makes a dump reproducible."""
    rows = versions.orderBy("eli", "valid_from", "transaction_time", "version_id", "text")
    stamp = F.date_format("transaction_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return rows.select(F.concat_ws("\t", _escape(F.col("eli")), _escape(F.col("version_id")), F.date_format("valid_from", "yyyy-MM-dd"), stamp, _escape(F.col("text"))).alias("value"))


def dump_snapshot(versions: DataFrame, path: str) -> None:
    """Text files in order; each starts with the header. Ranges of the sort go to different files, so no task holds the corpus."""
    header = f"#corpus-snapshot v{SNAPSHOT_VERSION}"

    def with_header(batches):
        import pyarrow as pa

        first = True
        for b in batches:
            if first:
                yield pa.RecordBatch.from_arrays([pa.array([header], b.schema.field(0).type)], schema=b.schema)
                first = False
            yield b

    snapshot_lines(versions).mapInArrow(with_header, "value string").write.mode("error").text(path)


def restore_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Versions of a snapshot. A file without its header or with another version's, a line without five fields or a bad date is an error that names the file and the line's text; empty lines are skipped.

    Only a header has no tab, so a version whose id looks like one is still a version.
    """
    lines = spark.read.text(path).withColumn("file", F.input_file_name()).where(F.trim("value") != "")
    f = F.split("value", "\t", -1)
    head = (F.size(f) == 1) & F.col("value").startswith("#corpus-snapshot")
    bad_head = head & (F.col("value") != f"#corpus-snapshot v{SNAPSHOT_VERSION}")
    # a file's other splits don't see its header
    lines = lines.join(lines.where(head).select("file").distinct().withColumn("headed", F.lit(True)), "file", "left")
    day, tx = F.try_to_date(f[2], "yyyy-MM-dd"), F.try_to_timestamp(f[3], F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    wrong = (F.size(f) != 5) | day.isNull() | tx.isNull()
    fail = lambda what: F.raise_error(F.concat(F.lit(what + ": "), "file", F.lit(": "), F.substring("value", 1, 80)))
    # one expression, so that no part of it is filtered away before it can fail
    keep = F.when(bad_head, fail("snapshot version")).when(F.col("headed").isNull(), fail("snapshot without header")).when(head, F.lit(False)).when(wrong, fail("snapshot line")).otherwise(F.lit(True))
    checked = lines.where(keep)
    return checked.select(_unescape(f[0]).alias("eli"), _unescape(f[1]).alias("version_id"), day.alias("valid_from"), tx.alias("transaction_time"), _unescape(f[4]).alias("text"))
