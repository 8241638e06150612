"""Identifiers as Column -> Column functions; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOST = "https://example.org/"


def is_valid_eli(c: Column) -> Column:
    """A trimmed id that starts with ``eli/`` and goes on. Null stays null."""
    t = F.trim(c)
    return t.startswith("eli/") & (F.length(t) > 4)


def is_valid_ecli(c: Column) -> Column:
    t = F.trim(c)
    return t.startswith("ecli/") & (F.length(t) > 5)


def normalize_eid(c: Column) -> Column:
    """Drops ``_`` before a single lower-case letter that ends the id or a step of it: art_14_a -> art_14a."""
    return F.regexp_replace(c, r"_([a-z])(?=\z|/)", "$1")


def eli_path(c: Column) -> Column:
    """The part from the first ``eli/`` step on; null if there is none."""
    at = F.instr(c, "/eli/")
    return F.when(at > 0, F.substring(c, at + 1, F.length(c))).when(c.startswith("eli/"), c)


def work_eli_path(c: Column) -> Column:
    """eli_path without a last segment of eight digits, the date of a consolidated text."""
    return F.regexp_replace(eli_path(c), r"/[0-9]{8}\z", "")


def eli_uri(c: Column, host: str = HOST) -> Column:
    return F.concat(F.lit(host), c)


def strip_host(c: Column, host: str = HOST) -> Column:
    return F.when(c.startswith(host), F.substring(c, len(host) + 1, 1 << 30)).otherwise(c)


def is_valid_key_part(c: Column) -> Column:
    """Not blank and free of the characters that separate or match keys: ``: * ? [ ]``."""
    return (F.trim(c) != "") & ~c.rlike(r"[:*?\[\]]")
