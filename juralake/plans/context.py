"""Point in time and provenance of a query.

No operator takes "today" by itself: a ``QueryStamp`` fixes the date that answers
are valid for and the transaction time, and ``with_provenance`` puts both, with
the work's id, on every row.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NORM, HINT = "norm", "hint"
#: The id in the envelope of a discovery answer without hits.
SENTINEL = "eli/cc"


@dataclass(frozen=True)
class QueryStamp:
    """as_of: the requested date, or the default; tx: the time of the query."""

    as_of: dt.date
    tx: dt.datetime

    @classmethod
    def make(cls, requested: str | dt.date | None = None, default: dt.date | None = None, tx: dt.datetime | None = None) -> QueryStamp:
        """A date in ISO form (strict) or the default, else today."""
        if isinstance(requested, str):
            if len(requested) != 10:
                raise ValueError(f"not a YYYY-MM-DD date: {requested!r}")
            requested = dt.date.fromisoformat(requested)
        now = tx or dt.datetime.now(dt.timezone.utc)
        return cls(requested or default or now.date(), now)


def provenance(eli: Column, stamp: QueryStamp, kind: str | Column = NORM) -> Column:
    """struct(eli, valid_as_of, transaction_time, kind); a null kind counts as ``norm``."""
    k = F.lit(kind) if isinstance(kind, str) else F.coalesce(kind, F.lit(NORM))
    return F.struct(eli.alias("eli"), F.lit(stamp.as_of).alias("valid_as_of"), F.lit(stamp.tx.replace(tzinfo=None)).cast("timestamp").alias("transaction_time"), k.alias("kind"))


def with_provenance(df: DataFrame, eli_col: str, stamp: QueryStamp, kind: str | Column = NORM) -> DataFrame:
    return df.withColumn("provenance", provenance(F.col(eli_col), stamp, kind))


def with_hints(hits: DataFrame, eli_col: str, stamp: QueryStamp) -> DataFrame:
    """Discovery hits: each row is a hint of its own, never a norm."""
    return with_provenance(hits, eli_col, stamp, HINT)


def hint_envelope(hits: DataFrame, eli_col: str, stamp: QueryStamp) -> DataFrame:
    """with_hints, and one row of nulls with the provenance of the search itself (``SENTINEL``) where there are no hits, so that no answer is without provenance."""
    none = hits.agg(F.count("*").alias("n")).where("n = 0").select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in hits.schema), F.lit(SENTINEL).alias("_eli"))
    d = hits.withColumn("_eli", F.col(eli_col)).unionByName(none)
    return d.withColumn("provenance", provenance(F.col("_eli"), stamp, HINT)).drop("_eli")


class Sensitive:
    """Holds a value that neither repr nor str shows; ``reveal`` returns it."""

    __slots__ = ("_value",)

    def __init__(self, value):
        self._value = value

    def reveal(self):
        return self._value

    def __repr__(self) -> str:
        return "[REDACTED]"

    __str__ = __repr__

    def __eq__(self, other) -> bool:
        return isinstance(other, Sensitive) and self._value == other._value

    def __hash__(self) -> int:
        return hash(self._value)
