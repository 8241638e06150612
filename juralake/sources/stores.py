"""Query results, key-value entries, and lookups that ask a local table first."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TERM = "struct<type:string,value:string,`xml:lang`:string,datatype:string>"


def read_sparql_json(results: DataFrame, variables: list[str], json_col: str = "json", id_col: str | None = None) -> DataFrame:
    """Rows of SPARQL result documents: for each variable a struct(kind, value, lang, datatype), null where it is unbound."""
    one = ", ".join(f"`{v}`: {_TERM}" for v in variables)
    schema = f"struct<head: struct<vars: array<string>>, results: struct<bindings: array<struct<{one}>>>>"
    rows = results.select(*([id_col] if id_col else []), F.explode(F.from_json(json_col, schema)["results"]["bindings"]).alias("b"))
    term = lambda v: F.when(F.col("b")[v].isNotNull(), F.struct(F.col("b")[v]["type"].alias("kind"), F.col("b")[v]["value"].alias("value"), F.col("b")[v]["xml:lang"].alias("lang"), F.col("b")[v]["datatype"].alias("datatype"))).alias(v)
    return rows.select(*([id_col] if id_col else []), *(term(v) for v in variables))


class Connector(Protocol):
    """What an external source must offer: rows (key, value) for keys(key). Implementations may read a service per partition."""

    def lookup(self, keys: DataFrame) -> DataFrame: ...


def resolve_local_first(requests: DataFrame, local: DataFrame, external: Connector) -> DataFrame:
    """key, value, origin for requests(key): local values, and the connector's for keys that the local table lacks; it is asked for no others."""
    keys = requests.select("key").distinct()
    have = keys.join(local.select("key", "value"), "key").withColumn("origin", F.lit("local"))
    missing = keys.join(local.select("key"), "key", "left_anti")
    return have.unionByName(external.lookup(missing).select("key", "value").withColumn("origin", F.lit("external")))


class KeyValueTable:
    """Scratch entries (tenant, session, key) -> value in a Parquet folder. Changes append; the latest wins. Every read names tenant and session."""

    SCHEMA = "tenant string, session string, key string, value string, deleted boolean, seq long"

    def __init__(self, spark: SparkSession, path: str, tenant: str, session: str):
        for part in (tenant, session):
            self._check(part)
        self.spark, self.path, self.tenant, self.session = spark, path, tenant, session

    @staticmethod
    def _check(part: str) -> None:
        if not part.strip() or set(part) & set(":*?[]"):
            raise ValueError(f"not a key part: {part!r}")

    def _append(self, rows: list[tuple[str, str | None, bool]]) -> None:
        import time

        for key, *_ in rows:
            self._check(key)
        data = [(self.tenant, self.session, k, v, d, time.time_ns() + i) for i, (k, v, d) in enumerate(rows)]
        self.spark.createDataFrame(data, self.SCHEMA).coalesce(1).write.mode("append").partitionBy("tenant", "session").parquet(self.path)

    def put(self, **entries: str) -> None:
        self._append([(k, v, False) for k, v in entries.items()])

    def delete(self, key: str) -> None:
        self._append([(key, None, True)])

    def entries(self) -> DataFrame:
        """key, value of this tenant and session; partition pruning reads no others."""
        own = self.spark.read.schema(self.SCHEMA).parquet(self.path).where((F.col("tenant") == self.tenant) & (F.col("session") == self.session))
        return own.groupBy("key").agg(F.max_by(F.struct("value", "deleted"), "seq").alias("v")).where("not v.deleted").select("key", "v.value")

    def get(self, key: str) -> str | None:
        self._check(key)
        row = self.entries().where(F.col("key") == key).first()
        return row["value"] if row else None
