"""SPARQL endpoints as a Spark data source: spark.read.format("sparql").

Options: endpoint, query, variables (separated by commas); page_size and pages
split a query that has an ORDER BY into that many parts by LIMIT and OFFSET, one
task each; timeout in seconds. Each variable is a column
struct(kind, value, lang, datatype), null where it is unbound.
"""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TERM = "struct<kind:string,value:string,lang:string,datatype:string>"


class Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class SparqlReader(DataSourceReader):
    def __init__(self, options):
        self.endpoint, self.query, self.timeout = options["endpoint"], options["query"], float(options.get("timeout", 30))
        self.variables = variables(options)
        self.size, self.pages = int(options.get("page_size", 0)), int(options.get("pages", 1))
        if self.pages > 1 and (self.size < 1 or "order by" not in self.query.lower()):
            raise ValueError("pages need a page_size, and a query with an ORDER BY: else rows would move between them")

    def partitions(self):
        return [Page(n) for n in range(self.pages)]

    def read(self, partition: Page):
        import json
        import urllib.request

        query = self.query + (f" LIMIT {self.size} OFFSET {partition.number * self.size}" if self.size else "")
        ask = urllib.request.Request(self.endpoint, query.encode(), {"Content-Type": "application/sparql-query", "Accept": "application/sparql-results+json"})
        with urllib.request.urlopen(ask, timeout=self.timeout) as answer:
            rows = json.load(answer)["results"]["bindings"]
        for row in rows:
            yield tuple((x.get("type"), x.get("value"), x.get("xml:lang"), x.get("datatype")) if (x := row.get(v)) else None for v in self.variables)


class SparqlSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sparql"

    def schema(self) -> str:
        return ", ".join(f"`{v}` {TERM}" for v in variables(self.options))

    def reader(self, schema) -> SparqlReader:
        return SparqlReader(self.options)


def variables(options) -> list[str]:
    return [v.strip().lstrip("?") for v in options["variables"].split(",") if v.strip()]


def register(spark) -> None:
    spark.dataSource.register(SparqlSource)
