"""Sources: legal XML to a node table, SPARQL endpoints and results, stores behind small interfaces."""

from .legal_xml import NODE_SCHEMA, parse_nodes
from .sparql import SparqlSource
from .stores import Connector, KeyValueTable, read_sparql_json, resolve_local_first

__all__ = ["NODE_SCHEMA", "Connector", "KeyValueTable", "SparqlSource", "parse_nodes", "read_sparql_json", "resolve_local_first"]
