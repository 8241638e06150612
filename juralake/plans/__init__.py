"""Query context, test-data adapters and the query registry."""
