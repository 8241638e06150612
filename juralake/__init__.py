"""Analytics over a legal knowledge graph and structured legal documents, as DataFrame operators."""
