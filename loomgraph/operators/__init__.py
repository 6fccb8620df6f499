"""Query and maintenance operators over a graph's tables."""
