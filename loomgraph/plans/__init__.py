"""Whole plans: the projection of star-schema tables, the registry of queries, indexing."""
