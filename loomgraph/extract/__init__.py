"""Symbols, references and edges out of source text."""
