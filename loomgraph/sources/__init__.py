"""Readers of source trees, file contents, revisions and stored graphs."""
