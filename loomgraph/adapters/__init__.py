"""JSON and command line in front of the query registry."""
