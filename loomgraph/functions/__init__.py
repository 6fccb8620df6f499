"""Column functions: names, paths, types, patterns."""
