"""Column functions: names, paths, query texts, geometry."""
