"""Joins, groups and set operations of the packaging engine, each over whole tables."""
