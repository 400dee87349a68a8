"""Registered queries: each applies one operator to the given tables, with the SQL that it must equal."""

from zonepack.queries import graphs, matching, names, packages, spatial, views
from zonepack.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "graphs", "matching", "names", "packages", "spatial", "views"]
