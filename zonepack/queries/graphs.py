"""Graph operators over relations made of order lines: part and supplier are the tables' nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonepack.operators import graph
from zonepack.queries.registry import Tables, query


def line_edges(t: Tables, *more: str) -> DataFrame:
    return t.lineitem.select(
        *more,
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("relation_id"),
        F.concat(F.lit("p"), "l_partkey").alias("child"), F.concat(F.lit("s"), "l_suppkey").alias("parent"),
        (F.col("l_returnflag") != "N").alias("valid"), F.when(F.col("l_linenumber") == 7, "generated").otherwise("normal").alias("kind"),
    )


EDGES = """WITH edges AS (
  SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS relation_id, 'p' || l_partkey AS child, 's' || l_suppkey AS parent,
    l_returnflag <> 'N' AS valid, CASE WHEN l_linenumber = 7 THEN 'generated' ELSE 'normal' END AS kind FROM lineitem
), usable AS (SELECT * FROM edges WHERE valid AND kind <> 'generated'),
hops AS (SELECT relation_id, child AS "start", parent AS "end" FROM usable UNION ALL SELECT relation_id, parent, child FROM usable WHERE child <> parent)
"""
_FOUND = EDGES.replace("WITH edges", "WITH RECURSIVE edges") + """, w AS (SELECT "start", "end", count(*) AS n FROM hops GROUP BY 1, 2),
found(node, hops, paths) USING KEY (node) AS (
  SELECT 's1', 0, CAST(1 AS BIGINT)
  UNION
  (SELECT w."end", min(f.hops) + 1, CAST(sum(w.n * f.paths) AS BIGINT) FROM found f JOIN w ON w."start" = f.node WHERE NOT EXISTS (SELECT 1 FROM recurring.found r WHERE r.node = w."end") GROUP BY 1)
)"""
_LISTED = EDGES.replace("WITH edges", "WITH RECURSIVE edges") + """, listed(node, hops, paths) USING KEY (node) AS (
  SELECT 's1', 0, [[]::VARCHAR[]]
  UNION
  (SELECT "end", hops + 1, list_sort(list(path)) FROM (
    SELECT h."end", l.hops, list_append(l.path, h.relation_id) AS path FROM (SELECT node, hops, unnest(paths) AS path FROM listed) l JOIN hops h ON h."start" = l.node
    WHERE NOT EXISTS (SELECT 1 FROM recurring.listed r WHERE r.node = h."end")
    QUALIFY row_number() OVER (PARTITION BY h."end" ORDER BY list_append(l.path, h.relation_id)) <= 16) GROUP BY 1, 2)
)"""


@query(EDGES + "SELECT * FROM usable")
def relation_edges(t: Tables) -> DataFrame:
    return graph.usable_edges(line_edges(t))


@query(EDGES + "SELECT * FROM hops")
def relation_hops(t: Tables) -> DataFrame:
    return graph.hops(graph.usable_edges(line_edges(t)))


def line_hops(t: Tables) -> DataFrame:
    return graph.hops(graph.usable_edges(line_edges(t)))


@query(_FOUND + "SELECT * FROM found")
def shortest_paths(t: Tables) -> DataFrame:
    return graph.shortest_paths(line_hops(t), "s1")


@query(_LISTED + " SELECT node, hops, len(paths) AS listed, array_to_string(list_transform(paths, lambda p: array_to_string(p, ' > ')), '; ') AS paths FROM listed WHERE len(paths) > 1")
def ambiguous_paths(t: Tables) -> DataFrame:
    return graph.ambiguous(graph.listed_paths(line_hops(t), "s1"))


_PINS = """, lines AS (
  SELECT l_orderkey, l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS relation_id, 'p' || l_partkey AS child, 's' || l_suppkey AS parent FROM lineitem
), pins AS (
  SELECT l_orderkey AS pin_id, min(child) AS "start", CASE WHEN l_orderkey % 11 = 0 THEN 'elsewhere' ELSE max(parent) END AS "end",
    CASE WHEN l_orderkey % 17 = 0 THEN []::VARCHAR[] WHEN l_orderkey % 13 = 0 THEN ['none'] ELSE list_sort(list(DISTINCT relation_id)) END AS relation_ids
  FROM lines GROUP BY l_orderkey
)"""


@query(
    EDGES.replace("WITH edges", "WITH RECURSIVE edges")
    + _PINS
    + """, walk AS (
  SELECT pin_id, 0 AS step, "start" AS node, CAST(NULL AS VARCHAR) AS error FROM pins
  UNION ALL
  SELECT w.pin_id, w.step + 1, CASE WHEN e.child = w.node THEN e.parent WHEN e.parent = w.node THEN e.child ELSE w.node END,
    CASE WHEN w.error IS NOT NULL THEN w.error WHEN e.child IS NULL THEN 'unknown relation' WHEN w.node NOT IN (e.child, e.parent) THEN 'does not connect' END
  FROM walk w JOIN pins p USING (pin_id) LEFT JOIN (SELECT DISTINCT relation_id, child, parent FROM edges) e ON e.relation_id = p.relation_ids[w.step + 1] WHERE w.step < len(p.relation_ids)
)
SELECT pin_id, CASE WHEN len(relation_ids) = 0 AND "start" <> "end" THEN 'path is empty' WHEN error IS NOT NULL THEN error WHEN node <> "end" THEN 'ends elsewhere' END AS error, node AS reached
FROM pins JOIN walk USING (pin_id) WHERE step = len(relation_ids)"""
)
def pinned_path(t: Tables) -> DataFrame:
    """Each order's lines as a pinned path through parts and suppliers."""
    edges = line_edges(t, "l_orderkey")
    pins = edges.groupBy(F.col("l_orderkey").alias("pin_id")).agg(
        F.min("child").alias("start"), F.max("parent").alias("last"), F.array_sort(F.collect_set("relation_id")).alias("ids")
    )
    pins = pins.select(
        "pin_id", "start", F.when(F.col("pin_id") % 11 == 0, "elsewhere").otherwise(F.col("last")).alias("end"),
        F.when(F.col("pin_id") % 17 == 0, F.array().cast("array<string>")).when(F.col("pin_id") % 13 == 0, F.array(F.lit("none"))).otherwise(F.col("ids")).alias("relation_ids"),
    )
    return graph.pinned(edges, pins)


@query(EDGES + "SELECT * FROM usable WHERE child IN (SELECT 'p' || p_partkey FROM part WHERE p_size < 10) AND parent IN (SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal > 0)")
def remap_relations(t: Tables) -> DataFrame:
    parts = t.part.where("p_size < 10").select(F.concat(F.lit("p"), "p_partkey").alias("node"))
    suppliers = t.supplier.where("s_acctbal > 0").select(F.concat(F.lit("s"), "s_suppkey").alias("node"))
    return graph.remap(graph.usable_edges(line_edges(t)), parts.union(suppliers))
