"""Spatial matching: part points, boxes and segments against cells that the nations lay out.

A part stands at (p_size, p_partkey % 100); its box adds (p_partkey % 7, p_partkey % 5), which may be 0.
Nation n has the closed box of 10 x 20 at column n % 5, row n // 5, and the triangle in its lower left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonepack.functions import geometry as G
from zonepack.operators import spatial as S
from zonepack.queries.registry import Tables, query

A, B = ("ax0", "ay0", "ax1", "ay1"), ("bx0", "by0", "bx1", "by1")


def parts(t: Tables, box: bool = True) -> DataFrame:
    x, y, k = F.col("p_size").cast("double"), (F.col("p_partkey") % 100).cast("double"), F.col("p_partkey")
    return t.part.select(k.alias("fid"), x.alias("ax0"), y.alias("ay0"), (x + k % 7 * int(box)).alias("ax1"), (y + k % 5 * int(box)).alias("ay1"))


def cells(t: Tables) -> DataFrame:
    i, j = (F.col("n_nationkey") % 5).cast("double"), F.floor(F.col("n_nationkey") / 5).cast("double")
    return t.nation.select(F.col("n_nationkey").alias("stratum_id"), (i * 10).alias("bx0"), (j * 20).alias("by0"), (i * 10 + 10).alias("bx1"), (j * 20 + 20).alias("by1"))


def ring(*corners) -> F.Column:
    return G.ring_edges(F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in corners]))


BOX_RING = (("bx0", "by0"), ("bx1", "by0"), ("bx1", "by1"), ("bx0", "by1"))


def pairs(t: Tables, box: bool = True) -> DataFrame:
    return S.bbox_join(parts(t, box), A, cells(t), B)


def related(t: Tables) -> DataFrame:
    dims = {"dim_a": G.box_dimension(*A), "dim_b": G.box_dimension(*B)}
    return G.with_box_matrix(pairs(t), A, B).select("fid", "stratum_id", "matrix", *[c.alias(n) for n, c in dims.items()])


def named(t: Tables, *names: str) -> DataFrame:
    return related(t).where(G.any_of(list(names), F.col("matrix"), F.col("dim_a"), F.col("dim_b"))).select("fid", "stratum_id")


_CELLS = "cells AS (SELECT n_nationkey AS stratum_id, n_nationkey % 5 * 10 AS bx0, n_nationkey // 5 * 20 AS by0, n_nationkey % 5 * 10 + 10 AS bx1, n_nationkey // 5 * 20 + 20 AS by1 FROM nation)"
_PARTS = "parts AS (SELECT p_partkey AS fid, p_size AS ax0, p_partkey % 100 AS ay0, p_size + p_partkey % 7 AS ax1, p_partkey % 100 + p_partkey % 5 AS ay1 FROM part)"
_MEET = f"WITH {_CELLS}, {_PARTS}, pairs AS (SELECT *, CAST(ax0 < ax1 AS INT) + CAST(ay0 < ay1 AS INT) AS dim, greatest(ax0, bx0) AS x0, least(ax1, bx1) AS x1, greatest(ay0, by0) AS y0, least(ay1, by1) AS y1 FROM parts JOIN cells ON ax0 <= bx1 AND ax1 >= bx0 AND ay0 <= by1 AND ay1 >= by0)"
#: A part's box has something of its interior inside the cell (a proper rectangle): a point of it strictly inside on both axes.
_IN_X = "(CASE WHEN ax0 < ax1 THEN x0 < x1 ELSE bx0 < ax0 AND ax0 < bx1 END)"
_IN_Y = "(CASE WHEN ay0 < ay1 THEN y0 < y1 ELSE by0 < ay0 AND ay0 < by1 END)"
_INSIDE = f"({_IN_X} AND {_IN_Y})"
_OUTSIDE = "(ax0 < bx0 OR ax1 > bx1 OR ay0 < by0 OR ay1 > by1)"
_CONTAINS = "(dim = 2 AND ax0 <= bx0 AND bx1 <= ax1 AND ay0 <= by0 AND by1 <= ay1)"


def _where(condition: str) -> str:
    return f"{_MEET} SELECT fid, stratum_id FROM pairs WHERE {condition}"


_AXIS = """CASE WHEN {p}a AND {p}b THEN CASE WHEN greatest({a}0, {b}0) < least({a}1, {b}1) THEN 1 END WHEN {p}b THEN CASE WHEN {b}0 < {a}0 AND {a}0 < {b}1 THEN 0 END END AS {n}ii,
CASE WHEN ({p}a AND ({a}0 < {b}0 AND {b}0 < {a}1 OR {a}0 < {b}1 AND {b}1 < {a}1)) OR (NOT {p}a AND {a}0 IN ({b}0, {b}1)) THEN 0 END AS {n}ie,
CASE WHEN {p}a AND ({b}0 < {a}0 AND {a}0 < {b}1 OR {b}0 < {a}1 AND {a}1 < {b}1) THEN 0 END AS {n}ei,
CASE WHEN {p}a AND ({a}0 IN ({b}0, {b}1) OR {a}1 IN ({b}0, {b}1)) THEN 0 END AS {n}ee,
CASE WHEN {a}0 < {b}0 OR {a}1 > {b}1 THEN CAST({p}a AS INT) END AS {n}io, CASE WHEN {b}0 < {a}0 OR {b}1 > {a}1 THEN 1 END AS {n}oi,
CASE WHEN {p}a AND ({a}0 < {b}0 OR {a}1 > {b}1) THEN 0 END AS {n}eo, CASE WHEN {b}0 < {a}0 OR {b}1 > {a}1 THEN 0 END AS {n}oe, 1 AS {n}oo"""


def _matrix_sql() -> str:
    part = {"I": ["ii"], "B": ["ei", "ie", "ee"], "E": [x + y for x in "ieo" for y in "ieo" if "o" in x + y]}
    cells = []
    for r in "IBE":
        for c in "IBE":
            terms = [f"x{ra[0]}{cb[0]} + y{ra[1]}{cb[1]}" for ra in part[r] for cb in part[c]]
            cells.append(f"coalesce(CAST(greatest({', '.join(terms)}) AS VARCHAR), 'F')" if len(terms) > 1 else f"coalesce(CAST({terms[0]} AS VARCHAR), 'F')")
    x, y = _AXIS.format(p="px", a="ax", b="bx", n="x"), _AXIS.format(p="py", a="ay", b="by", n="y")
    return f"{_MEET}, proper AS (SELECT *, ax0 < ax1 AS pxa, true AS pxb, ay0 < ay1 AS pya, true AS pyb FROM pairs), axes AS (SELECT fid, stratum_id, {x}, {y} FROM proper), related AS (SELECT fid, stratum_id, {' || '.join(cells)} AS matrix FROM axes)"


_RELATED = _matrix_sql()


@query(f"WITH {_CELLS} SELECT p_partkey AS fid, stratum_id FROM part JOIN cells ON p_size BETWEEN bx0 AND bx1 AND p_partkey % 100 BETWEEN by0 AND by1")
def bbox_candidates(t: Tables) -> DataFrame:
    return pairs(t, box=False).select("fid", "stratum_id")


@query(
    f"""WITH {_CELLS}, placed AS (SELECT p_partkey AS fid, stratum_id, p_size - bx0 AS u, p_partkey % 100 - by0 AS v FROM part JOIN cells ON p_size BETWEEN bx0 AND bx1 AND p_partkey % 100 BETWEEN by0 AND by1)
SELECT fid, stratum_id, CASE WHEN 2 * u + v > 20 THEN 'FF0FFF212' WHEN u = 0 OR v = 0 OR 2 * u + v = 20 THEN 'F0FFFF212' ELSE '0FFFFF212' END AS matrix FROM placed"""
)
def point_in_polygon(t: Tables) -> DataFrame:
    triangle = ring(("bx0", "by0"), ("bx1", "by0"), ("bx0", "by1"))
    return pairs(t, box=False).select("fid", "stratum_id", G.point_matrix(F.col("ax0"), F.col("ay0"), triangle).alias("matrix"))


@query(_RELATED + " SELECT * FROM related")
def box_relate(t: Tables) -> DataFrame:
    return related(t).select("fid", "stratum_id", "matrix")


#: The part of a segment inside a closed box, as the range t0..t1 of its parameter (a segment runs from corner to corner of its box).
_CLIP = f"""{_MEET}, seg AS (SELECT *, ax1 - ax0 AS dx, ay1 - ay0 AS dy FROM pairs WHERE dim > 0),
clip AS (SELECT *, greatest(0, CASE WHEN dx > 0 THEN (bx0 - ax0) / dx ELSE 0 END, CASE WHEN dy > 0 THEN (by0 - ay0) / dy ELSE 0 END) AS t0,
  least(1, CASE WHEN dx > 0 THEN (bx1 - ax0) / dx ELSE 1 END, CASE WHEN dy > 0 THEN (by1 - ay0) / dy ELSE 1 END) AS t1 FROM seg),
mid AS (SELECT *, t0 <= t1 AS meets, t0 < t1 AS along, ax0 + (t0 + t1) / 2 * dx AS mx, ay0 + (t0 + t1) / 2 * dy AS my,
  CASE WHEN ax0 BETWEEN bx0 AND bx1 AND ay0 BETWEEN by0 AND by1 THEN CASE WHEN ax0 IN (bx0, bx1) OR ay0 IN (by0, by1) THEN 'on' ELSE 'in' END ELSE 'out' END AS s,
  CASE WHEN ax1 BETWEEN bx0 AND bx1 AND ay1 BETWEEN by0 AND by1 THEN CASE WHEN ax1 IN (bx0, bx1) OR ay1 IN (by0, by1) THEN 'on' ELSE 'in' END ELSE 'out' END AS e FROM clip)
SELECT fid, stratum_id,
  CASE WHEN along AND bx0 < mx AND mx < bx1 AND by0 < my AND my < by1 THEN '1' ELSE 'F' END ||
  CASE WHEN along AND NOT (bx0 < mx AND mx < bx1 AND by0 < my AND my < by1) THEN '1' WHEN meets AND (t0 > 0 AND t0 < 1 OR t1 > 0 AND t1 < 1) THEN '0' ELSE 'F' END ||
  CASE WHEN NOT meets OR t0 > 0 OR t1 < 1 THEN '1' ELSE 'F' END ||
  CASE WHEN 'in' IN (s, e) THEN '0' ELSE 'F' END || CASE WHEN 'on' IN (s, e) THEN '0' ELSE 'F' END || CASE WHEN 'out' IN (s, e) THEN '0' ELSE 'F' END || '212' AS matrix
FROM mid"""


@query(_CLIP)
def segment_relate(t: Tables) -> DataFrame:
    """Segments from corner to corner of the parts' boxes, against the cells as polygons."""
    line = F.array(F.struct(F.col("ax0").alias("x1"), F.col("ay0").alias("y1"), F.col("ax1").alias("x2"), F.col("ay1").alias("y2")))
    rows = pairs(t).where(G.box_dimension(*A) > 0).select("fid", "stratum_id", line.alias("line"), ring(*BOX_RING).alias("polygon"))
    return S.line_relate(rows, ["fid", "stratum_id"], "line", "polygon")


@query(_RELATED + " SELECT fid, stratum_id, matrix FROM related JOIN parts USING (fid) WHERE ax0 < ax1 AND ay0 < ay1")
def polygon_relate(t: Tables) -> DataFrame:
    """The proper boxes as polygons, by the general method."""
    mine = ring(("ax0", "ay0"), ("ax1", "ay0"), ("ax1", "ay1"), ("ax0", "ay1"))
    rows = pairs(t).where(G.box_dimension(*A) == 2).select("fid", "stratum_id", mine.alias("a"), ring(*BOX_RING).alias("b"))
    return S.polygon_relate(rows, ["fid", "stratum_id"], "a", "b")


#: Shapes on a grid, as rectangles (what, k, part, x0, y0, x1, y1): of a polygon's, those that lie in an odd number hold; a line's are segments.
_SHAPES = [
    ("f", 0, 0, 0, 0, 3, 3), ("f", 0, 0, 1, 1, 2, 2), ("f", 1, 0, 0, 0, 2, 1), ("f", 1, 1, 3, 0, 4, 2), ("f", 2, 0, 0, 0, 5, 5), ("f", 2, 0, 1, 1, 4, 4),
    ("f", 2, 1, 2, 2, 3, 3), ("f", 3, 0, 0, 0, 2, 2), ("s", 0, 0, 0, 0, 8, 8), ("s", 0, 0, 3, 3, 5, 5), ("s", 1, 0, 0, 0, 4, 9), ("s", 1, 1, 6, 0, 9, 9),
    ("s", 1, 1, 7, 2, 8, 3), ("s", 2, 0, 0, 0, 9, 15), ("s", 2, 0, 2, 2, 7, 13), ("s", 2, 1, 3, 4, 6, 9),
]
_LINES = [
    ("f", 0, 0, 0, 0, 4, 0), ("f", 0, 0, 4, 0, 4, 3), ("f", 1, 0, 0, 0, 3, 0), ("f", 1, 1, 0, 2, 3, 2), ("f", 1, 2, 1, 2, 1, 5), ("f", 2, 0, 0, 0, 2, 0), ("f", 2, 0, 2, 0, 2, 2),
    ("f", 2, 0, 0, 2, 2, 2), ("f", 2, 0, 0, 0, 0, 2), ("f", 3, 0, 0, 0, 0, 6), ("s", 0, 0, 0, 5, 9, 5), ("s", 0, 1, 5, 0, 5, 15), ("s", 1, 0, 0, 0, 0, 9), ("s", 1, 0, 0, 0, 9, 0),
    ("s", 1, 1, 4, 4, 4, 12), ("s", 2, 0, 2, 2, 7, 2), ("s", 2, 0, 7, 2, 7, 9), ("s", 2, 0, 2, 9, 7, 9), ("s", 2, 0, 2, 2, 2, 9),
]
_PLACED = "place AS (SELECT 'f' AS what, p_partkey AS id, p_partkey % 4 AS k, p_size % 40 AS x, p_partkey % 90 AS y FROM part UNION ALL SELECT 's', n_nationkey, n_nationkey % 3, n_nationkey % 5 * 10, n_nationkey // 5 * 20 FROM nation)"


def _grid_shapes(shapes: list) -> str:
    rows = ", ".join(f"('{w}', {', '.join(map(str, r))})" for w, *r in shapes)
    return f"WITH shapes(what, k, part, x0, y0, x1, y1) AS (VALUES {rows}), {_PLACED}, boxes AS (SELECT what, id, x + min(x0) AS bx0, y + min(y0) AS by0, x + max(x1) AS bx1, y + max(y1) AS by1 FROM place JOIN shapes USING (what, k) GROUP BY what, id, x, y), pairs AS (SELECT f.id AS fid, s.id AS stratum_id FROM boxes f JOIN boxes s ON f.what = 'f' AND s.what = 's' AND f.bx0 <= s.bx1 AND f.bx1 >= s.bx0 AND f.by0 <= s.by1 AND f.by1 >= s.by0)"


#: Cells, sides and corners of the grid in doubled coordinates: odd, odd is a cell, even, even a corner. A polygon has a side or corner inside it
#: if all cells around are its own, on its boundary if some are.
_MATRIX = """, placed AS (SELECT f.fid, f.stratum_id, e.x, e.y, e.part AS a, 0 AS b, e.dim FROM pairs f JOIN element e ON e.what = 'f' AND e.id = f.fid UNION ALL SELECT f.fid, f.stratum_id, e.x, e.y, 0, e.part, e.dim FROM pairs f JOIN element e ON e.what = 's' AND e.id = f.stratum_id),
met AS (SELECT fid, stratum_id, x, y, max(a) AS a, max(b) AS b, max(dim) AS dim FROM placed GROUP BY 1, 2, 3, 4),
cells AS (SELECT fid, stratum_id, CASE a WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END * 3 + CASE b WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS at, max(dim) AS dim FROM met GROUP BY 1, 2, 3)
SELECT fid, stratum_id, (SELECT string_agg(coalesce(CAST(dim AS VARCHAR), 'F'), '' ORDER BY i) FROM range(8) r(i) LEFT JOIN cells c ON c.at = i AND c.fid = p.fid AND c.stratum_id = p.stratum_id) || '2' AS matrix FROM pairs p"""
_POLYGONS = _grid_shapes(_SHAPES) + """, own AS (SELECT p.what, p.id, x + i AS cx, y + j AS cy FROM place p JOIN shapes s USING (what, k), range(20) a(i), range(20) b(j) WHERE i >= x0 AND i < x1 AND j >= y0 AND j < y1 GROUP BY ALL HAVING count(*) % 2 = 1),
element AS (SELECT what, id, 2 * cx + 1 + i AS x, 2 * cy + 1 + j AS y, CASE WHEN count(*) = [1, 2, 4][1 + abs(i) + abs(j)] THEN 2 ELSE 1 END AS part, 2 - abs(i) - abs(j) AS dim FROM (SELECT what, id, cx, cy, i, j FROM own, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)) GROUP BY what, id, 2 * cx + 1 + i, 2 * cy + 1 + j, abs(i), abs(j))"""
_SEGMENTS = _grid_shapes(_LINES) + """, own AS (SELECT p.what, p.id, 2 * (x + i) + CAST(x0 < x1 AS INT) AS cx, 2 * (y + j) + CAST(y0 < y1 AS INT) AS cy FROM place p JOIN shapes s USING (what, k), range(20) a(i), range(20) b(j) WHERE i >= x0 AND j >= y0 AND (x0 < x1 AND i < x1 AND j = y0 OR y0 < y1 AND j < y1 AND i = x0)),
element AS (SELECT what, id, cx AS x, cy AS y, 2 AS part, 1 AS dim FROM own UNION ALL SELECT what, id, cx + s * (cx % 2), cy + s * (cy % 2), CASE WHEN count(*) % 2 = 1 THEN 1 ELSE 2 END, 0 FROM own, (SELECT unnest([-1, 1]) AS s) GROUP BY ALL)"""


def _grid_layer(t: Tables, what: str, shapes: list, box: tuple[str, ...], corners) -> DataFrame:
    """(fid or stratum_id, box, shape): the shapes of a kind at their places; ``corners`` are those of a rectangle. The shapes are one literal."""
    if what == "f":
        rows = t.part.select(F.col("p_partkey").alias("fid"), (F.col("p_partkey") % 4).alias("k"), (F.col("p_size") % 40).cast("double").alias("x"), (F.col("p_partkey") % 90).cast("double").alias("y"))
    else:
        n = F.col("n_nationkey")
        rows = t.nation.select(n.alias("stratum_id"), (n % 3).alias("k"), (n % 5 * 10).cast("double").alias("x"), (F.floor(n / 5) * 20).cast("double").alias("y"))
    kinds = []
    for k in sorted({s[1] for s in shapes if s[0] == what}):
        own = [s[2:] for s in shapes if s[:2] == (what, k)]
        kinds.append([[[[float(c) for c in corner] for corner in corners(*s[1:])] for s in own if s[0] == p] for p in sorted({s[0] for s in own})])
    place = lambda p: F.struct((F.col("x") + p[0]).alias("x"), (F.col("y") + p[1]).alias("y"))
    shape = F.from_json(F.lit(str(kinds)), "array<array<array<array<array<double>>>>>")[F.col("k").cast("int")]
    rows = rows.withColumn("parts", F.transform(shape, lambda rings: F.transform(rings, lambda points: F.transform(points, place))))
    return rows.select(rows.columns[0], *[c.alias(n) for c, n in zip(G.shape_box(F.col("parts")), box)], "parts")


@query(_POLYGONS + _MATRIX)
def multi_relate(t: Tables) -> DataFrame:
    """Polygons with holes, several parts and islands in holes, on both sides."""
    rectangle = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    features, cells = _grid_layer(t, "f", _SHAPES, A, rectangle), _grid_layer(t, "s", _SHAPES, B, rectangle)
    rows = S.bbox_join(features.withColumnRenamed("parts", "f_parts"), A, cells.withColumnRenamed("parts", "s_parts"), B)
    rows = rows.select("fid", "stratum_id", G.polygon_edges(F.col("f_parts")).alias("a"), G.polygon_edges(F.col("s_parts")).alias("b"))
    return S.polygon_relate(rows, ["fid", "stratum_id"], "a", "b")


@query(_SEGMENTS + _MATRIX)
def line_line_relate(t: Tables) -> DataFrame:
    """Lines of several parts, closed and crossing ones, on both sides."""
    segment = lambda x0, y0, x1, y1: [(x0, y0), (x1, y1)]
    features, cells = _grid_layer(t, "f", _LINES, A, segment), _grid_layer(t, "s", _LINES, B, segment)
    rows = S.bbox_join(features.withColumnRenamed("parts", "f_parts"), A, cells.withColumnRenamed("parts", "s_parts"), B)
    rows = rows.select("fid", "stratum_id", G.line_edges(F.col("f_parts")).alias("a"), G.line_edges(F.col("s_parts")).alias("b"))
    return S.line_line_relate(rows, ["fid", "stratum_id"], "a", "b")


#: Points in the unit square, half of them in a corner of a hundredth of it; thin boxes of all sizes there.
_DENSE = "WITH f AS (SELECT p_partkey AS fid, p_partkey * 7919 % 10007 / 10007.0 / CASE WHEN p_partkey % 2 = 0 THEN 10 ELSE 1 END AS x, p_partkey * 7907 % 10009 / 10009.0 / CASE WHEN p_partkey % 2 = 0 THEN 10 ELSE 1 END AS y FROM part), s AS (SELECT s_suppkey AS stratum_id, s_suppkey * 4813 % 997 / 1000.0 AS x, s_suppkey * 4639 % 991 / 1000.0 AS y, (1 + s_suppkey % 3) / 50.0 AS w, (1 + s_suppkey % 5) / 400.0 AS h FROM supplier)"


def dense(t: Tables) -> tuple[DataFrame, DataFrame]:
    p, s = F.col("p_partkey"), F.col("s_suppkey")
    near = F.when(p % 2 == 0, 10).otherwise(1)
    x, y = p * 7919 % 10007 / 10007.0 / near, p * 7907 % 10009 / 10009.0 / near
    u, v = s * 4813 % 997 / 1000.0, s * 4639 % 991 / 1000.0
    features = t.part.select(p.alias("fid"), *[c.alias(n) for c, n in zip((x, y, x, y), A)])
    return features, t.supplier.select(s.alias("stratum_id"), *[c.alias(n) for c, n in zip((u, v, u + (1 + s % 3) / 50.0, v + (1 + s % 5) / 400.0), B)])


@query(_DENSE + " SELECT fid, stratum_id FROM f JOIN s ON f.x BETWEEN s.x AND s.x + w AND f.y BETWEEN s.y AND s.y + h")
def bbox_dense(t: Tables) -> DataFrame:
    """All features within one unit: the grid comes from the extents."""
    features, strata = dense(t)
    return S.bbox_join(features, A, strata, B).select("fid", "stratum_id")


@query(_where("true"))
def sp_intersects(t: Tables) -> DataFrame:
    return named(t, "intersects")


@query(f"WITH {_CELLS} SELECT stratum_id AS fid, p_partkey AS stratum_id FROM part JOIN cells ON bx0 <= p_size AND p_size + 1 <= bx1 AND by0 <= p_partkey % 100 AND p_partkey % 100 + 1 <= by1")
def sp_contains(t: Tables) -> DataFrame:
    """The cells as features, unit squares at the parts as strata."""
    squares = parts(t, box=False).select(F.col("fid").alias("stratum_id"), F.col("ax0").alias("bx0"), F.col("ay0").alias("by0"), (F.col("ax0") + 1).alias("bx1"), (F.col("ay0") + 1).alias("by1"))
    features = cells(t).toDF("fid", *A)
    found = G.with_box_matrix(S.bbox_join(features, A, squares, B), A, B)
    return found.where(G.any_of(["contains"], F.col("matrix"), G.box_dimension(*A), G.box_dimension(*B))).select("fid", "stratum_id")


@query(_where(f"{_INSIDE} AND NOT {_OUTSIDE}"))
def sp_within(t: Tables) -> DataFrame:
    return named(t, "within")


@query(_where(f"dim = 2 AND {_INSIDE} AND {_OUTSIDE} AND NOT {_CONTAINS}"))
def sp_overlaps(t: Tables) -> DataFrame:
    return named(t, "overlaps")


@query(_where(f"dim < 2 AND {_INSIDE} AND {_OUTSIDE}"))
def sp_crosses(t: Tables) -> DataFrame:
    return named(t, "crosses")


@query(_where(f"NOT {_INSIDE}"))
def sp_touches(t: Tables) -> DataFrame:
    return named(t, "touches")


@query(_RELATED + " SELECT fid, stratum_id FROM related WHERE regexp_matches(matrix, '^[012].1...[012]..$')")
def sp_de9im(t: Tables) -> DataFrame:
    return named(t, "t*1***T**")


@query(_RELATED + " SELECT fid, stratum_id, array_to_string(list_transform([1, 4, 7, 2, 5, 8, 3, 6, 9], lambda i: matrix[i]), '') AS matrix FROM related")
def de9im_transpose(t: Tables) -> DataFrame:
    return related(t).select("fid", "stratum_id", G.transpose(F.col("matrix")).alias("matrix"))


@query(_where(f"(NOT {_INSIDE}) OR ({_INSIDE} AND NOT {_OUTSIDE})"))
def sp_or(t: Tables) -> DataFrame:
    return named(t, "within", "touches")


@query(f"WITH {_CELLS} SELECT p_partkey AS fid, stratum_id FROM part JOIN cells ON p_size BETWEEN bx0 AND bx1 AND p_partkey % 100 BETWEEN by0 AND by1 WHERE p_partkey % 3 <> 0 AND stratum_id % 4 <> 1")
def sp_null_geom(t: Tables) -> DataFrame:
    """A third of the features and a quarter of the strata have no geometry."""
    features = parts(t, box=False).withColumn("ax0", F.when(F.col("fid") % 3 != 0, F.col("ax0")))
    strata = cells(t).withColumn("bx0", F.when(F.col("stratum_id") % 4 != 1, F.col("bx0")))
    triangles = S.bbox_join(features, A, strata, B).where(G.point_matrix(F.col("ax0"), F.col("ay0"), ring(*BOX_RING)).isNotNull())
    return triangles.select("fid", "stratum_id")


@query("SELECT p_partkey AS stratum_id, round(radians(p_size) * 6378137.0, 3) AS x, round(ln(tan(pi() / 4 + radians(p_partkey % 80) / 2)) * 6378137.0, 3) AS y, CAST(p_size AS DOUBLE) AS lon, CAST(p_partkey % 80 AS DOUBLE) AS lat FROM part")
def reproject_strata(t: Tables) -> DataFrame:
    """Degrees to metres, and back."""
    rows = t.part.select(F.col("p_partkey").alias("stratum_id"), F.col("p_size").cast("double").alias("lon"), (F.col("p_partkey") % 80).cast("double").alias("lat"))
    x, y = G.reproject(F.col("lon"), F.col("lat"), 4326, 3857)
    rows = rows.select("stratum_id", x.alias("x"), y.alias("y"))
    lon, lat = G.reproject(F.col("x"), F.col("y"), 3857, 4326)
    return rows.select("stratum_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(lon, 6).alias("lon"), F.abs(F.round(lat, 6)).alias("lat"))
