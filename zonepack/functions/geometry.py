"""DE-9IM matrices and predicates as Column expressions.

A matrix is a string of nine cells, feature by stratum: II IB IE BI BB BE EI EB EE. Polygons are arrays
of edges ``struct(x1, y1, x2, y2)``; inside is even-odd, so holes are edges like others. Boxes are four
columns and may be degenerate: a segment (its ends are the boundary) or a point.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMED = ("intersects", "contains", "within", "overlaps", "crosses", "touches")
EARTH = 6378137.0


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _axis(a0: Column, a1: Column, b0: Column, b1: Column) -> dict[str, Column]:
    """Highest dimension of the overlap of each interval's interior, ends and outside; null where empty.
    The point of a degenerate interval is interior."""
    proper_a, proper_b = a0 < a1, b0 < b1
    zero, one = F.lit(0), F.lit(1)

    def inside(p: Column, lo: Column, hi: Column, proper: Column) -> Column:
        return F.when(proper, (lo < p) & (p < hi)).otherwise(p == lo)

    return {
        "ii": F.when(proper_a & proper_b, F.when(F.greatest(a0, b0) < F.least(a1, b1), one)).when(proper_b, F.when(inside(a0, b0, b1, proper_b), zero)).otherwise(F.when(inside(b0, a0, a1, proper_a), zero)),
        "ie": F.when(proper_b & (inside(b0, a0, a1, proper_a) | inside(b1, a0, a1, proper_a)), zero),
        "ei": F.when(proper_a & (inside(a0, b0, b1, proper_b) | inside(a1, b0, b1, proper_b)), zero),
        "ee": F.when(proper_a & proper_b & ((a0 == b0) | (a0 == b1) | (a1 == b0) | (a1 == b1)), zero),
        "io": F.when((a0 < b0) | (a1 > b1), F.when(proper_a, one).otherwise(zero)),
        "oi": F.when((b0 < a0) | (b1 > a1), F.when(proper_b, one).otherwise(zero)),
        "eo": F.when(proper_a & ((a0 < b0) | (a1 > b1)), zero),
        "oe": F.when(proper_b & ((b0 < a0) | (b1 > a1)), zero),
        "oo": one,
    }


def _part(x: str, y: str) -> str:
    return "E" if "o" in x + y else "B" if "e" in x + y else "I"


def with_box_matrix(df: DataFrame, a: tuple[str, str, str, str], b: tuple[str, str, str, str]) -> DataFrame:
    """``df`` with ``matrix`` of two boxes (x0, y0, x1, y1), from what their sides share on each axis.

    The axes and the matrix are generated rows of one element: the optimizer doesn't copy them into the
    filters that follow, which would make an expression too large to compile.
    """
    a, b = tuple(map(col, a)), tuple(map(col, b))
    axes = [F.struct(*[c.alias(n) for n, c in _axis(a[i], a[i + 2], b[i], b[i + 2]).items()]).alias(n) for i, n in enumerate("xy")]
    df = df.withColumn("axes", F.explode(F.array(F.struct(*axes))))
    x, y = F.col("axes.x"), F.col("axes.y")
    cells: dict[str, list[Column]] = {}
    for ax, ay, bx, by in product("ieo", repeat=4):
        cells.setdefault(_part(ax, ay) + _part(bx, by), []).append(x[ax + bx] + y[ay + by])
    best = [F.greatest(*c) if len(c) > 1 else c[0] for c in (cells[r + c] for r, c in product("IBE", repeat=2))]
    return df.withColumn("matrix", F.explode(F.array(F.concat(*[F.coalesce(c.cast("string"), F.lit("F")) for c in best])))).drop("axes")


def box_dimension(x0: str, y0: str, x1: str, y1: str) -> Column:
    return (col(x0) < col(x1)).cast("int") + (col(y0) < col(y1)).cast("int")


def matches_pattern(matrix: Column, pattern: str) -> Column:
    """Does the matrix fit a nine-character pattern of T, F, 0, 1, 2 and *?"""
    return matrix.rlike(f"^{pattern.upper().replace('T', '[012]').replace('*', '.')}$")


def transpose(matrix: Column) -> Column:
    """The matrix with feature and stratum exchanged."""
    return F.concat(*[F.substring(matrix, 1 + 3 * (i % 3) + i // 3, 1) for i in range(9)])


def _expression(name: str) -> str:
    """A predicate as a regular expression over both dimensions and the matrix."""
    pattern = lambda p: p.upper().replace("T", "[012]").replace("*", ".")
    fixed = {
        "intersects": "..(?!FF.FF).*",
        "touches": "..(?!FF.FF)F.*",
        "contains": ".." + pattern("T*****FF*"),
        "within": ".." + pattern("T*F**F***"),
        "overlaps": f"11{pattern('1*T***T**')}|(00|22){pattern('T*T***T**')}",
        "crosses": f"(01|02|12){pattern('T*T******')}|(10|20|21){pattern('T*****T**')}|11{pattern('0********')}",
    }
    return fixed.get(name) or ".." + pattern(name)


def any_of(names: list[str] | tuple[str, ...], matrix: Column, dim_a: Column, dim_b: Column) -> Column:
    """Does one of the named predicates or patterns hold, of feature a and stratum b?"""
    return F.concat(dim_a.cast("string"), dim_b.cast("string"), matrix).rlike(f"^({'|'.join(map(_expression, names))})$")


def ring_edges(points: Column) -> Column:
    """Edges of a closed ring given by its corners (array of struct x, y), the first not repeated."""
    n = F.size(points)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(points[i]["x"].alias("x1"), points[i]["y"].alias("y1"), points[(i + 1) % n]["x"].alias("x2"), points[(i + 1) % n]["y"].alias("y2")))


def on_edge(x: Column, y: Column, edges: Column) -> Column:
    return F.exists(
        edges,
        lambda e: ((e["x2"] - e["x1"]) * (y - e["y1"]) == (e["y2"] - e["y1"]) * (x - e["x1"]))
        & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])),
    )


def inside(x: Column, y: Column, edges: Column) -> Column:
    """Even-odd ray cast; of points that are on no edge."""
    return F.aggregate(
        edges,
        F.lit(False),
        lambda odd, e: odd != (((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"])).eqNullSafe(True),
    )


def where_is(x: Column, y: Column, edges: Column) -> Column:
    """``in``, ``on`` or ``out`` of a polygon: edge test, then ray cast."""
    return F.when(on_edge(x, y, edges), "on").when(inside(x, y, edges), "in").otherwise("out")


def corners(edges: Column) -> Column:
    """The distinct end points of edges."""
    return F.array_distinct(F.flatten(F.transform(edges, lambda e: F.array(F.struct(e["x1"].alias("x"), e["y1"].alias("y")), F.struct(e["x2"].alias("x"), e["y2"].alias("y"))))))


def boundary_points(edges: Column) -> Column:
    """The boundary of a line of any number of parts: the points at which an odd number of edges end, each once. In the
    course of a part two edges meet at a corner, so that is where an odd number of parts end."""
    ends = F.array_sort(F.flatten(F.transform(edges, lambda e: F.array(F.struct(e["x1"].alias("x"), e["y1"].alias("y")), F.struct(e["x2"].alias("x"), e["y2"].alias("y"))))))
    none = F.array().cast("array<struct<x:double,y:double>>")

    def count(state: Column, p: Column) -> Column:
        same = state["last"].eqNullSafe(p)
        out = F.when(~same & state["odd"], F.array_append(state["out"], state["last"])).otherwise(state["out"])
        return F.struct(p.alias("last"), F.when(same, ~state["odd"]).otherwise(True).alias("odd"), out.alias("out"))

    start = F.struct(F.lit(None).cast("struct<x:double,y:double>").alias("last"), F.lit(False).alias("odd"), none.alias("out"))
    return F.aggregate(ends, start, count, lambda s: F.when(s["odd"], F.array_append(s["out"], s["last"])).otherwise(s["out"]))


def _inner_point(edges: Column) -> Column:
    """A point inside a polygon: half-way between the first two crossings of a line between its two lowest corners."""
    ys = F.slice(F.array_sort(F.array_distinct(F.transform(edges, lambda e: e["y1"]))), 1, 2)
    y = F.aggregate(ys, F.lit(0.0), lambda t, v: t + v) / 2
    xs = F.slice(F.array_sort(F.transform(F.filter(edges, lambda e: (e["y1"] > y) != (e["y2"] > y)), lambda e: e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"]))), 1, 2)
    return F.struct((F.aggregate(xs, F.lit(0.0), lambda t, v: t + v) / 2).alias("x"), y.alias("y"))


def inner_points(edges: Column, parted: bool) -> Column:
    """A point inside each part of a polygon; without edges there is none."""
    if not parted:
        return F.transform(F.filter(F.array(edges), lambda p: F.size(p) > 0), _inner_point)
    parts = F.array_distinct(F.transform(edges, lambda e: e["part"]))
    return F.transform(parts, lambda k: _inner_point(F.filter(edges, lambda e: e["part"] == k)))


def polygon_edges(parts: Column) -> Column:
    """Edges (part, x1, y1, x2, y2) of parts, arrays of rings of corners (x, y). A ring's last corner may be its first again."""

    def ring(k: Column, points: Column) -> Column:
        n = F.size(points)
        edges = F.transform(points, lambda p, i: F.struct(k.alias("part"), p["x"].alias("x1"), p["y"].alias("y1"), points[(i + 1) % n]["x"].alias("x2"), points[(i + 1) % n]["y"].alias("y2")))
        return F.filter(edges, lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))

    return F.flatten(F.transform(parts, lambda rings, k: F.flatten(F.transform(rings, lambda points: ring(k, points)))))


def line_edges(parts: Column) -> Column:
    """Edges (part, x1, y1, x2, y2) of parts, arrays of one list of corners (x, y) each."""

    def line(k: Column, points: Column) -> Column:
        edges = F.transform(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda p, i: F.struct(k.alias("part"), points[i]["x"].alias("x1"), points[i]["y"].alias("y1"), p["x"].alias("x2"), p["y"].alias("y2")))
        return F.filter(edges, lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))

    return F.flatten(F.transform(parts, lambda lists, k: F.flatten(F.transform(lists, lambda points: line(k, points)))))


def shape_box(parts: Column) -> list[Column]:
    """minx, miny, maxx, maxy of the corners of parts; null where there are none."""
    points = F.flatten(F.flatten(parts))
    xs, ys = (F.transform(points, lambda p: p[axis]) for axis in "xy")  # noqa: B023
    return [F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy")]


def point_matrix(x: Column, y: Column, edges: Column) -> Column:
    """Matrix of a point and a polygon; null where either is missing."""
    place = where_is(x, y, edges)
    matrix = F.when(place == "on", "F0FFFF212").when(place == "in", "0FFFFF212").otherwise("FF0FFF212")
    return F.when(x.isNotNull() & y.isNotNull() & edges.isNotNull() & (F.size(edges) > 0), matrix)


def to_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """Degrees (EPSG:4326) to metres (EPSG:3857)."""
    return F.radians(x) * EARTH, F.ln(F.tan(math.pi / 4 + F.radians(y) / 2)) * EARTH


def to_degrees(x: Column, y: Column) -> tuple[Column, Column]:
    """Metres (EPSG:3857) to degrees (EPSG:4326)."""
    return F.degrees(x / EARTH), F.degrees(2 * F.atan(F.exp(y / EARTH)) - math.pi / 2)


TRANSFORMATIONS = {(4326, 3857): to_mercator, (3857, 4326): to_degrees}


def reproject(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    """Coordinates in another system; unchanged if it is the same one."""
    if source == target:
        return x, y
    if (source, target) not in TRANSFORMATIONS:
        raise ValueError(f"no transformation from EPSG:{source} to EPSG:{target}")
    return TRANSFORMATIONS[source, target](x, y)


def reproject_edges(edges: Column, source: int, target: int) -> Column:
    """Edges with both ends in another system."""

    def moved(e: Column) -> Column:
        for i in (1, 2):
            x, y = reproject(e[f"x{i}"], e[f"y{i}"], source, target)
            e = e.withField(f"x{i}", x).withField(f"y{i}", y)
        return e

    return F.transform(edges, moved)


def box_edges(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A box as a ring of edges."""
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    return ring_edges(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners]))


def point_line_matrix(x: Column, y: Column, edges: Column) -> Column:
    """Matrix of a point and a line of any number of parts; null where either is missing. Closed lines have no boundary."""
    ends = boundary_points(edges)
    end = F.exists(ends, lambda p: (p["x"] == x) & (p["y"] == y))
    matrix = F.when(end, "F0FFFF102").when(on_edge(x, y, edges), F.when(F.size(ends) > 0, "0FFFFF102").otherwise("0FFFFF1F2")).otherwise(F.when(F.size(ends) > 0, "FF0FFF102").otherwise("FF0FFF1F2"))
    return F.when(x.isNotNull() & y.isNotNull() & edges.isNotNull() & (F.size(edges) > 0), matrix)
