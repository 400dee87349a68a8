"""Edges of many pairs of geometries, each noded at the other: flags of all pairs of an Arrow batch at once.

The arithmetic is that of ``geometry``, term by term. Every look-up expands queries (an edge, a point) by the edges of the
other geometry of their pair, in slices of ``SLICE`` rows, so memory is bounded by a slice and one geometry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 17


class Edges:
    """The edges of one side, flat: corners, the pair of each, and where a pair's edges begin (``at``)."""

    def __init__(self, lists: pa.Array):
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        number = lambda n: pc.struct_field(flat, n).to_numpy(zero_copy_only=False).astype(np.float64)
        self.x1, self.y1, self.x2, self.y2 = map(number, ("x1", "y1", "x2", "y2"))
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        self.pair = np.repeat(np.arange(len(sizes)), sizes)
        self.part = number("part") if flat.type.get_field_index("part") >= 0 else np.zeros(len(self.x1))


def _expanded(groups: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, member): each query with all members ``at[g]`` up to ``at[g + 1]`` of its group, in slices."""
    sizes = at[groups + 1] - at[groups]
    ends = np.cumsum(sizes)
    begin = 0
    while begin < len(groups):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + SLICE, "right")))
        n = sizes[begin:end]
        query = np.repeat(np.arange(begin, end), n)
        member = np.arange(len(query)) + np.repeat(at[groups[begin:end]] - (ends[begin:end] - n - done), n)
        yield query, member
        begin = end


def _any(n: int, groups: np.ndarray) -> np.ndarray:
    found = np.zeros(n, bool)
    found[groups] = True
    return found


def _on_edge(x: np.ndarray, y: np.ndarray, pair: np.ndarray, e: Edges) -> np.ndarray:
    found = np.zeros(len(x), bool)
    for q, o in _expanded(pair, e.at):
        x1, y1, x2, y2, px, py = e.x1[o], e.y1[o], e.x2[o], e.y2[o], x[q], y[q]
        on = ((x2 - x1) * (py - y1) == (y2 - y1) * (px - x1)) & (px >= np.minimum(x1, x2)) & (px <= np.maximum(x1, x2)) & (py >= np.minimum(y1, y2)) & (py <= np.maximum(y1, y2))
        found[q[on]] = True
    return found


def _inside(x: np.ndarray, y: np.ndarray, pair: np.ndarray, e: Edges) -> np.ndarray:
    """Even-odd ray cast; of points that are on no edge."""
    odd = np.zeros(len(x), np.int64)
    for q, o in _expanded(pair, e.at):
        astride = (e.y1[o] > y[q]) != (e.y2[o] > y[q])
        q, o = q[astride], o[astride]
        left = x[q] < (e.x2[o] - e.x1[o]) * (y[q] - e.y1[o]) / (e.y2[o] - e.y1[o]) + e.x1[o]
        if len(q):
            counts = np.bincount(q[left] - q[0])
            odd[q[0] : q[0] + len(counts)] += counts
    return odd % 2 == 1


def _where(x: np.ndarray, y: np.ndarray, pair: np.ndarray, e: Edges) -> np.ndarray:
    """0 on, 1 in, 2 out of a polygon."""
    place = np.where(_on_edge(x, y, pair, e), 0, 2)
    rest = np.flatnonzero(place)
    place[rest[_inside(x[rest], y[rest], pair[rest], e)]] = 1
    return place


def _pieces(own: Edges, other: Edges, area: bool, pairs: int) -> dict[str, np.ndarray]:
    """By pair: has it pieces of ``own`` edges ``on``, ``in`` and ``out`` of the other geometry (an ``area``, or a line: not in);
    is an end of one inside its edge (``met``), and does an edge cross one of the other inside both (``cross``)?"""
    use = np.flatnonzero((own.x1 != own.x2) | (own.y1 != own.y2))
    pair = own.pair[use]
    ex, ey, dx, dy = own.x1[use], own.y1[use], own.x2[use] - own.x1[use], own.y2[use] - own.y1[use]
    length = dx * dx + dy * dy
    n = len(use)
    cut, lying, crossed = [(np.arange(n), np.zeros(n)), (np.arange(n), np.ones(n))], [], []
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        for q, o in _expanded(pair, other.at):
            px, py = dx[q], dy[q]
            ox, oy = other.x2[o] - other.x1[o], other.y2[o] - other.y1[o]
            wx, wy = other.x1[o] - ex[q], other.y1[o] - ey[q]
            vx, vy = other.x2[o] - ex[q], other.y2[o] - ey[q]
            w = wx * py - wy * px
            collinear = (w == 0) & (vx * py - vy * px == 0)
            lies = np.flatnonzero(collinear)
            if len(lies):
                k = q[lies]
                first, last = (wx[lies] * px[lies] + wy[lies] * py[lies]) / length[k], (vx[lies] * px[lies] + vy[lies] * py[lies]) / length[k]
                lying.append((k, np.minimum(first, last), np.maximum(first, last)))
                cut += [(k, first), (k, last)]
            cross = px * oy - py * ox
            cross[cross == 0] = np.nan
            t, u = (wx * oy - wy * ox) / cross, w / cross
            meets = ~collinear & (t > 0) & (t < 1) & (u >= 0) & (u <= 1)
            cut.append((q[meets], t[meets]))
            crossed.append(pair[q[(t > 0) & (t < 1) & (u > 0) & (u < 1)]])
    edge, t = (np.concatenate(c) for c in zip(*cut))
    within = (t >= 0) & (t <= 1)
    edge, t = edge[within], t[within]
    order = np.lexsort((t, edge))
    edge, t = edge[order], t[order]
    new = np.ones(len(edge), bool)
    new[1:] = (edge[1:] != edge[:-1]) | (t[1:] != t[:-1])
    edge, t = edge[new], t[new]
    same = np.flatnonzero(edge[1:] == edge[:-1])
    piece, mid = edge[same], (t[same] + t[same + 1]) / 2
    on = np.zeros(len(piece), bool)
    if lying:
        k, low, high = (np.concatenate(c) for c in zip(*lying))
        order = np.argsort(k, kind="stable")
        low, high = low[order], high[order]
        at = np.concatenate([[0], np.cumsum(np.bincount(k, minlength=n))])
        for q, o in _expanded(piece, at):
            on[q[(mid[q] >= low[o]) & (mid[q] <= high[o])]] = True
    place = np.where(on, 0, 2)
    rest = np.flatnonzero(place)
    if area:
        x, y = ex[piece[rest]] + mid[rest] * dx[piece[rest]], ey[piece[rest]] + mid[rest] * dy[piece[rest]]
        place[rest[_inside(x, y, pair[piece[rest]], other)]] = 1
    met = pair[np.bincount(edge, minlength=n) > 2]
    found = {p: _any(pairs, pair[piece[place == i]]) for i, p in enumerate(("on", "in", "out"))}
    return found | {"met": _any(pairs, met), "cross": _any(pairs, np.concatenate(crossed) if crossed else met[:0]), "some": _any(pairs, pair)}


def _ends(e: Edges) -> tuple[tuple, tuple]:
    """(pair, x, y) of the corners of lines, each once: the boundary, where an odd number of edges end, and the others."""
    pair, x, y = np.concatenate([e.pair, e.pair]), np.concatenate([e.x1, e.x2]), np.concatenate([e.y1, e.y2])
    order = np.lexsort((y, x, pair))
    pair, x, y = pair[order], x[order], y[order]
    first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])) if len(pair) else np.zeros(0, np.int64)
    odd = np.diff(np.append(first, len(pair))) % 2 == 1
    return tuple((pair[f], x[f], y[f]) for f in (first[odd], first[~odd]))


def _listed(points: tuple, among: tuple, pairs: int) -> np.ndarray:
    """Which of the points are among others of their pair?"""
    (pair, x, y), (groups, ox, oy) = points, among
    at = np.concatenate([[0], np.cumsum(np.bincount(groups, minlength=pairs))])
    found = np.zeros(len(pair), bool)
    for q, o in _expanded(pair, at):
        found[q[(x[q] == ox[o]) & (y[q] == oy[o])]] = True
    return found


def _two_least(group: np.ndarray, value: np.ndarray, groups: int, distinct: bool) -> np.ndarray:
    """Half the sum of the two least values of each group; of the only one, and 0 where there is none."""
    order = np.lexsort((value, group))
    group, value = group[order], value[order]
    if distinct and len(group):
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (value[1:] != value[:-1])])
        group, value = group[new], value[new]
    sizes = np.bincount(group, minlength=groups)
    at = np.cumsum(sizes) - sizes
    total = np.zeros(groups)
    for k in (0, 1):
        has = sizes > k
        total[has] += value[at[has] + k]
    return total / 2


def _inner_points(e: Edges) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, pair) of a point inside each part of a polygon; see ``geometry.inner_points``."""
    order = np.lexsort((e.part, e.pair))
    pair, part = e.pair[order], e.part[order]
    new = np.concatenate([[True], (pair[1:] != pair[:-1]) | (part[1:] != part[:-1])]) if len(pair) else np.zeros(0, bool)
    group = np.empty(len(pair), np.int64)
    group[order] = np.cumsum(new) - 1
    n = int(new.sum())
    y = _two_least(group, e.y1, n, True)
    astride = np.flatnonzero((e.y1 > y[group]) != (e.y2 > y[group]))
    level = y[group[astride]]
    x1, y1, x2, y2 = (c[astride] for c in (e.x1, e.y1, e.x2, e.y2))
    return _two_least(group[astride], x1 + (level - y1) * (x2 - x1) / (y2 - y1), n, False), y, pair[new]


def polygon_polygon(a: Edges, b: Edges, pairs: int) -> dict[str, np.ndarray]:
    flags = {}
    for n, own, other in (("a", a, b), ("b", b, a)):
        flags |= {f"{n}_{p}": f for p, f in _pieces(own, other, True, pairs).items()}
        x, y, pair = _inner_points(own)
        place = _where(x, y, pair, other)
        flags[f"{n}_inner_in"], flags[f"{n}_inner_out"] = _any(pairs, pair[place == 1]), _any(pairs, pair[place != 1])
        flags[f"{n}_corner"] = _any(pairs, own.pair[_on_edge(own.x1, own.y1, own.pair, other)])
    return flags


def line_polygon(a: Edges, b: Edges, pairs: int) -> dict[str, np.ndarray]:
    flags = {f"{n}_{p}": f for n, pieces in (("a", _pieces(a, b, True, pairs)), ("b", _pieces(b, a, False, pairs))) for p, f in pieces.items()}
    (pair, x, y), (inner, cx, cy) = _ends(a)
    place = _where(x, y, pair, b)
    flags |= {f"end_{p}": _any(pairs, pair[place == i]) for i, p in enumerate(("on", "in", "out"))}
    return flags | {"corner": _any(pairs, inner[_on_edge(cx, cy, inner, b)])}


def line_line(a: Edges, b: Edges, pairs: int) -> dict[str, np.ndarray]:
    flags = {}
    found = {"a": _ends(a), "b": _ends(b)}
    for n, m, own, other in (("a", "b", a, b), ("b", "a", b, a)):
        flags |= {f"{n}_{p}": f for p, f in _pieces(own, other, False, pairs).items()}
        ends, inner = found[n]
        at_end, on = _listed(ends, found[m][0], pairs), _on_edge(ends[1], ends[2], ends[0], other)
        for p, where in (("end", at_end), ("on", ~at_end & on), ("off", ~at_end & ~on)):
            flags[f"{n}_at_{p}"] = _any(pairs, ends[0][where])
        touch = _on_edge(inner[1], inner[2], inner[0], other) & ~_listed(inner, found[m][0], pairs)
        flags[f"{n}_touch"] = _any(pairs, inner[0][touch])
    return flags


#: The flags that each relation hands on.
FLAGS = {
    polygon_polygon: [f"{n}_{f}" for n in "ab" for f in ("on", "in", "out", "met", "inner_in", "inner_out", "corner")],
    line_polygon: ["a_on", "a_in", "a_out", "a_met", "b_out", "end_on", "end_in", "end_out", "corner"],
    line_line: ["a_cross", *[f"{n}_{f}" for n in "ab" for f in ("on", "out", "at_end", "at_on", "at_off", "touch")]],
}


def flagged(batches: Iterator[pa.RecordBatch], keys: list[str], relation) -> Iterator[pa.RecordBatch]:
    """Rows (keys, a, b) to (keys, flags). Pairs without a shape on a side, or without any edge, are left out."""
    for batch in batches:
        a, b = Edges(batch.column("a")), Edges(batch.column("b"))
        flags = relation(a, b, batch.num_rows)
        there = pc.and_(batch.column("a").is_valid(), batch.column("b").is_valid()).to_numpy(zero_copy_only=False)
        mask = pa.array(there & (flags["a_some"] | flags["b_some"]))
        yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *[pa.array(flags[f]) for f in FLAGS[relation]]], [*keys, *FLAGS[relation]]).filter(mask)
