"""Paths in a table of relations: (relation_id, child, parent, valid, kind)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonepack.sources.staging import stage, unstage

MOST_PATHS = 16
#: So many rows, or relations of their paths, are sent to all tasks, counted before; more are joined as Spark chooses.
SMALL = 1 << 18


def _to_all(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


def usable_edges(edges: DataFrame) -> DataFrame:
    """Without invalid and generated relations."""
    return edges.where(F.col("valid") & (F.col("kind") != "generated"))


def hops(edges: DataFrame) -> DataFrame:
    """(relation_id, start, end) both ways; a relation of a table to itself is one hop."""
    forth = edges.select("relation_id", F.col("child").alias("start"), F.col("parent").alias("end"))
    back = edges.where("child <> parent").select("relation_id", F.col("parent").alias("start"), F.col("child").alias("end"))
    return forth.unionByName(back)


def _levels(steps: DataFrame, start: DataFrame, extend) -> DataFrame:
    """Breadth first from ``start`` (node, hops, ...), one join a level, each level cut from its lineage, until
    a level is empty. ``extend(level joined with steps)`` groups what a level reaches by ``end``.

    ``steps`` lead both ways, as ``hops`` makes them, so a level reaches nothing but itself, the level
    before it and the next one: only the last two have to be left out. A small level is sent to the steps, so that
    none but those that lead on are shuffled.
    """
    level = found = stage(start, "level")
    before, rows, known_rows = level.limit(0), level.count(), 0
    while True:
        known, known_rows = level.select(F.col("node").alias("end")).unionByName(before.select(F.col("node").alias("end"))), known_rows + rows
        near = steps.join(_to_all(level, rows), level["node"] == steps["start"])
        if known_rows <= SMALL:
            reached = extend(near.join(F.broadcast(known), "end", "left_anti"))
        else:
            reached = extend(near).join(known, "end", "left_anti")
        before, level, known_rows = level, stage(reached.withColumnRenamed("end", "node").select(start.columns), "level"), rows
        rows = level.count()
        if not rows:
            return found
        found = found.unionByName(level)


def _source(steps: DataFrame, source, **more) -> DataFrame:
    node = F.lit(source).cast(steps.schema["start"].dataType)
    return steps.sparkSession.range(1).select(node.alias("node"), F.lit(0).alias("hops"), *[c.alias(n) for n, c in more.items()])


def shortest_paths(steps: DataFrame, source, targets: DataFrame | None = None) -> DataFrame:
    """(node, hops, paths): every node that ``source`` reaches, its distance and the number of shortest paths.

    Parallel relations make different paths; the source itself has one, of no hops. ``targets`` (node)
    restricts the result. The counts go along with the levels, and there is no bound on their number.
    """
    counted = stage(steps.groupBy("start", "end").agg(F.count("*").alias("n")), "steps")
    start = _source(steps, source, paths=F.lit(1).cast("long"))
    extend = lambda rows: rows.groupBy("end", (F.col("hops") + 1).alias("hops")).agg(F.sum(F.col("n") * F.col("paths")).alias("paths"))
    found = _levels(counted, start, extend)
    return found.join(targets, "node", "left_semi") if targets is not None else found


#: Between the relation ids of a path while it is text: below every other character, so texts are in the order of the lists.
BETWEEN = "\0"


def listed_paths(steps: DataFrame, source, most: int = MOST_PATHS) -> DataFrame:
    """(node, hops, paths): the shortest paths themselves, arrays of relation ids; of a node with more than
    ``most`` the first by text.

    Each level keeps ``most`` paths a node, in order. A node's paths begin with paths of its predecessors, nodes of the level before:

    - of parallel relations between two nodes the first ``most`` are enough,
    - of the predecessors the ``most`` whose first paths are the first,
    - of the r-th of them the first ``most`` + 1 - r paths, as each of those before it has a path that is less, and none that
      is behind the first path of the last of ``most`` predecessors, or behind the last of ``most`` paths of any of them.

    Relations are written once, in one direction (low, high), as ``steps`` lead both ways. Levels are found first, by the nodes alone. Then
    only relations that lead from a level to the next one are kept, each once: those that the source doesn't reach are not shuffled, nor is any
    for each level.
    """
    kept = stage(steps.where("start <= end").select("relation_id", F.col("start").alias("low"), F.col("end").alias("high")), "steps")
    both = kept.select(F.col("low").alias("start"), F.col("high").alias("end")).unionByName(kept.where("low <> high").select(F.col("high").alias("start"), F.col("low").alias("end")))
    nodes = _levels(both, _source(steps, source), lambda rows: rows.select("end", (F.col("hops") + 1).alias("hops")).distinct())
    sizes = {r.hops: r["count"] for r in nodes.groupBy("hops").count().collect()}  # a number a level, as levels are gone through one by one
    count = sum(sizes.values())
    ahead = kept
    for end in ("low", "high"):
        ahead = ahead.join(_to_all(nodes.select(F.col("node").alias(end), F.col("hops").alias(f"{end}_hops")), count), end)
    forth = F.col("low_hops") < F.col("high_hops")
    ends = [F.when(forth, F.col(a)).otherwise(F.col(b)).alias(n) for n, a, b in (("start", "low", "high"), ("end", "high", "low"))]
    ahead = stage(ahead.where("abs(low_hops - high_hops) = 1").select("relation_id", F.greatest("low_hops", "high_hops").alias("hops"), *ends), "ahead")
    unstage(kept)
    leading = {r.hops: r["count"] for r in ahead.groupBy("hops").count().collect()}

    level = found = stage(_source(steps, source, paths=F.array(F.lit(""))), "level")
    rows, of_end = 1, Window.partitionBy("end")
    for hops in range(1, len(sizes)):
        # where nodes have many predecessors, the last of ``most`` is bound enough
        full = F.when(F.size("paths") == most, F.element_at("paths", -1)) if leading[hops] < most * sizes[hops] else F.lit(None).cast("string")
        known = level.select(F.col("node").alias("start"), F.col("paths")[0].alias("best"), full.alias("full"))
        near = ahead.where(F.col("hops") == hops).drop("hops").join(_to_all(known, rows * hops), "start")
        near = near.withColumn("r", F.dense_rank().over(of_end.orderBy("best", "start"))).where(F.col("r") <= most)
        near = near.withColumn("i", F.row_number().over(Window.partitionBy("end", "best", "start").orderBy("relation_id"))).where(F.col("i") <= most)
        last = F.least(F.min("full").over(of_end), F.max(F.when(F.col("r") == most, F.col("best"))).over(of_end))
        near = near.withColumn("last", last).select("start", "end", "relation_id", "r", "last")
        begun = near.join(_to_all(level.select(F.col("node").alias("start"), "paths"), rows * hops * most), "start")
        fit = F.filter(F.slice("paths", F.lit(1), F.lit(most + 1) - F.col("r")), lambda p: F.col("last").isNull() | (p <= F.col("last")))
        begun = begun.select("end", "relation_id", F.explode(fit).alias("path"))
        path = F.concat("path", F.lit(BETWEEN), "relation_id") if hops > 1 else F.col("relation_id").cast("string")
        longer = begun.select("end", path.alias("path")).withColumn("k", F.row_number().over(of_end.orderBy("path"))).where(F.col("k") <= most)
        longer = longer.groupBy("end").agg(F.array_sort(F.collect_list("path")).alias("paths"))
        level = stage(longer.select(F.col("end").alias("node"), F.lit(hops).alias("hops"), "paths"), "level")
        rows, found = sizes[hops], found.unionByName(level)
    unstage(ahead)
    ids = F.when(F.col("hops") == 0, F.array(F.array()).cast("array<array<string>>")).otherwise(F.transform("paths", lambda p: F.split(p, BETWEEN)))
    return found.select("node", "hops", ids.alias("paths"))


def ambiguous(paths: DataFrame) -> DataFrame:
    """Nodes that more than one shortest path reaches, of ``listed_paths``, as ``r1 > r2; r3 > r4``."""
    text = F.array_join(F.transform("paths", lambda p: F.array_join(p, " > ")), "; ")
    return paths.where("size(paths) > 1").select("node", "hops", F.size("paths").alias("listed"), text.alias("paths"))


def pinned(edges: DataFrame, pins: DataFrame) -> DataFrame:
    """Check relation paths (pin_id, start, end, relation_ids): (pin_id, error, reached), error null if valid.

    The relations of a path are looked up by a join, then followed in order. Errors: the path is empty
    though the ends differ, names an unknown relation, breaks off, or ends elsewhere. A relation that ``edges`` repeat
    is one. ``pin_id`` has no ties; a path's first step carries its ends, so the paths are not joined again.
    """
    ends = F.struct("start", "end", (F.size("relation_ids") == 0).alias("empty")).alias("ends")
    at = pins.where("pin_id is not null").select("pin_id", ends, F.posexplode_outer("relation_ids").alias("pos", "relation_id"))
    at = at.withColumn("ends", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("ends"))).join(edges.select("relation_id", "child", "parent"), "relation_id", "left")
    step = F.struct("pos", F.col("relation_id").isNotNull().alias("given"), "child", "parent", "ends")
    rows = at.groupBy("pin_id").agg(F.array_sort(F.collect_set(step)).alias("steps")).withColumn("ends", F.col("steps")[0]["ends"])

    def follow(state, step):
        there = F.when(step["child"] == state["node"], step["parent"]).when(step["parent"] == state["node"], step["child"])
        error = F.when(state["error"].isNotNull(), state["error"]).when(~step["given"], F.lit(None)).when(step["child"].isNull(), F.lit("unknown relation")).when(there.isNull(), F.lit("does not connect"))
        return F.struct(F.coalesce(there, state["node"]).alias("node"), error.cast("string").alias("error"))

    rows = rows.withColumn("state", F.aggregate("steps", F.struct(F.col("ends.start").alias("node"), F.lit(None).cast("string").alias("error")), follow))
    error = (
        F.when(F.col("ends.empty") & (F.col("ends.start") != F.col("ends.end")), "path is empty")
        .when(F.col("state.error").isNotNull(), F.col("state.error"))
        .when(F.col("state.node") != F.col("ends.end"), "ends elsewhere")
    )
    return rows.select("pin_id", error.alias("error"), F.col("state.node").alias("reached"))


def remap(edges: DataFrame, included: DataFrame) -> DataFrame:
    """Relations with both ends among the ``included`` tables (node)."""
    return edges.join(included.select(F.col("node").alias("child")), "child", "left_semi").join(included.select(F.col("node").alias("parent")), "parent", "left_semi").select(edges.columns)


def path_lists(relations: Sequence[tuple[str, str, str]], start: str, end: str, most: int = MOST_PATHS) -> list[list[str]]:
    """All shortest relation-id paths between two tables of a catalog: planning over a handful of relations."""
    if start == end:
        return [[]]
    found, level, seen = [], [(start, [])], {start}
    while level and not found:
        below = []
        for node, path in level:
            for relation_id, child, parent in relations:
                for here, there in {(child, parent), (parent, child)}:
                    if here == node and there not in seen:
                        (found if there == end else below).append([*path, relation_id] if there == end else (there, [*path, relation_id]))
        seen |= {node for node, _ in below}
        level = below
    return sorted(found)[:most]
