"""Connected components of an edge table, by stars: all joins and groups, nothing at the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonepack.llm.shared import Scratch

CHUNK = 1 << 18


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node but the smallest of its component under the edges (a, b), with the smallest one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
        x, y = root(x), root(y)
        parent[max(x, y)] = min(x, y)
    roots = np.array([root(i) for i in range(len(nodes))], dtype=np.int64)
    own = roots != np.arange(len(nodes))
    return nodes[own], nodes[roots[own]]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges with the same components: in chunks of at most ``CHUNK``, paths become stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in (b.slice(i, CHUNK) for b in batches for i in range(0, b.num_rows, CHUNK)):
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            n += batch.num_rows
            if n >= CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in spanning(*map(np.concatenate, zip(*held)))], ["a", "b"])
                held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in spanning(*map(np.concatenate, zip(*held)))], ["a", "b"])

    return edges.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): label is the smallest node of its component.

    Large-star and small-star steps in turn, each followed by a write to the shared folder, until
    every edge leads to the smallest node; that takes about the logarithm of the longest path, less what
    paths are contracted before each write. Edges that fit into one chunk need no more steps. What a step has read
    is deleted; the last edges stay for the result.
    """
    scratch = Scratch(edges.sparkSession)
    edges = scratch.stage(contracted(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()), "edges")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] <= CHUNK:  # one chunk holds all: its stars are the components
            edges = scratch.stage(contracted(edges.coalesce(1)), "edges")
            scratch.clear(keep=1)
            break
        if state == before:
            break
        before = state
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = scratch.stage(contracted(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), "edges")
        scratch.clear(keep=1)
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
