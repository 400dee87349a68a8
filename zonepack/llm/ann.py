"""Operator 8, approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree has two storeys. The upper one is fitted at the driver on about ``SAMPLE`` unit vectors (a bounded sample,
chosen by a hash of vec_id): each node splits its vectors into ``BRANCHES`` by k-means, until a node is small enough;
its leaves are cells, about as many as each cell has leaves. Every row goes to a cell, down the nearest centres. Then
each cell fits a lower tree of its own, in a task, on at most about ``SAMPLE`` of its rows, down to leaves of about
``LEAF_ROWS`` rows, and every row goes to a leaf. So the number of leaves grows with the rows and the size of a leaf
does not, up to about 8 billion rows (half the square of ``SAMPLE`` leaves); only the upper tree is broadcast.

A query takes cells, and in each of them leaves, from a priority queue of nodes, the nearest centre first; of all
leaves met the nearest are visited. How many cells and leaves is calibrated against brute force: for ``CALIBRATION``
queries the true neighbours among all rows are found in one pass, and the numbers are the least that reach ``RECALL``
of them. A query with fewer than k different ids in its leaves is asked again with twice the cells and four times the
leaves, until it has k or has seen all. Each (query, leaf) pair is one row; cells and leaves with many rows or many
queries are dealt to chunks on both sides, so a vector or an id that a third of all rows repeat makes no large group.
Scores are cosines in double precision on the original vectors; equal vectors get equal scores, since each pair is
summed in the same order. ``calibrated_recall`` is what the calibration queries reached.

No part is taken by rows with a null vec_id, and by vectors that are null, empty, zero, hold null or
non-finite numbers, or have not the most frequent length. Rows that repeat a vec_id are one candidate
(the nearest of them) and one query (the smallest vector); rows with the query's own id are never its
neighbours. Ties go to the smaller vec_id. Fewer than k candidates: all of them. Empty table: no rows.
Other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonepack.llm.shared import parallelism, sample_filter, stage
from zonepack.llm.word_ids import take_turn

SAMPLE = 8192
BRANCHES = 8
LEAF_ROWS = 512
ITERATIONS = 8
CALIBRATION = 64
RECALL = 0.97
CHUNK_ROWS = 2048
CHUNK_QUERIES = 4096
QUERY_STEP = 50
CELL = 1 << 20


def usable(vector: str = "embedding") -> Column:
    return F.expr(f"{vector} is not null and size({vector}) > 0 and forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists({vector}, x -> x <> 0)")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _split(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """k-means on unit vectors: centres and the centre of each vector."""
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ITERATIONS):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-300), centres)
    return centres, (x @ centres.T).argmax(axis=1)


class Tree:
    """``children[node]`` are its nodes and their centres, or None for a leaf, which has a number."""

    def __init__(self, x: np.ndarray, leaf_size: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.children: list[tuple[list[int], np.ndarray] | None] = [None]
        todo = [(0, x)]
        while todo:
            node, own = todo.pop()
            k = min(BRANCHES, -(-len(own) // leaf_size))
            if k < 2:
                continue
            centres, part = _split(own, k, rng)
            found = [p for p in range(k) if (part == p).any()]
            if len(found) < 2:
                continue
            first = len(self.children)
            self.children[node] = (list(range(first, first + len(found))), centres[found])
            self.children += [None] * len(found)
            todo += [(first + i, own[part == p]) for i, p in enumerate(found)]
        self.leaf = {node: i for i, node in enumerate(n for n, c in enumerate(self.children) if c is None)}

    def assign(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        level = [0]
        while level:
            below = []
            for node in level:
                if self.children[node] and len(own := np.flatnonzero(at == node)):
                    nodes, centres = self.children[node]
                    at[own] = np.array(nodes)[(x[own] @ centres.T).argmax(axis=1)]
                    below += nodes
            level = below
        return np.array([self.leaf[n] for n in at.tolist()], dtype=np.int64)

    def visit(self, q: np.ndarray) -> Iterator[tuple[float, int]]:
        """Leaves with how far their centres are (a lone one is at -1), best bin first."""
        queue = [(-1.0, 0)]
        while queue:
            far, node = heappop(queue)
            if self.children[node] is None:
                yield far, self.leaf[node]
                continue
            nodes, centres = self.children[node]
            for far, child in zip((-(centres @ q)).tolist(), nodes):
                heappush(queue, (far, child))


def _matrix(vectors) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in vectors])


def _nearest(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the positions in ``x`` and the scores of its k nearest ids, without rows of its own id."""
    size = np.sqrt((x * x).sum(axis=1))
    repeats = int(np.unique(ids, return_counts=True)[1].max(initial=1))
    most = k * repeats  # so many rows have k different ids
    for begin in range(0, len(queries), 256):
        block = queries[begin : begin + 256]
        rough = block @ x.T / size
        for i, q in enumerate(block):
            norm = np.sqrt((q * q).sum())
            near = rough[i]
            near[ids == query_ids[begin + i]] = -np.inf
            bound = np.partition(near, -most)[-most] if len(near) > most else -np.inf
            at = np.flatnonzero((near >= bound - 1e-9 * norm) & (near > -np.inf))
            score = (x[at] * q).sum(axis=1) / (size[at] * norm)
            best = np.lexsort((ids[at], -score))
            if repeats > 1:
                best = best[np.sort(np.unique(ids[at][best], return_index=True)[1])]
            best = best[:k]
            yield begin + i, at[best], score[best]


def _sizes(rows: DataFrame, key: str, most: int, name: str = "parts") -> DataFrame:
    """(key, parts): the number of chunks of at most about ``most`` rows for each key. A table like others, but written: Spark knows
    its size, and sends it to all tasks only while it is small."""
    return stage(rows.groupBy(key).agg(F.ceil(F.count("*") / most).cast("int").alias(name)), "parts")


def _every(parts: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))


def _one(parts: str, by: Column) -> Column:
    return F.pmod(by, F.col(parts)).cast("int")


class Index:
    """``rows``: (vec_id, embedding, salt, cell, leaf) of all vectors; ``trees``: (cell, tree)."""

    def __init__(self, rows: DataFrame, n: int):
        spark = rows.sparkSession
        # of rows that repeat an id one is sampled, else one id could fill the driver
        sample = [r.embedding for r in rows.where(sample_filter(n, SAMPLE, "vec_id")).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).select("embedding").orderBy("embedding").collect()]
        cells = max(1, min(SAMPLE // 2, round((n / LEAF_ROWS) ** 0.5)))
        self.upper = spark.sparkContext.broadcast(Tree(_unit(_matrix(sample)), max(2, len(sample) // cells)) if sample else None)

        def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            take_turn("vectors")
            for batch in batches:
                if batch.num_rows:
                    cell = self_upper.value.assign(_unit(_matrix(batch.column("embedding").to_numpy(zero_copy_only=False))))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

        self_upper = self.upper
        placed = rows.withColumn("salt", F.monotonically_increasing_id()).mapInArrow(to_cells, "vec_id long, embedding array<double>, salt long, cell long")
        placed = stage(placed, "cells")
        sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}

        def fit(sampled: pd.DataFrame) -> pd.DataFrame:
            cell = int(sampled["cell"].iloc[0])
            x = _matrix(sorted(map(tuple, sampled["embedding"])))
            return pd.DataFrame({"cell": [cell], "tree": [pickle.dumps(Tree(_unit(x), max(2, len(x) * LEAF_ROWS // sizes[cell])))]})

        rates = spark.createDataFrame([(cell, min(1 << 30, int((1 << 30) * SAMPLE / size))) for cell, size in sizes.items()], "cell long, rate long")
        sampled = placed.join(F.broadcast(rates), "cell").where(F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(1 << 30)) < F.col("rate"))
        sampled = sampled.groupBy("cell", "vec_id").agg(F.min("embedding").alias("embedding"))
        self.trees = stage(sampled.groupBy("cell").applyInPandas(fit, "cell long, tree binary"), "trees")
        fitted = {r["cell"] for r in self.trees.select("cell").collect()}
        alone = spark.createDataFrame([(cell, pickle.dumps(Tree(np.zeros((0, 1)), 2))) for cell in sizes if cell not in fitted], "cell long, tree binary")
        self.trees = self.trees.union(alone)  # a cell of which no id is in the sample is one leaf

        def to_leaves(own: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
            tree = pickle.loads(trees["tree"].iloc[0])
            own["leaf"] = own["cell"] * CELL + tree.assign(_unit(_matrix(own["embedding"])))
            return own[["vec_id", "embedding", "salt", "leaf"]]

        parts = _sizes(placed, "cell", CHUNK_ROWS)
        left = placed.join(parts, "cell").withColumn("part", _one("parts", F.xxhash64("salt"))).drop("parts")
        right = self.trees.join(parts, "cell").withColumn("part", _every("parts")).drop("parts")
        self.rows = stage(left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInPandas(to_leaves, "vec_id long, embedding array<double>, salt long, leaf long"), "leaves")
        self.sizes = stage(self.rows.groupBy("leaf").agg(F.count("*").alias("rows")), "sizes")
        self.cells, (self.leaf_count, self.row_count) = len(sizes), self.sizes.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()

    def leaves(self, queries: DataFrame, cells: int, leaves: int) -> DataFrame:
        """(query_id, query, leaf, place): the ``leaves`` nearest leaves of the ``cells`` nearest cells of each query."""
        upper = self.upper

        def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            take_turn("vectors")
            for batch in batches:
                chosen = [[cell for _, (_, cell) in zip(range(cells), upper.value.visit(q))] for q in _matrix(batch.column("embedding").to_numpy(zero_copy_only=False))]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(chosen, pa.list_(pa.int64()))], ["query_id", "query", "cells"])

        def to_leaves(asked: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
            if not len(asked) or not len(trees):
                return pd.DataFrame({"query_id": [], "query": [], "leaf": [], "far": []})
            cell, tree, out = int(trees["cell"].iloc[0]), pickle.loads(trees["tree"].iloc[0]), []
            for i, q in zip(asked["query_id"], asked["query"]):
                own = np.asarray(q, dtype=np.float64)
                out += [(i, q, cell * CELL + leaf, far) for _, (far, leaf) in zip(range(leaves), tree.visit(own / np.sqrt((own * own).sum())))]
            return pd.DataFrame(out, columns=["query_id", "query", "leaf", "far"])

        asked = stage(queries.mapInArrow(to_cells, "query_id long, query array<double>, cells array<long>"), "visits").select("query_id", "query", F.explode("cells").alias("cell"))
        parts = _sizes(asked, "cell", CHUNK_QUERIES)
        left = asked.join(parts, "cell").withColumn("part", _one("parts", F.xxhash64("query_id"))).drop("parts")
        right = self.trees.join(parts, "cell").withColumn("part", _every("parts")).drop("parts")
        met = left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInPandas(to_leaves, "query_id long, query array<double>, leaf long, far double")
        nearest = Window.partitionBy("query_id").orderBy("far", "leaf")
        return met.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= leaves).drop("far")

    def search(self, queries: DataFrame, k: int, cells: int, leaves: int) -> DataFrame:
        """(query_id, rank, vec_id, score) from the leaves that each query visits."""
        asked = stage(self.leaves(queries, cells, leaves).drop("place"), "asked")
        chunk = max(64, min(CHUNK_ROWS, self.row_count // (4 * parallelism(queries.sparkSession))))
        # leaves that some query visits: rows of the others go nowhere
        visited = self.sizes.select("leaf", F.ceil(F.col("rows") / chunk).cast("int").alias("row_parts")).join(_sizes(asked, "leaf", CHUNK_QUERIES, "query_parts"), "leaf")
        visited = stage(visited, "visited")
        left = asked.join(visited, "leaf").withColumn("row_part", _every("row_parts")).withColumn("part", _one("query_parts", F.xxhash64("query_id")))
        right = self.rows.join(visited, "leaf").withColumn("row_part", _one("row_parts", F.xxhash64("salt"))).withColumn("part", _every("query_parts"))
        left, right = left.drop("row_parts", "query_parts"), right.select("vec_id", "embedding", "salt", "leaf", "row_part", "part")

        def nearest(asked: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
            if not len(asked) or not len(found):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
            ids, query_ids = found["vec_id"].to_numpy(), asked["query_id"].to_numpy()
            out = [(np.full(len(at), query_ids[i]), ids[at], score) for i, at, score in _nearest(_matrix(asked["query"]), query_ids, _matrix(found["embedding"]), ids, k)]
            return pd.DataFrame({c: np.concatenate(v) for c, v in zip(("query_id", "vec_id", "score"), zip(*out))})

        keys = ("leaf", "row_part", "part")
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(nearest, "query_id long, vec_id long, score double")
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, k: int = 5, step: int = QUERY_STEP, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score, calibrated_recall): the k nearest found of every row whose vec_id is divisible by ``step``."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & usable())
    lengths = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double, calibrated_recall double")
    index = Index(rows.where(F.size("embedding") == lengths[0]["d"]), lengths[0]["count"])
    queries = stage(index.rows.where(F.col("vec_id") % step == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    cells, leaves, reached = _calibrated(queries, index, queries.count(), k, recall)
    found = stage(index.search(queries, k, cells, leaves), "found")
    candidates = index.rows.agg(F.count_distinct("vec_id")).first()[0] - 1  # the query's own id is no candidate
    while cells < index.cells or leaves < index.leaf_count:
        full = found.groupBy("query_id").count().where(F.col("count") >= min(k, candidates)).select(F.col("query_id").alias("vec_id"))
        short = stage(queries.join(full, "vec_id", "left_anti"), "short")
        if short.isEmpty():
            break
        cells, leaves = min(index.cells, 2 * cells), min(index.leaf_count, 4 * leaves)
        again = stage(index.search(short, k, cells, leaves), "found")
        found = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    return found.withColumn("calibrated_recall", F.lit(reached))


def _calibrated(queries: DataFrame, index: Index, n_queries: int, k: int, recall: float) -> tuple[int, int, float]:
    """The least numbers of cells and leaves that hold ``recall`` of the true neighbours of some queries, and that share."""
    some = queries.where(sample_filter(n_queries, CALIBRATION, "vec_id", F.lit(1))).orderBy("vec_id").limit(2 * CALIBRATION)
    chosen = some.collect()
    if not chosen:
        return 1, 1, 1.0
    query_ids, matrix = np.array([r.vec_id for r in chosen]), _matrix([r.embedding for r in chosen])
    shared = queries.sparkSession.sparkContext.broadcast((query_ids, matrix))

    def true_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("vectors")
        ids, x = shared.value
        for batch in batches:
            if batch.num_rows:
                own, leaf = batch.column("vec_id").to_numpy(), batch.column("leaf").to_numpy()
                out = [(np.full(len(at), ids[i]), own[at], leaf[at], score) for i, at, score in _nearest(x, ids, _matrix(batch.column("embedding").to_numpy(zero_copy_only=False)), own, k)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", "vec_id", "leaf", "score"])

    found = index.rows.mapInArrow(true_neighbours, "query_id long, vec_id long, leaf long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max_by("leaf", "score").alias("leaf"), F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    true = stage(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "leaf"), "true")
    order = {int(i): {cell: turn for turn, (_, cell) in enumerate(index.upper.value.visit(q))} for i, q in zip(query_ids, matrix)}
    rows = true.collect()  # k rows a calibration query
    if not rows:
        return 1, 1, 1.0
    turns = sorted(order[r.query_id][r.leaf // CELL] for r in rows)
    cells = turns[int(np.ceil((1 + recall) / 2 * len(turns))) - 1] + 1
    places = index.leaves(some, cells, index.leaf_count).select("query_id", "leaf", "place")
    ranks = sorted(r.place for r in true.join(places, ["query_id", "leaf"]).collect())
    leaves = ranks[min(len(ranks), int(np.ceil(recall * len(rows)))) - 1]
    return cells, leaves, sum(r <= leaves for r in ranks) / len(rows)


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
