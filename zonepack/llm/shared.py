"""Helpers that the training-data operators share: staging, input columns, row slices."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


MOST_IDS = 250_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent (tests on one machine) the context's own checkpoint folder is
    used, and one below the warehouse is set if there is none.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    found = spark.sparkContext.getCheckpointDir()
    if not found:
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staging"
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


_scopes: list[list[str]] = []


def stage_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in _scopes[-1:]:
        paths.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def staged_until_end(spark: SparkSession) -> Iterator[None]:
    """Whatever is staged inside is deleted at the end: what was made of it has been written by then."""
    _scopes.append(paths := [])
    try:
        yield
    finally:
        _scopes.remove(paths)
        for path in paths:
            delete(spark, path)


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, a lost executor costs nothing."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that one run stages for itself."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []
        self.found: dict[int, tuple[DataFrame, str]] = {}  # the frames too: an id is theirs as long as they live

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(stage_path(self.spark, name))
        df.write.parquet(self.paths[-1])
        read = self.spark.read.schema(df.schema).parquet(self.paths[-1])
        self.found[id(read)] = read, self.paths[-1]
        return read

    def drop(self, *tables: DataFrame) -> None:
        """Delete staged tables that nothing reads any more."""
        for df in tables:
            path = self.found.pop(id(df))[1]
            self.paths.remove(path)
            delete(self.spark, path)

    def clear(self, keep: int = 0) -> None:
        """Delete what was staged, except for the last ``keep`` tables; nothing may read them any more."""
        gone = self.paths[: len(self.paths) - keep]
        self.paths = self.paths[len(gone) :]
        for path in gone:
            delete(self.spark, path)


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` as long and ``text`` as string, and ``more`` columns; whatever else the table has is left out."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *(F.col(c) for c in more))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True where crc32(doc_id as text) mod 5 is 0; a null id is held out, so it is never learned from."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def sample_filter(rows: int, bound: int, *key: str | Column) -> Column:
    """A condition that keeps about ``bound`` of ``rows`` rows, the same ones on each run; all if they fit."""
    if rows <= bound:
        return F.lit(True)
    return F.pmod(F.xxhash64(*key), F.lit(1 << 30)) < F.lit(int((1 << 30) * bound / rows))


def to_all(staged: DataFrame) -> DataFrame:
    """A staged table of ids for a join: it goes to all tasks while it has at most ``MOST_IDS`` rows, so that sets and
    texts stay where they are; beyond that both sides are shuffled, and Spark splits skewed keys."""
    return F.broadcast(staged) if staged.count() <= MOST_IDS else staged


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not among ``ids`` (doc_id)."""
    return docs.join(to_all(stage(ids.distinct(), "ids")), "doc_id", "left_anti").select(docs.columns)


def cuts(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Row slices of about ``most`` bytes of text, one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            done = int(ends[begin - 1]) if begin else 0
            end = max(begin, int(np.searchsorted(ends, done + most))) + 1
            yield batch.slice(begin, end - begin)
            begin = end


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 1 << 18) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Row slices with their texts, a null text empty: only a slice's texts are held as Python strings."""
    for rows in cuts(batches, text, most):
        yield rows, ["" if t is None else t for t in rows.column(text).to_pylist()]


def groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The rows of each key in turn, from a partition that is sorted by the keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist()] if batch.num_rows else []
        for begin, end in zip(starts, [*starts[1:], batch.num_rows]):
            key = tuple(c[begin] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held)


def dealt_by(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a key in one partition and side by side."""
    return df.repartition(parallelism(df.sparkSession), *keys).sortWithinPartitions(*keys)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
