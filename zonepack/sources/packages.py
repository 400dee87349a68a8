"""Writing packages: one partitioned write a table for all strata, published by switching a pointer.

A run's folder holds its tables. What is common to all packages is written once below ``_shared``; the
manifest lists it for every stratum. Compression level 0 stores, 1 to 9 is zstd.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonepack.sources.scans import relative

POINTER = "CURRENT"
MODES = ("overwrite", "error", "skip-existing")
#: Bytes of a file that is read as one value, and of a piece of a larger one.
WHOLE_FILE, CHUNK = 256 << 20, 8 << 20


def kept_fields(layer: DataFrame, excluded: Sequence[str]) -> list[str]:
    """Fields in schema order without the excluded; unknown names are ignored, leaving none is an error."""
    kept = [c for c in layer.columns if c not in excluded]
    if not kept:
        raise ValueError("all fields are excluded")
    return kept


def sliced(membership: DataFrame, layer: DataFrame, fid: Sequence[str], excluded: Sequence[str] = ()) -> DataFrame:
    """(stratum_id, fields...) of the rows of each stratum; ``excluded`` fields go after the match."""
    return membership.join(layer, list(fid)).select("stratum_id", *kept_fields(layer, excluded))


def staged_union(layer: DataFrame, membership: DataFrame, fid: Sequence[str], everything: bool = False) -> DataFrame:
    """The rows that some stratum uses, each once, whatever the number of strata; all rows when the full
    package needs them."""
    return layer if everything else layer.join(membership.select(*fid).distinct(), list(fid), "left_semi")


def with_full(slices: DataFrame, layer: DataFrame) -> DataFrame:
    """``slices`` and, as the pseudo-stratum ``<full>``, every row of the layer. Its key is null, which no stratum's is."""
    return slices.unionByName(layer.select(F.lit(None).cast(slices.schema["stratum_id"].dataType).alias("stratum_id"), *[c for c in slices.columns if c != "stratum_id"]))


def compression(level: int) -> dict[str, str]:
    if not 0 <= level <= 9:
        raise ValueError("compression level must be 0 to 9")
    return {"compression": "zstd", "parquet.compression.codec.zstd.level": str(level)} if level else {"compression": "uncompressed"}


#: Row groups of indexed tables are this small, so that a look-up reads little beside what it wants.
INDEXED_GROUP = 16 << 20


def index_options(columns: Sequence[str]) -> dict[str, str]:
    """Bloom filters on ``columns``, as large as their values need, in small row groups."""
    if not columns:
        return {}
    return {"parquet.block.size": str(INDEXED_GROUP), "parquet.bloom.filter.adaptive.enabled": "true"} | {f"parquet.bloom.filter.enabled#{c}": "true" for c in columns}


def write_partitioned(slices: DataFrame, path: str, level: int = 1, mode: str = "errorifexists", indexed: Sequence[str] = ()) -> None:
    """One folder a stratum. Rows of a stratum are brought together, large ones over several tasks
    (REBALANCE splits them), so there are few files and no task holds a whole hot stratum.

    ``indexed`` columns get Bloom filters; by the first of them the rows of a file are sorted, so that row groups and pages hold
    ranges of it."""
    rows = slices.hint("rebalance", "stratum_id")
    if indexed:
        rows = rows.sortWithinPartitions("stratum_id", indexed[0])
    rows.write.mode(mode).options(**compression(level), **index_options(indexed)).partitionBy("stratum_id").parquet(path)


def write_whole(rows: DataFrame, path: str, level: int = 1, indexed: Sequence[str] = ()) -> None:
    """A table that all strata share. With ``indexed`` columns it is dealt by ranges of the first one; a value that many rows
    have is spread by a hash of the row."""
    if indexed:
        spread = F.xxhash64(*[c for c in rows.columns if rows.schema[c].dataType.typeName() not in ("map", "variant")])
        rows = rows.withColumn("_spread", spread).repartitionByRange(indexed[0], "_spread").sortWithinPartitions(indexed[0]).drop("_spread")
    rows.write.options(**compression(level), **index_options(indexed)).parquet(path)


def clustered(staged: DataFrame, keys: Sequence[str], partitions: int) -> DataFrame:
    """Rows near others of their key, so that row-group statistics serve look-ups by key."""
    return staged.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys)


def shared_manifest(strata: DataFrame, table: str, path: str, rows: DataFrame) -> DataFrame:
    """(stratum_id, table, path, rows): the shared copy, listed for every stratum."""
    count = rows.agg(F.count("*").alias("rows"))
    return strata.select("stratum_id").join(F.broadcast(count), how="cross").select("stratum_id", F.lit(table).alias("table"), F.lit(path).alias("path"), "rows")


def empty_policy(counts: DataFrame, keep_empty: bool) -> DataFrame:
    """(stratum_id, feature_count, status) for a layer's counts over all strata."""
    return counts.withColumn("status", F.when(F.col("feature_count") > 0, "ok").otherwise("empty-kept" if keep_empty else "empty-skipped"))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm.org.apache.hadoop.fs.Path


def exists(spark: SparkSession, path: str) -> bool:
    fs, at, _ = _fs(spark, path)
    return fs.exists(at)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below ``path``; none if it isn't there."""
    fs, at, _ = _fs(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at) if f.isDirectory()) if fs.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, at, _ = _fs(spark, path)
    fs.delete(at, True)


def current(spark: SparkSession, final: str) -> str | None:
    """The folder that ``final`` points to; None before the first publication."""
    if not exists(spark, f"{final}/{POINTER}"):
        return None
    return f"{final}/{spark.read.text(f'{final}/{POINTER}').first()[0]}"


def point(spark: SparkSession, final: str, name: str) -> None:
    """Let ``final`` point to its folder ``name``: a small file is written aside and renamed over the old pointer."""
    fs, aside, path = _fs(spark, f"{final}/_{POINTER}-{uuid.uuid4().hex}")
    with_text = fs.create(aside, True)
    with_text.write(bytearray(name.encode()))
    with_text.close()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    rename = getattr(hadoop, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    target = path(f"{final}/{POINTER}")
    hadoop.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(aside), fs.makeQualified(target), options)


def publish(spark: SparkSession, built: str, final: str) -> str:
    """Make a complete folder the current one of ``final``; returns where it is now.

    It becomes a new version beside the old one, then the pointer is switched. Readers see one or the
    other, a crash in between leaves the old one. The version before stays for its readers; those before that go.
    """
    fs, source, path = _fs(spark, built)
    name = f"version-{uuid.uuid4().hex}"
    before = current(spark, final)
    fs.mkdirs(path(final))
    if not fs.rename(source, path(f"{final}/{name}")):
        raise OSError(f"cannot publish {final}")
    point(spark, final, name)
    for old in folders(spark, final):
        if old.startswith("version-") and old != name and f"{final}/{old}" != before:
            delete(spark, f"{final}/{old}")
    return f"{final}/{name}"


def apply_mode(strata: DataFrame, existing: DataFrame, mode: str) -> DataFrame:
    """Strata to build: all, or those of bundles that don't exist; under ``error`` existing ones are refused."""
    if mode not in MODES:
        raise ValueError(f"unknown overwrite mode {mode}")
    if mode == "overwrite":
        return strata
    if mode == "error":
        found = [r[0] for r in strata.join(existing, "bundle_rel", "left_semi").select("bundle_rel").distinct().orderBy("bundle_rel").limit(20).collect()]
        if found:
            raise FileExistsError(", ".join(found))
        return strata
    return strata.join(existing, "bundle_rel", "left_anti")


def skipped_rows(strata: DataFrame, existing: DataFrame, layers: DataFrame) -> DataFrame:
    """A report row for each stratum of an existing bundle and each layer (tens of rows, one array)."""
    listed = layers.agg(F.collect_list("layer").alias("layers"))
    rows = strata.join(existing, "bundle_rel", "left_semi").join(listed, how="cross")
    return rows.select(F.col("name").alias("stratum"), F.explode("layers").alias("layer"), F.lit("skipped-existing").alias("status"), F.concat("bundle_rel", F.lit(" exists")).alias("detail"))


def checksums(spark: SparkSession, root: str, whole: int = WHOLE_FILE) -> DataFrame:
    """(name, line) for every file below ``root``: the line of a sha256sum file. Files up to ``whole`` bytes are read as
    one value, larger ones in chunks where they lie (a task for each, as Spark doesn't put such files together). Empty files
    give no line: Spark's listing leaves them out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    digests = files.where(F.col("length") <= whole).select("path", F.sha2("content", 256).alias("digest"))
    digests = digests.union(files.where(F.col("length") > whole).select("path").mapInPandas(_digests, "path string, digest string"))
    return digests.select(relative(F.col("path"), root).alias("name"), F.concat("digest", F.lit("  "), F.substring_index("path", "/", -1), F.lit("\n")).alias("line"))


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each file's SHA-256, from a stream; a file that can't be opened fails the task."""
    for batch in batches:
        digests = []
        for path in batch["path"]:
            digest = hashlib.sha256()
            with _opened(path) as stream:
                while chunk := stream.read(CHUNK):
                    digest.update(chunk)
            digests.append(digest.hexdigest())
        yield batch.assign(digest=digests)


def _opened(path: str) -> pa.NativeFile:
    """A stream of the file at a path as Spark names it: the scheme ``file`` with one slash, ``s3a`` for ``s3``, nothing
    quoted."""
    scheme, colon, rest = path.partition(":/")
    if not colon or scheme == "file":
        return fs.LocalFileSystem().open_input_stream(f"/{rest.lstrip('/')}" if colon else path)
    system, inner = fs.FileSystem.from_uri(f"{scheme.replace('s3a', 's3')}:/{quote(rest)}")
    return system.open_input_stream(inner)


def extra_conflicts(entries: DataFrame, reserved: DataFrame) -> DataFrame:
    """Entries (arcname) of the extra folder whose first part is a reserved or taken name, ignoring case."""
    first = F.lower(F.substring_index("arcname", "/", 1))
    return entries.join(reserved.select(F.lower("name").alias("taken")).distinct(), first == F.col("taken"), "left_semi")


def layer_documents(strata: DataFrame, members: DataFrame) -> DataFrame:
    """(stratum_id, table, name, kind, body, is_default): styles of each member of a shared table (the
    primary's is the default) and one metadata document a table; bodies are opaque strings."""
    listed = members.agg(F.collect_list(F.struct("table", "name", "kind", "body", "is_primary")).alias("documents"))
    rows = strata.select("stratum_id").join(listed, how="cross").withColumn("d", F.explode("documents"))
    return rows.select("stratum_id", "d.table", "d.name", "d.kind", "d.body", ((F.col("d.kind") == "style") & F.col("d.is_primary")).alias("is_default"))


