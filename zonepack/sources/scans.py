"""Reading layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "csv", "json", "jdbc", "text")


class UnreadableLayer(ValueError):
    """A layer without fields, or in no known format: reported, never read as an empty table."""


def scan(spark: SparkSession, path: str, provider: str = "parquet", subset: str | None = None, schema: str | None = None, **options: str) -> DataFrame:
    """A layer with its persistent row filter, which is applied before anything else."""
    if provider not in FORMATS:
        raise UnreadableLayer(f"unknown provider {provider}")
    reader = spark.read.format(provider).options(**options)
    df = (reader.schema(schema) if schema else reader).load(path)
    if not df.schema.fields:
        raise UnreadableLayer(f"{path} has no fields")
    return df.where(F.expr(subset)) if subset else df


def pruned(df: DataFrame, *wanted: Sequence[str]) -> DataFrame:
    """Only the fields that some chain compares or collects, in schema order; all rows."""
    names = {n for w in wanted for n in w}
    return df.select([c for c in df.columns if c in names])


GEOJSON = "type string, properties map<string,string>, geometry struct<type:string,coordinates:string>"


def scan_geojson_lines(spark: SparkSession, path: str, properties: Sequence[str]) -> DataFrame:
    """(properties..., kind, parts): one GeoJSON feature a line. ``parts`` is an array of parts, each an array of rings or
    lists of corners (x, y): a point one corner, a line one list, a polygon its outer ring and holes; the Multi kinds have
    a part for each member. A ring's last corner repeats its first.

    Features without a geometry, and those of other kinds, have null parts; no row is lost. Heights are dropped.
    """
    rows = spark.read.schema(GEOJSON).json(path)
    kind, text = F.col("geometry.type"), F.col("geometry.coordinates")
    listed = lambda depth: F.from_json(text, "array<" * depth + "double" + ">" * depth)
    shape = (
        F.when(kind == "Point", F.array(F.array(F.array(listed(1)))))
        .when(kind == "LineString", F.array(F.array(listed(2))))
        .when(kind == "MultiPoint", F.transform(listed(2), lambda p: F.array(F.array(p))))
        .when(kind == "MultiLineString", F.transform(listed(3), lambda line: F.array(line)))
        .when(kind == "Polygon", F.array(listed(3)))
        .when(kind == "MultiPolygon", listed(4))
    )
    corner = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    parts = F.transform(shape, lambda part: F.transform(part, lambda ring: F.transform(ring, corner)))
    return rows.select(*[F.col("properties")[p].alias(p) for p in properties], kind.alias("kind"), parts.alias("parts"))


def payload_inventory(spark: SparkSession, root: str, prefix: str) -> DataFrame:
    """(arcname, length) of every file below ``root``, named by its path inside the package and sorted by it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.concat(F.lit(f"{prefix}/"), relative(F.col("path"), root)).alias("arcname"), "length").orderBy("arcname")


def payload_members(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """(arcname, length) of a payload: a folder whole, under its name; or a file with its sidecars, the files beside
    it that begin with its name up to the ending (terrain.tif: terrain.tfw, terrain.tif.aux.xml)."""
    folder, _, name = path.rstrip("/").rpartition("/")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return payload_inventory(spark, path, f"{prefix}/{name}")
    stem = name.rpartition(".")[0] or name
    files = spark.read.format("binaryFile").load(folder)
    beside = F.substring_index("path", "/", -1)
    return files.where((beside == name) | beside.startswith(f"{stem}.")).select(F.concat(F.lit(f"{prefix}/"), beside).alias("arcname"), "length").orderBy("arcname")


def relative(path: Column, root: str) -> Column:
    """What follows ``root`` in a file's path, whatever scheme stands before."""
    root = root.split("://", 1)[-1].removeprefix("file:").rstrip("/")
    return F.element_at(F.split(path, r"\Q" + root + r"/\E", 2), -1)
