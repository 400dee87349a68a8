"""Writing intermediate tables to the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from zonepack.sources.packages import delete


def work_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; below the warehouse where it is unset (tests on one machine)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (found or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staging").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again: its lineage ends here, and a lost executor loses none of it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.staged_at = path
    return found


def unstage(staged: DataFrame) -> None:
    """Delete a staged table that nothing reads any more, so that it doesn't stay beside what was made of it."""
    delete(staged.sparkSession, staged.staged_at)
