"""Incremental packaging: slices of slow-changing tables kept per stratum between runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_drift(expected: DataFrame, present: DataFrame) -> DataFrame:
    """(stratum_id, table, drift): tables that a cache lacks or has too many; both sides (stratum_id, table)."""
    lacks = expected.exceptAll(present).withColumn("drift", F.lit("missing"))
    return lacks.unionByName(present.exceptAll(expected).withColumn("drift", F.lit("extra")))


def usable(strata: DataFrame, expected: Sequence[str], present: DataFrame) -> DataFrame:
    """(stratum_id, usable, reason) for caches that list their tables in ``present`` (stratum_id, table)."""
    held = present.groupBy("stratum_id").agg(F.array_sort(F.collect_set("table")).alias("held"))
    wanted = F.array(*[F.lit(t) for t in sorted(expected)])
    lacks, extra = F.array_except(wanted, F.col("held")), F.array_except(F.col("held"), wanted)
    reason = (
        F.when(F.col("held").isNull(), "missing")
        .when(F.size(lacks) > 0, F.concat(F.lit("lacks "), F.array_join(lacks, ", ")))
        .when(F.size(extra) > 0, F.concat(F.lit("holds other "), F.array_join(extra, ", ")))
    )
    rows = strata.select("stratum_id").join(held, "stratum_id", "left").withColumn("reason", reason)
    return rows.select("stratum_id", F.col("reason").isNull().alias("usable"), "reason")


def file_key(name):
    """The cache's file name of a stratum."""
    return F.when(name == "<full>", "__full__").otherwise(name)


def use(cache: DataFrame, cold: DataFrame, state: DataFrame) -> DataFrame:
    """Slices from the cache for strata with a usable one, computed for the others; ``status`` says which."""
    good = state.where("usable").select("stratum_id")
    warm = cache.join(good, "stratum_id", "left_semi").withColumn("status", F.lit("warm"))
    return warm.unionByName(cold.join(good, "stratum_id", "left_anti").withColumn("status", F.lit("cold-fallback")))


def fallbacks(state: DataFrame, layers: DataFrame) -> DataFrame:
    """(stratum_id, layer, status, reason) of warm-marked layers (layer, warm) in strata without a usable cache."""
    from zonepack.operators.reports import each

    rows = each(state.where("not usable"), layers.where("warm"))
    return rows.select("stratum_id", "layer", F.lit("cold-fallback").alias("status"), "reason")
