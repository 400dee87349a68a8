"""Run report, bundle report, orphan rows: joins of counts, plans and failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonepack.operators.strata import UNMATCHED

RUN = ["stratum", "layer", "feature_count", "status", "detail"]
BUNDLE = [
    "stratum", "layer_name", "gpkg_table", "path_in_zip", "layer_type", "geometry_type", "feature_count", "field_count",
    "excluded_fields", "matching_method", "match_detail", "source_crs", "status", "detail",
]


def each(strata: DataFrame, layers: DataFrame) -> DataFrame:
    """Every stratum with every layer; the layers, tens of rows, go along as one array."""
    listed = layers.agg(F.collect_list(F.struct(*layers.columns)).alias("layers"))
    return strata.join(listed, how="cross").withColumn("l", F.explode("layers")).select(*strata.columns, "l.*")


def outcome_fallback(members: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(stratum, layer, feature_count, status) of every member (layer, primary) of a shared table: its own
    outcome (stratum, layer, ...) or else its primary's."""
    primary = outcomes.select("stratum", F.col("layer").alias("primary"), F.col("feature_count").alias("p_count"), F.col("status").alias("p_status"))
    rows = members.join(primary, "primary").join(outcomes, ["stratum", "layer"], "left")
    return rows.select("stratum", "layer", F.coalesce("feature_count", "p_count").alias("feature_count"), F.coalesce("status", "p_status").alias("status"))


def run_rows(strata: DataFrame, layers: DataFrame, outcomes: DataFrame, failed: DataFrame, fallbacks: DataFrame) -> DataFrame:
    """The run report of strata (stratum) and layers (layer, warm). A failed stratum (stratum, reason) comes
    first, then a cold fallback (stratum, reason) of a warm layer, then the outcome's own status; without
    an outcome the table was empty and left out."""
    rows = each(strata.select("stratum"), layers).join(outcomes, ["stratum", "layer"], "left")
    rows = rows.join(failed.select("stratum", F.col("reason").alias("failure")), "stratum", "left").join(fallbacks.select("stratum", F.col("reason").alias("fallback")), "stratum", "left")
    is_failed, cold = F.col("failure").isNotNull(), F.col("fallback").isNotNull() & F.col("warm") & F.col("status").isNotNull()
    return rows.select(
        "stratum", "layer",
        F.when(~is_failed, F.coalesce("feature_count", F.lit(0))).alias("feature_count"),
        F.when(is_failed, "failed").when(cold, "cold-fallback").otherwise(F.coalesce("status", F.lit("empty-skipped"))).alias("status"),
        F.when(is_failed, F.col("failure")).when(cold, F.col("fallback")).otherwise("").alias("detail"),
    )


def orphan_row(layer: DataFrame, layer_name: str, orphans: DataFrame) -> DataFrame:
    """The ``<unmatched>`` row of a layer, if it has orphans."""
    found = orphans.agg(F.count("*").alias("feature_count")).where("feature_count > 0")
    return found.select(F.lit(UNMATCHED).alias("stratum"), F.lit(layer_name).alias("layer"), "feature_count", F.lit("ok").alias("status"), F.lit("").alias("detail"))


def bundle_rows(strata: DataFrame, tables: DataFrame, outcomes: DataFrame, payloads: DataFrame | None = None, embedded: DataFrame | None = None) -> DataFrame:
    """The 14 columns of a bundle's report: packaged tables, file payloads, layers that are only embedded.

    ``tables``: layer, geometry_type, fields, excluded, matching_method, relation_ids, predicates, crs.
    """
    rows = each(strata.select("stratum", "package_rel"), tables).join(outcomes, ["stratum", "layer"], "left")
    found = F.col("feature_count").isNotNull()
    by_key = F.col("matching_method") == "attribute"
    out = rows.select(
        "stratum", F.col("layer").alias("layer_name"), F.when(found, F.col("layer")).otherwise("").alias("gpkg_table"),
        F.when(found, F.concat("package_rel", F.lit(".gpkg"))).otherwise("").alias("path_in_zip"), F.lit("vector").alias("layer_type"), "geometry_type",
        "feature_count", (F.size("fields") - F.size("excluded")).alias("field_count"), F.array_join("excluded", ";").alias("excluded_fields"), "matching_method",
        F.when(by_key, F.array_join("relation_ids", " > ")).otherwise(F.array_join("predicates", ", ")).alias("match_detail"),
        F.col("crs").alias("source_crs"), F.coalesce("status", F.lit("ok")).alias("status"), F.lit("").alias("detail"),
    )
    blank = {c: F.lit("") for c in BUNDLE} | {"feature_count": F.lit(None).cast("long"), "field_count": F.lit(None).cast("int"), "status": F.lit("ok")}

    def rest(more: DataFrame, **columns) -> DataFrame:
        rows = each(strata.select("stratum"), more)
        return rows.select(*[(F.col("stratum") if c == "stratum" else columns.get(c, blank[c])).alias(c) for c in BUNDLE])

    if payloads is not None:
        out = out.unionByName(rest(payloads, layer_name=F.col("layer"), path_in_zip=F.col("path"), layer_type=F.col("kind"), matching_method=F.lit("whole_export"), source_crs=F.col("crs")))
    if embedded is not None:
        out = out.unionByName(rest(embedded, layer_name=F.col("layer"), layer_type=F.col("kind"), source_crs=F.col("crs"), status=F.lit("project-only")))
    return out.select(BUNDLE)


def dry_run(strata: DataFrame, layers: DataFrame, counts: DataFrame) -> DataFrame:
    """Nothing is matched: counts (layer, rows) are known for whole exports only."""
    rows = each(strata.select("stratum"), layers).join(counts, "layer", "left")
    return rows.select("stratum", "layer", F.when(F.col("method") == "whole_export", F.col("rows")).alias("feature_count"), F.lit("dry-run").alias("status"), F.lit("").alias("detail"))


def summary(published: DataFrame, failed: DataFrame) -> DataFrame:
    """One row: sorted JSON array of published paths, their number, sorted failed names. Paths are one a bundle."""
    done = published.agg(F.to_json(F.array_sort(F.collect_set("path"))).alias("paths"), F.count_distinct("path").alias("bundles"))
    return done.join(failed.agg(F.array_join(F.array_sort(F.collect_set("stratum")), ",").alias("failed")), how="cross")


def bundle_status(members: DataFrame) -> DataFrame:
    """(bundle_rel, shipped, failed, status) of members (bundle_rel, ok): a bundle ships its good members."""
    shipped = F.count_if("ok")
    out = members.groupBy("bundle_rel").agg(shipped.alias("shipped"), F.count_if(~F.col("ok")).alias("failed"))
    return out.withColumn("status", F.when(F.col("shipped") > 0, "ok").otherwise("failed"))


def slowest(timings: DataFrame, group: str, step: str, seconds: str, most: int = 3) -> DataFrame:
    """Per group: the sum, and the ``most`` slowest steps, worst first (ties: the later name first). Ranks are
    cut to ``most`` in each task before they meet."""
    steps = timings.groupBy(group, step).agg(F.sum(seconds).alias(seconds))
    worst = Window.partitionBy(group).orderBy(F.desc(seconds), F.desc(step))
    top = steps.withColumn("place", F.row_number().over(worst)).where(F.col("place") <= most)
    named = F.transform(F.array_sort(F.collect_list(F.struct("place", step))), lambda t: t[step])
    listed = top.groupBy(group).agg(F.array_join(named, ", ").alias("slowest"))
    return timings.groupBy(group).agg(F.sum(seconds).alias("total")).join(listed, group)
