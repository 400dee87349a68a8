"""A package run: strata, one membership a layer, one write a table, bundles published, a report.

A run goes into its own version below the output folder. Its manifest has a row for each stratum and
table: where the rows are (``run``, the version's folder, and ``shared`` if all strata share the copy) and how
many. Bundles of earlier versions that a run does not replace stay listed with the run that wrote them. Readers
follow the pointer to the current manifest (``read_manifest``, ``read_table``).
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from functools import cached_property, reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from zonepack.functions import geometry as G
from zonepack.functions import text as T
from zonepack.operators import membership as M
from zonepack.operators import reports, spatial, warm
from zonepack.operators import strata as S
from zonepack.plans.catalog import BOX, Catalog, Layer, Plan, PlanError
from zonepack.sources import packages as P
from zonepack.sources.staging import new_path, stage

#: Parts into which a group of strata is split when its write fails, and writes after which no group is split any more.
SPLIT, MOST_TRIES = 8, 256
S_BOX = tuple(f"s_{c}" for c in BOX)


class RunFailed(RuntimeError):
    """Some strata or layers failed; the others are published. ``report`` says which."""

    def __init__(self, message: str, report: DataFrame):
        super().__init__(message)
        self.report = report


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def read_manifest(spark: SparkSession, out_dir: str) -> DataFrame | None:
    """(stratum_id, name, package_rel, bundle_rel, table, shared, feature_count, status, run) of what is published."""
    version = P.current(spark, out_dir)
    return spark.read.parquet(f"{version}/_manifest") if version else None


def read_table(spark: SparkSession, out_dir: str, table: str) -> DataFrame:
    """(fields..., stratum_id) of a table in all published packages.

    Each stratum gets the rows of the run that the manifest names for it, of a shared table that run's copy, so what
    a later run has shared does not reach packages that it left as they were. Fields that a run didn't write are null.
    """
    manifest = read_manifest(spark, out_dir).where((F.col("table") == table) & (F.col("name") != S.FULL))
    runs = manifest.select("run", "shared").distinct().orderBy("run").collect()  # one for each version that is still used
    found = []
    for run in (r.run for r in runs if not r.shared):
        own = manifest.where((F.col("run") == run) & ~F.col("shared")).select("stratum_id").distinct()
        fields = [f for f in spark.read.parquet(f"{out_dir}/{run}/{table}").schema if f.name != "stratum_id"]
        schema = StructType([*fields, manifest.schema["stratum_id"]])  # folder names alone would be read as numbers where they can
        found.append(spark.read.schema(schema).parquet(f"{out_dir}/{run}/{table}").join(own, "stratum_id", "left_semi").select(schema.names))
    if copies := [f"{out_dir}/{r.run}/_shared/{table}" for r in runs if r.shared]:
        rows = spark.read.option("mergeSchema", "true").parquet(*copies)
        run = F.regexp_extract("_metadata.file_path", "/([^/]+)/_shared/", 1)
        listed = manifest.where("shared").select(F.col("run").alias("_run"), "stratum_id")
        found.append(rows.select("*", run.alias("_run")).join(listed, "_run").drop("_run"))
    if not found:
        raise PlanError(f"no package has a table {table}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def read_copies(spark: SparkSession, out_dir: str, table: str) -> DataFrame:
    """(fields..., run) of a shared table: each copy once, whatever the number of strata that share it."""
    manifest = read_manifest(spark, out_dir).where((F.col("table") == table) & F.col("shared"))
    runs = [r.run for r in manifest.select("run").distinct().orderBy("run").collect()]
    rows = spark.read.option("mergeSchema", "true").parquet(*[f"{out_dir}/{r}/_shared/{table}" for r in runs])
    return rows.select("*", F.regexp_extract("_metadata.file_path", "/([^/]+)/_shared/", 1).alias("run"))


class Packager:
    """``Packager(spark, catalog, stratification="region", name_expr="r_name").package(path)``.

    ``display_expr`` names each layer in each stratum; a stratum for which it gives null fails. ``queries`` are texts that
    readers run over the package: tables are written with indexes on the columns that these compare.
    """

    def __init__(
        self, spark: SparkSession, catalog: Catalog, stratification: str, layers: list[str] | None = None, selection: DataFrame | None = None,
        name_expr: str | None = None, package_expr: str | None = None, bundle_expr: str | None = None, display_expr: str | None = None,
        keep_empty: bool = False, overwrite_mode: str = "error", compression_level: int = 1, full_package: bool = False,
        full_path: str = "full", dry_run: bool = False, warm_dir: str | None = None, warm_mode: str = "off",
        queries: Mapping[str, str] | None = None,
    ):
        if warm_mode not in ("off", "use", "update"):
            raise PlanError(f"unknown warm mode {warm_mode}")
        if overwrite_mode not in P.MODES:
            raise PlanError(f"unknown overwrite mode {overwrite_mode}")
        self.spark, self.catalog, self.stratification = spark, catalog, stratification
        self.layer_ids = layers or [i for i in catalog.eligible() if i != stratification]
        self.selection, self.name_expr, self.package_expr, self.bundle_expr, self.display_expr = selection, name_expr, package_expr, bundle_expr, display_expr
        self.keep_empty, self.overwrite_mode, self.level, self.full, self.full_path, self.is_dry = keep_empty, overwrite_mode, compression_level, full_package, full_path, dry_run
        self.warm_dir, self.warm_mode, self.queries = warm_dir, warm_mode, queries or {}
        if warm_mode != "off" and not (warm_dir and any(catalog.layers[i].warm for i in self.layer_ids)):
            raise PlanError("a warm start needs a folder and a warm-marked layer")
        self.memo = M.PrefixMemo()
        self._staged: list[str] = []

    def _stage(self, df: DataFrame, name: str) -> DataFrame:
        """Like ``stage``, until the run has ended."""
        self._staged.append(new_path(self.spark, name))
        df.write.parquet(self._staged[-1])
        return self.spark.read.schema(df.schema).parquet(self._staged[-1])

    @cached_property
    def plans(self) -> list[Plan]:
        return self.catalog.plan(self.stratification, self.layer_ids)

    @cached_property
    def strata(self) -> DataFrame:
        layer = self.catalog.layers[self.stratification]
        rows = S.snapshot(layer.rows, layer.fid[0], layer.source.columns, selection=self.selection)
        return S.with_paths(S.named(rows, self.name_expr), self.package_expr, self.bundle_expr)

    @cached_property
    def operands(self) -> dict[str, int]:
        """Names that the delivered queries compare by ``=``, with the number of queries that do."""
        if not self.queries:
            return {}
        texts = self.spark.createDataFrame(list(self.queries.items()), "name string, text string")
        return {r.operand: r["count"] for r in texts.select(F.explode(T.equality_operands(F.col("text"))).alias("operand")).groupBy("operand").count().collect()}

    def indexed(self, layer_id: str) -> list[str]:
        """Fields of a layer's table to index, the one that most queries compare first. Whatever else the queries compare
        (literals, aliases, other tables' fields) is no field of it and drops out."""
        layer = self.catalog.layers[layer_id]
        kept = P.kept_fields(layer.rows, layer.excluded_fields)
        return sorted((c for c in kept if c in self.operands), key=lambda c: (-self.operands[c], kept.index(c)))

    def check(self) -> None:
        """Refuse a run without strata, null and duplicate names, bad paths and colliding packages; at most a few
        rows are fetched."""
        if self.strata.isEmpty():
            raise PlanError("no strata are selected" if self.selection is not None else "there are no strata")
        rows = self.strata.select("stratum_id", "raw_name", "name", "package_rel", "bundle_rel", "path_error")
        if self.full:
            full = self.spark.createDataFrame([(S.FULL, S.FULL, self.full_path)], "raw_name string, name string, package_rel string")
            whole = S.with_paths(full, "package_rel").withColumn("stratum_id", F.lit(None).cast(rows.schema["stratum_id"].dataType))
            rows = rows.unionByName(whole.select(rows.columns))
        bad = rows.where("raw_name is null or path_error is not null").select("stratum_id", "path_error").limit(20).collect()
        names = S.collisions(rows, "name").limit(20).collect() + S.duplicate_names(rows, "raw_name").limit(20).collect()
        paths = S.bundle_collisions(rows).limit(20).collect()
        if bad or names or paths:
            raise PlanError(f"strata cannot be packaged: {[*map(str, (*bad, *names, *paths))]}")

    def plan(self, layer_id: str) -> Plan:
        return next(p for p in self.plans if p.layer.id == layer_id)

    def membership(self, layer_id: str) -> DataFrame:
        """(stratum_id, fid columns) of a layer, for all strata."""
        plan = self.plan(layer_id)
        layer, fid = plan.layer, plan.layer.fid
        if plan.method == "whole_export":
            return M.match_all(self.strata, layer.rows, fid)
        if plan.method == "attribute":
            if not plan.relation_ids:
                return M.match_self(self.strata, layer.rows, fid[0])
            chain = self.catalog.chain(layer_id, self.stratification, plan.relation_ids)
            return self.memo.match(self.strata, chain, tuple(reversed(plan.relation_ids)), fid)
        return self._spatial(plan)

    def _spatial(self, plan: Plan) -> DataFrame:
        """Candidates by boxes, then the exact relation by geometry class; strata go to the layer's coordinate system."""
        layer, whole = plan.layer, self.catalog.layers[self.stratification]
        moved = layer.srid is not None and whole.srid is not None and layer.srid != whole.srid
        corners = [F.col(c) for c in BOX]
        shape = [F.col(whole.shape).alias("s_shape")] if whole.shape else []
        if moved:
            (x0, y0), (x1, y1) = (G.reproject(*corners[i : i + 2], whole.srid, layer.srid) for i in (0, 2))
            corners = [x0, y0, x1, y1]  # both directions keep the order of coordinates on each axis
            shape = [G.reproject_edges(F.col(whole.shape), whole.srid, layer.srid).alias("s_shape")] if whole.shape else []
        strata = self.strata.select("stratum_id", *[c.alias(n) for c, n in zip(corners, S_BOX)], *shape)
        features = layer.rows.select(*[F.col(c).alias(f"f_{c}") for c in layer.fid], *BOX, *([F.col(layer.shape).alias("f_shape")] if layer.shape else []))
        pairs = spatial.bbox_join(features, BOX, strata, S_BOX)
        keys = ["stratum_id", *[f"f_{c}" for c in layer.fid]]
        related = spatial.exact(pairs, keys, layer.geometry, whole.geometry, BOX, S_BOX, layer.shape and "f_shape", whole.shape and "s_shape")
        fits = G.any_of(plan.predicates, F.col("matrix"), F.col("dim_a"), F.col("dim_b"))
        return related.where(fits).select("stratum_id", *[F.col(f"f_{c}").alias(c) for c in layer.fid]).distinct()

    def _partitioned(self, layer_id: str) -> DataFrame:
        """(stratum_id, fields...): along relations the fields come with the last hop, without a second join."""
        plan = self.plan(layer_id)
        layer = plan.layer
        if plan.method == "attribute" and plan.relation_ids:
            chain = self.catalog.chain(layer_id, self.stratification, plan.relation_ids)
            found = self.memo.match(self.strata, chain, tuple(reversed(plan.relation_ids)), P.kept_fields(layer.rows, layer.excluded_fields))
        else:
            found = P.sliced(self.membership(layer_id), layer.rows, layer.fid, layer.excluded_fields)
        return self._computed(layer, found)

    @staticmethod
    def _computed(layer: Layer, rows: DataFrame) -> DataFrame:
        return rows.withColumns({name: F.expr(e) for name, e in layer.computed.items()}) if layer.computed else rows

    def slices(self, layer_id: str) -> DataFrame:
        found, layer = self._partitioned(layer_id), self.plan(layer_id).layer
        return P.with_full(found, self._computed(layer, layer.rows)) if self.full else found

    def counts(self, layer_id: str) -> DataFrame:
        return P.empty_policy(M.counts(self.strata, self.membership(layer_id)), self.keep_empty)

    def report(self) -> DataFrame:
        """Run rows of every stratum and layer without writing, then the ``<unmatched>`` rows of partitioned layers."""
        names = self.strata.select("stratum_id", F.col("name").alias("stratum"))
        rows = []
        for plan in self.plans:
            layer = plan.layer
            if self.is_dry:
                count = layer.rows.agg(F.count("*").alias("feature_count")) if plan.method == "whole_export" else self.spark.range(1).select(F.lit(None).cast("long").alias("feature_count"))
                rows.append(names.join(F.broadcast(count), how="cross").select("stratum", F.lit(layer.id).alias("layer"), "feature_count", F.lit("dry-run").alias("status"), F.lit("").alias("detail")))
                continue
            if plan.method == "whole_export":
                rows.append(self._named(names, layer.id, self._whole(layer.rows)))
                continue
            member = stage(self.membership(layer.id), "membership")
            rows.append(self._named(names, layer.id, P.empty_policy(M.counts(self.strata, member), self.keep_empty)))
            rows.append(reports.orphan_row(layer.rows, layer.id, M.orphans(layer.rows, member, layer.fid)))
        return union(rows)

    def _whole(self, rows: DataFrame) -> DataFrame:
        """Outcome of a whole export: each stratum has all rows."""
        count = rows.agg(F.count("*").alias("feature_count"))
        return P.empty_policy(self.strata.select("stratum_id").join(F.broadcast(count), how="cross"), self.keep_empty)

    @staticmethod
    def _named(names: DataFrame, layer_id: str, outcome: DataFrame) -> DataFrame:
        detail = F.col("detail") if "detail" in outcome.columns else F.lit("")
        return names.join(outcome, "stratum_id").select("stratum", F.lit(layer_id).alias("layer"), "feature_count", "status", detail.alias("detail"))

    def _failed(self) -> DataFrame:
        """(stratum_id, reason) of strata with a layer that ``display_expr`` gives no name."""
        layers = self.spark.createDataFrame([(p.layer.id, p.layer.layer_name or p.layer.id) for p in self.plans], "layer_id string, layer_name string")
        named = S.display_names(self.strata, layers, self.display_expr).where("failed")
        return named.groupBy("stratum_id").agg(F.concat(F.lit("no display name for "), F.min("layer_id")).alias("reason"))

    def package(self, out_dir: str, fail_at_end: bool = True) -> DataFrame:
        """Write and publish; returns the report. Each table is one write for all strata.

        A stratum fails by itself where a row of it cannot be written, or without a display name: its package is not published, the
        others are. A layer that can be written for no stratum, or is shared by all, fails all of them. At the end the
        run fails with ``RunFailed``, unless ``fail_at_end`` is False.
        """
        try:
            return self._package(out_dir, fail_at_end)
        finally:
            for path in self._staged:
                P.delete(self.spark, path)
            self._staged.clear()
            self.memo.clear()
            self.__dict__.pop("strata", None)  # it may read what is deleted; made anew when it is asked for

    def _package(self, out_dir: str, fail_at_end: bool) -> DataFrame:
        self.check()
        self.broken: dict[Any, tuple[str, str]] = {}
        if self.is_dry:
            return self.report()
        spark, built = self.spark, f"{out_dir}/_staging/{uuid.uuid4().hex}"
        everyone = self.strata = self._stage(self.strata, "strata")
        listed = spark.createDataFrame([(p.layer.id,) for p in self.plans], "layer string")
        before, rows = read_manifest(spark, out_dir), []
        if before is not None:
            existing = before.select("bundle_rel").distinct()
            self.strata = self._stage(P.apply_mode(everyone, existing, self.overwrite_mode).select(everyone.columns), "strata")
            if self.overwrite_mode == "skip-existing":
                rows.append(P.skipped_rows(everyone, existing, listed).withColumn("feature_count", F.lit(None).cast("long")))
        full = self.full and (before is None or self.overwrite_mode != "skip-existing" or before.where(F.col("bundle_rel") == self._full_bundle()).isEmpty())
        if full and before is not None and self.overwrite_mode == "error" and not before.where(F.col("bundle_rel") == self._full_bundle()).isEmpty():
            raise FileExistsError(self._full_bundle())
        failures: dict[str, str] = {}
        if self.display_expr:
            lost = self._stage(self._failed(), "failed")
            gone = self.strata.join(lost, "stratum_id").select(F.col("name").alias("stratum"), "reason")
            rows.append(reports.each(gone, listed).select("stratum", "layer", F.lit(None).cast("long").alias("feature_count"), F.lit("failed").alias("status"), F.col("reason").alias("detail")))
            if not lost.isEmpty():
                failures["strata"] = ", ".join(r[0] for r in gone.select("stratum").orderBy("stratum").limit(20).collect())
            self.strata = self._stage(self.strata.join(lost, "stratum_id", "left_anti"), "strata")
        cache = self._cache(everyone)
        names = self.strata.select("stratum_id", F.col("name").alias("stratum"))
        manifest = []
        for plan in self.plans:
            layer = plan.layer
            try:
                outcome, orphans = self._write(plan, built, cache)
                if full:
                    outcome_full = self._write_full(plan, built)
            except Exception as e:  # noqa: BLE001 a layer's failure is contained, the run fails at the end
                failures[layer.id] = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
                continue
            rows.append(self._named(names, layer.id, outcome))
            manifest.append(self._listed(outcome, layer.id, plan.method == "whole_export"))
            if orphans is not None:
                rows.append(reports.orphan_row(layer.rows, layer.id, orphans))
            if full:
                rows.append(outcome_full.select(F.lit(S.FULL).alias("stratum"), F.lit(layer.id).alias("layer"), "feature_count", "status", F.lit("").alias("detail")))
                manifest.append(outcome_full.select(F.lit(None).cast(self.strata.schema["stratum_id"].dataType).alias("stratum_id"), F.lit(S.FULL).alias("name"), F.lit(self.full_path).alias("package_rel"), F.lit(self._full_bundle()).alias("bundle_rel"), F.lit(layer.id).alias("table"), F.lit(plan.method == "whole_export").alias("shared"), "feature_count", "status"))
        if self.broken:  # strata of which some table could not be written: their packages stay out
            lost = spark.createDataFrame([(i, n, why) for i, (n, why) in self.broken.items()], StructType([self.strata.schema["stratum_id"], *(StructType.fromDDL("stratum string, reason string"))]))
            failures["strata"] = ", ".join(filter(None, [failures.get("strata"), *sorted(n for n, _ in self.broken.values())[:20]]))
            manifest = [m.join(lost.select("stratum_id"), "stratum_id", "left_anti").select(m.columns) for m in manifest]
            rows = [r.join(lost.select("stratum"), "stratum", "left_anti").select(r.columns) for r in rows]
            rows.append(reports.each(lost.select("stratum", "reason"), listed).select("stratum", "layer", F.lit(None).cast("long").alias("feature_count"), F.lit("failed").alias("status"), F.col("reason").alias("detail")))
        broken = {i: why for i, why in failures.items() if i != "strata"}
        if broken:  # every stratum lacks the layer
            why = "; ".join(f"{i}: {w}" for i, w in broken.items())
            report = reports.each(everyone.select(F.col("name").alias("stratum")), listed).select("stratum", "layer", F.lit(None).cast("long").alias("feature_count"), F.lit("failed").alias("status"), F.lit(why).alias("detail"))
            P.delete(spark, built)
            report.write.mode("overwrite").parquet(f"{out_dir}/_failed")
            return self._ended(spark.read.schema(report.schema).parquet(f"{out_dir}/_failed"), failures, fail_at_end)
        self._publish(out_dir, built, union(manifest), before, union(rows))
        return self._ended(spark.read.parquet(f"{P.current(spark, out_dir)}/_report"), failures, fail_at_end)

    @staticmethod
    def _ended(report: DataFrame, failures: dict[str, str], fail_at_end: bool) -> DataFrame:
        if failures and fail_at_end:
            raise RunFailed("; ".join(f"{i}: {why}" for i, why in failures.items()), report)
        return report

    def _full_bundle(self) -> str:
        return self.full_path.rsplit("/", 1)[-1]

    def _listed(self, outcome: DataFrame, layer_id: str, shared: bool) -> DataFrame:
        return self.strata.select("stratum_id", "name", "package_rel", "bundle_rel").join(outcome.select("stratum_id", "feature_count", "status"), "stratum_id").withColumns({"table": F.lit(layer_id), "shared": F.lit(shared)})

    def _write(self, plan: Plan, built: str, cache: Cache | None) -> tuple[DataFrame, DataFrame | None]:
        """Write a table; (stratum_id, feature_count, status, detail) of all strata, and the rows in none of them."""
        layer = plan.layer
        if plan.method == "whole_export":
            path = f"{built}/_shared/{layer.id}"
            P.write_whole(self._computed(layer, layer.rows.drop(*layer.excluded_fields)), path, self.level, self.indexed(layer.id))
            return self._whole(self.spark.read.parquet(path)), None
        slices, status = self._partitioned(layer.id), None
        if cache and layer.warm:
            slices = cache.use(layer.id, slices)
            status = F.when(F.col("usable"), F.lit("warm")).otherwise(F.lit("cold-fallback"))
        self._write_slices(layer.id, slices, f"{built}/{layer.id}")
        written = self.spark.read.schema(slices.schema).parquet(f"{built}/{layer.id}")
        outcome = P.empty_policy(M.counts(self.strata, written), self.keep_empty).withColumn("detail", F.lit(""))
        if status is not None:
            outcome = outcome.drop("detail").join(cache.state, "stratum_id")
            outcome = outcome.withColumn("status", F.when(F.col("usable") & (F.col("feature_count") == 0), F.col("status")).otherwise(status)).select("stratum_id", "feature_count", "status", F.coalesce("reason", F.lit("")).alias("detail"))
        if cache and layer.warm and self.warm_mode == "use":
            return outcome, None  # rows of the cache may be older than the layer
        member = written.select("stratum_id", *layer.fid) if set(layer.fid) <= set(written.columns) else self.membership(layer.id)
        return outcome, M.orphans(layer.rows, member, layer.fid)

    def _write_slices(self, layer_id: str, slices: DataFrame, path: str) -> None:
        """Write a table for all strata at once. If that fails, groups of strata are written one by one, and those that fail are
        split on, until the strata that fail stand alone: they go to ``broken``, the rest of the table is written.

        A group is an equal share of the strata by a hash, so that many strata take few rounds. After ``MOST_TRIES`` writes the
        groups that are left fail as they are. A failed write leaves no rows: its files are not committed.
        """
        indexed = self.indexed(layer_id)
        try:
            return P.write_partitioned(slices, path, self.level, indexed=indexed)
        except Exception as e:  # noqa: BLE001 what the rows of one stratum do must not fail the others
            whole = e
        strata = self.strata.select("stratum_id", "name")
        count = strata.count()
        if count < 2:
            raise whole
        P.delete(self.spark, path)
        P.write_partitioned(slices.limit(0), path, self.level)
        groups, tries, good = [(strata, count, 0, whole)], 0, 0
        lost: dict[Any, tuple[str, str]] = {}
        while groups:
            group, count, depth, error = groups.pop(0)
            reason = f"{layer_id}: {str(error).splitlines()[0][:300] if str(error) else type(error).__name__}"
            if count == 1 or tries >= MOST_TRIES:
                lost |= {r.stratum_id: (r.name, reason) for r in group.collect()}
                continue
            for share in range(min(SPLIT, count)):
                part = group.where(F.pmod(F.xxhash64("stratum_id", F.lit(depth)), F.lit(min(SPLIT, count))) == share)
                if not (size := part.count()):
                    continue
                tries += 1
                try:
                    P.write_partitioned(slices.join(part.select("stratum_id"), "stratum_id", "left_semi").select(slices.columns), path, self.level, "append", indexed)
                    good += 1
                except Exception as e:  # noqa: BLE001
                    groups.append((part, size, depth + 1, e))
        if not good:
            raise whole
        self.broken |= lost

    def _write_full(self, plan: Plan, built: str) -> DataFrame:
        """One row (feature_count, status): the whole table, for the pseudo-stratum ``<full>``."""
        layer = plan.layer
        path = f"{built}/_shared/{layer.id}" if plan.method == "whole_export" else f"{built}/_full/{layer.id}"
        if plan.method != "whole_export":
            P.write_whole(self._computed(layer, layer.rows.select(P.kept_fields(layer.rows, layer.excluded_fields))), path, self.level, self.indexed(layer.id))
        return P.empty_policy(self.spark.read.parquet(path).agg(F.count("*").alias("feature_count")), self.keep_empty)

    def _cache(self, everyone: DataFrame) -> Cache | None:
        """The warm cache; brought up to date first, for all strata, if the mode is update."""
        if self.warm_mode == "off":
            return None
        tables = [p.layer.id for p in self.plans if p.layer.warm and p.method != "whole_export"]
        if self.warm_mode == "update":
            built, built_for = f"{self.warm_dir}/_staging-{uuid.uuid4().hex}", self.strata
            self.strata, self.memo = everyone, M.PrefixMemo()
            for table in tables:
                P.write_partitioned(self._partitioned(table), f"{built}/{table}", self.level)
            reports.each(everyone.select("stratum_id"), self.spark.createDataFrame([(t,) for t in tables], "table string")).write.parquet(f"{built}/_tables")
            P.publish(self.spark, built, self.warm_dir)
            self.strata, self.memo = built_for, M.PrefixMemo()
        return Cache(self, tables)

    def _publish(self, out_dir: str, built: str, manifest: DataFrame, before: DataFrame | None, report: DataFrame) -> None:
        run = f"version-{uuid.uuid4().hex}"
        manifest = self._stage(manifest, "manifest")
        whole = manifest.withColumn("run", F.lit(run))
        if before is not None:  # bundles that this run does not replace
            whole = whole.unionByName(before.join(manifest.select("bundle_rel").distinct(), "bundle_rel", "left_anti").select(whole.columns))
        whole.write.parquet(f"{built}/_manifest")
        report.write.parquet(f"{built}/_report")
        fs, source, path = P._fs(self.spark, built)
        last = P.current(self.spark, out_dir)
        if not fs.rename(source, path(f"{out_dir}/{run}")):
            raise OSError(f"cannot publish {out_dir}")
        P.point(self.spark, out_dir, run)
        # what neither this manifest nor the one before it names
        named = {r[0] for m in (whole, *([before] if before is not None else [])) for r in m.select("run").distinct().collect()}
        for old in P.folders(self.spark, out_dir):
            if old.startswith("version-") and old not in named | {run} and f"{out_dir}/{old}" != last:
                P.delete(self.spark, f"{out_dir}/{old}")


class Cache:
    """Slices of warm tables from an earlier run. A stratum uses its cache if that holds exactly the warm tables;
    the others are computed."""

    def __init__(self, packager: Packager, tables: list[str]):
        spark, warm_dir = packager.spark, packager.warm_dir
        self.packager, self.root = packager, P.current(spark, warm_dir) or warm_dir
        kind = packager.strata.schema["stratum_id"].dataType
        held = [f for f in P.folders(spark, self.root) if not f.startswith(("_", "version-"))]
        parts = [spark.read.schema(f"stratum_id {kind.simpleString()}").parquet(f"{self.root}/{t}").select("stratum_id", F.lit(t).alias("table")).distinct() for t in held]
        if P.exists(spark, f"{self.root}/_tables"):  # it lists empty tables too
            parts.append(spark.read.parquet(f"{self.root}/_tables").select(F.col("stratum_id").cast(kind).alias("stratum_id"), "table"))
        nothing = spark.createDataFrame([], "stratum_id string, table string").withColumn("stratum_id", F.col("stratum_id").cast(kind))
        self.state = packager._stage(warm.usable(packager.strata, tables, union([nothing, *parts]).distinct()), "cache-state")
        self.cold = not self.state.where("not usable").isEmpty()
        self.held = held

    def use(self, table: str, cold: DataFrame) -> DataFrame:
        good = self.state.where("usable").select("stratum_id")
        rest = cold.join(good, "stratum_id", "left_anti") if self.cold else cold.limit(0)
        if table not in self.held:
            return rest
        kept = self.packager.spark.read.schema(cold.schema).parquet(f"{self.root}/{table}").select(cold.columns)
        return kept.join(good, "stratum_id", "left_semi").unionByName(rest)
