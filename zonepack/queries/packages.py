"""Writing, publishing, warm starts and reports; what is written is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonepack.functions.geometry import ring_edges, shape_box
from zonepack.operators import reports, strata, warm
from zonepack.plans.catalog import Catalog
from zonepack.plans.packager import Packager, read_manifest, read_table
from zonepack.queries.matching import TO_ORDERS, packager, regions
from zonepack.queries.registry import Tables, query
from zonepack.sources import packages as P
from zonepack.sources import scans
from zonepack.sources.staging import new_path, stage

CUSTOMERS = "SELECT c_nationkey AS stratum_id, count(*) AS rows, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer GROUP BY 1"


def _sums(slices: DataFrame, key: str) -> DataFrame:
    return slices.groupBy("stratum_id").agg(F.count("*").alias("rows"), F.sum(key).cast("long").alias("keys"))


def _written(t: Tables, slices: DataFrame, name: str) -> tuple[str, DataFrame]:
    path = new_path(t.spark, name)
    P.write_partitioned(slices, path)
    return path, t.spark.read.schema(slices.schema).parquet(path)


def _customers(t: Tables) -> DataFrame:
    return packager(t, "nation", "n_name", layers=["customer"]).slices("customer")


@query(CUSTOMERS)
def write_partitioned(t: Tables) -> DataFrame:
    return _sums(_written(t, _customers(t), "package")[1], "c_custkey")


@query("SELECT r_regionkey AS stratum_id, 'supplier' AS \"table\", (SELECT count(*) FROM supplier) AS rows FROM region")
def shared_template(t: Tables) -> DataFrame:
    path = new_path(t.spark, "shared")
    t.supplier.write.parquet(path)
    return P.shared_manifest(regions(t), "supplier", path, t.spark.read.parquet(path)).drop("path")


@query("SELECT DISTINCT p.* FROM part p JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey < 5")
def stage_union(t: Tables) -> DataFrame:
    p = packager(t, layers=["part"], flags={"nation": {"subset": "n_nationkey < 5"}})
    return stage(P.staged_union(t.part, p.membership("part"), ["p_partkey"]), "union")


@query("SELECT p_partkey, p_name FROM part")
def stage_full(t: Tables) -> DataFrame:
    p = packager(t, layers=["part"])
    return P.staged_union(t.part, p.membership("part"), ["p_partkey"], everything=True).select("p_partkey", "p_name")


@query(f"SELECT r_regionkey AS stratum_id, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM {TO_ORDERS} WHERE n_nationkey < 20 GROUP BY 1 UNION ALL SELECT NULL, count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders")
def full_package(t: Tables) -> DataFrame:
    return _sums(packager(t, layers=["orders"], full_package=True, flags={"nation": {"subset": "n_nationkey < 20"}}).slices("orders"), "o_orderkey")


@query("SELECT c_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY 1")
def cluster_staged(t: Tables) -> DataFrame:
    """A staged copy clustered by its key, looked up by the keys of some customers."""
    staged = stage(P.clustered(t.orders, ["o_custkey"], 8), "clustered")
    wanted = t.customer.where("c_acctbal > 0").select("c_custkey")
    return staged.join(wanted, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


_CUSTOMER_ORDERS = "SELECT c_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7 GROUP BY c_custkey"


@query(f"SELECT n_regionkey AS stratum_id, q.* FROM ({_CUSTOMER_ORDERS}) q JOIN customer USING (c_custkey) JOIN nation ON c_nationkey = n_nationkey")
def indexed_lookup(t: Tables) -> DataFrame:
    """A package is written with indexes for a query, which then runs over its tables."""
    out = new_path(t.spark, "out")
    packager(t, layers=["customer", "orders"], queries={"orders by customer": _CUSTOMER_ORDERS}).package(out)
    of = read_table(t.spark, out, "customer").where("c_nationkey = 7").select("stratum_id", "c_custkey")
    found = read_table(t.spark, out, "orders").join(of.withColumnRenamed("c_custkey", "o_custkey"), ["stratum_id", "o_custkey"])
    return found.groupBy("stratum_id", F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT n_nationkey AS stratum_id, count(c_custkey) AS feature_count, CASE WHEN count(c_custkey) > 0 THEN 'ok' ELSE 'empty-skipped' END AS status FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 9900) ON c_nationkey = n_nationkey GROUP BY 1")
def empty_policy(t: Tables) -> DataFrame:
    return packager(t, "nation", "n_name", layers=["customer"], flags={"customer": {"subset": "c_acctbal > 9900"}}).counts("customer")


@query("SELECT r_name AS stratum, 'orders' AS layer, count(*) AS feature_count, 'ok' AS status, '' AS detail FROM " + TO_ORDERS + " GROUP BY 1")
def publish(t: Tables) -> DataFrame:
    """A whole run: written, published by rename, its report read back."""
    return packager(t, layers=["orders"]).package(new_path(t.spark, "out"))


@query("SELECT c_mktsegment AS stratum, layer, 'skipped-existing' AS status, c_mktsegment || ' exists' AS detail FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment < 'C'), (SELECT unnest(['orders', 'events']) AS layer)")
def overwrite_skip(t: Tables) -> DataFrame:
    found = t.customer.groupBy("c_mktsegment").agg(F.min("c_custkey").alias("stratum_id"))
    rows = strata.with_paths(strata.named(found, "c_mktsegment"))
    existing = rows.where("name < 'C'").select("bundle_rel")
    layers = t.spark.createDataFrame([("orders",), ("events",)], "layer string")
    return P.skipped_rows(rows, existing, layers)


def _names_by_nation(t: Tables, name: str) -> str:
    """Customers' names as text files, one for each nation and 100,000 keys, in order of the keys."""
    path = new_path(t.spark, name)
    rows = t.customer.select("c_nationkey", F.floor(F.col("c_custkey") / 100_000).alias("part"), "c_custkey", "c_name")
    rows = rows.repartition("c_nationkey", "part").sortWithinPartitions("c_nationkey", "part", "c_custkey")
    rows.drop("c_custkey").write.partitionBy("c_nationkey", "part").text(path)
    return path


_FOLDER = "'c_nationkey=' || c_nationkey || '/part=' || (c_custkey // 100000)"


_CHECKSUMS = f"SELECT {_FOLDER} AS folder, sha256(string_agg(c_name || chr(10), '' ORDER BY c_custkey)) AS digest FROM customer GROUP BY 1"


@query(_CHECKSUMS)
def checksums(t: Tables) -> DataFrame:
    lines = P.checksums(t.spark, _names_by_nation(t, "summed"))
    return lines.select(F.regexp_replace("name", "/[^/]*$", "").alias("folder"), F.substring_index("line", "  ", 1).alias("digest"))


@query(_CHECKSUMS)
def streamed_checksums(t: Tables) -> DataFrame:
    """Every file as if it were too large to be read as one value."""
    lines = P.checksums(t.spark, _names_by_nation(t, "streamed"), whole=0)
    return lines.select(F.regexp_replace("name", "/[^/]*$", "").alias("folder"), F.substring_index("line", "  ", 1).alias("digest"))


@query(f"SELECT 'data/customer/' || {_FOLDER} AS folder, CAST(sum(length(c_name) + 1) AS BIGINT) AS bytes FROM customer GROUP BY 1")
def payload_inventory(t: Tables) -> DataFrame:
    files = scans.payload_inventory(t.spark, _names_by_nation(t, "payload"), "data/customer")
    return files.where("length > 0").groupBy(F.regexp_replace("arcname", "/[^/]*$", "").alias("folder")).agg(F.sum("length").alias("bytes"))


@query("SELECT c_mktsegment || '/' || c_name AS arcname FROM customer WHERE lower(c_mktsegment) IN ('building', 'report.csv')")
def extra_conflicts(t: Tables) -> DataFrame:
    entries = t.customer.select(F.concat_ws("/", "c_mktsegment", "c_name").alias("arcname"))
    reserved = t.customer.where("c_mktsegment like 'B%'").select(F.initcap("c_mktsegment").alias("name")).union(t.customer.select(F.lit("report.csv")))
    return P.extra_conflicts(entries, reserved)


@query("SELECT c_custkey AS stratum_id, 'orders' AS \"table\", m AS name, CASE m WHEN 'about' THEN 'metadata' ELSE 'style' END AS kind, '<' || m || '/>' AS body, m = 'plain' AS is_default FROM customer, (SELECT unnest(['plain', 'rich', 'about']) AS m)")
def layer_documents(t: Tables) -> DataFrame:
    rows = [("orders", "plain", "style", "<plain/>", True), ("orders", "rich", "style", "<rich/>", False), ("orders", "about", "metadata", "<about/>", True)]
    members = t.spark.createDataFrame(rows, "table string, name string, kind string, body string, is_primary boolean")
    return P.layer_documents(strata.snapshot(t.customer, "c_custkey"), members)


@query("SELECT r_name AS stratum, 'orders' AS layer, count(*) AS feature_count, 'ok' AS status, '' AS detail FROM " + TO_ORDERS + " WHERE n_nationkey < 20 GROUP BY 1 UNION ALL SELECT '<unmatched>', 'orders', count(*), 'ok', '' FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey >= 20 UNION ALL SELECT r_name, 'supplier', (SELECT count(*) FROM supplier), 'ok', '' FROM region")
def run_report(t: Tables) -> DataFrame:
    flags = {"nation": {"subset": "n_nationkey < 20"}, "supplier": {"matching_method": "whole_export"}}
    return packager(t, layers=["orders", "supplier"], flags=flags).report()


@query("SELECT r_name AS stratum, l AS layer, CASE l WHEN 'supplier' THEN (SELECT count(*) FROM supplier) END AS feature_count, 'dry-run' AS status, '' AS detail FROM region, (SELECT unnest(['orders', 'supplier']) AS l)")
def dry_run(t: Tables) -> DataFrame:
    return packager(t, layers=["orders", "supplier"], dry_run=True, flags={"supplier": {"matching_method": "whole_export"}}).report()


def _tables(t: Tables, p) -> DataFrame:
    rows = [(x.layer.id, "NoGeometry", x.layer.source.columns, list(x.layer.excluded_fields), x.method, list(x.relation_ids), list(x.predicates), "") for x in p.plans]
    return t.spark.createDataFrame(rows, "layer string, geometry_type string, fields array<string>, excluded array<string>, matching_method string, relation_ids array<string>, predicates array<string>, crs string")


@query(
    """WITH c AS (SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9500 GROUP BY 1), rows AS (
SELECT n_name AS stratum, 'customer' AS layer_name, CASE WHEN n IS NULL THEN '' ELSE 'customer' END AS gpkg_table, CASE WHEN n IS NULL THEN '' ELSE n_name || '.gpkg' END AS path_in_zip,
  'vector' AS layer_type, 'NoGeometry' AS geometry_type, n AS feature_count, 3 AS field_count, 'c_acctbal;c_name' AS excluded_fields, 'attribute' AS matching_method,
  'r_customer_nation' AS match_detail, '' AS source_crs, 'ok' AS status, '' AS detail FROM nation LEFT JOIN c USING (n_name)
UNION ALL SELECT n_name, 'terrain', '', 'data/terrain.tif', 'raster', '', NULL, NULL, '', 'whole_export', '', 'EPSG:3857', 'ok', '' FROM nation
UNION ALL SELECT n_name, 'notes', '', '', 'annotation', '', NULL, NULL, '', '', '', '', 'project-only', '' FROM nation) SELECT * FROM rows"""
)
def bundle_report(t: Tables) -> DataFrame:
    p = packager(t, "nation", "n_name", layers=["customer"], flags={"customer": {"subset": "c_acctbal > 9500", "excluded_fields": ("c_acctbal", "c_name")}})
    names = p.strata.select("stratum_id", F.col("name").alias("stratum"), "package_rel")
    outcomes = names.join(p.counts("customer").where("feature_count > 0"), "stratum_id").select("stratum", F.lit("customer").alias("layer"), "feature_count", "status")
    payloads = t.spark.createDataFrame([("terrain", "data/terrain.tif", "raster", "EPSG:3857")], "layer string, path string, kind string, crs string")
    embedded = t.spark.createDataFrame([("notes", "annotation", "")], "layer string, kind string, crs string")
    return reports.bundle_rows(names.drop("stratum_id"), _tables(t, p), outcomes, payloads, embedded)


@query("SELECT (SELECT CAST(to_json(list_sort(list(DISTINCT 'n' || c_nationkey))) AS VARCHAR) FROM customer) AS paths, (SELECT count(DISTINCT c_nationkey) FROM customer) AS bundles, (SELECT coalesce(string_agg(n, ',' ORDER BY n), '') FROM (SELECT DISTINCT c_mktsegment AS n FROM customer WHERE c_acctbal < -900)) AS failed")
def run_summary(t: Tables) -> DataFrame:
    published = t.customer.select(F.concat(F.lit("n"), "c_nationkey").alias("path"))
    return reports.summary(published, t.customer.where("c_acctbal < -900").select(F.col("c_mktsegment").alias("stratum")))


# Outcomes of a run over the nations, made of the tables: their customers were written; strata with
# a very indebted customer failed; those with few suppliers had no usable cache.
_OUT = """o AS (SELECT n_name AS stratum, 'customer' AS layer, count(*) AS feature_count FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
f AS (SELECT DISTINCT n_name AS stratum FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < -980),
w AS (SELECT n_name AS stratum FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1 HAVING count(s_suppkey) < 4)"""


@query(
    f"""WITH {_OUT} SELECT n_name AS stratum, l AS layer, CASE WHEN f.stratum IS NULL THEN coalesce(o.feature_count, 0) END AS feature_count,
CASE WHEN f.stratum IS NOT NULL THEN 'failed' WHEN w.stratum IS NOT NULL AND l = 'customer' AND o.stratum IS NOT NULL THEN 'cold-fallback' WHEN o.stratum IS NOT NULL THEN 'ok' ELSE 'empty-skipped' END AS status,
CASE WHEN f.stratum IS NOT NULL THEN 'bad balance' WHEN w.stratum IS NOT NULL AND l = 'customer' AND o.stratum IS NOT NULL THEN 'missing' ELSE '' END AS detail
FROM nation CROSS JOIN (SELECT unnest(['customer', 'orders']) AS l) LEFT JOIN o ON o.stratum = n_name AND o.layer = l LEFT JOIN f ON f.stratum = n_name LEFT JOIN w ON w.stratum = n_name"""
)
def run_rows(t: Tables) -> DataFrame:
    names = t.nation.select(F.col("n_name").alias("stratum"), "n_nationkey")
    customers = t.customer.join(names, F.col("c_nationkey") == F.col("n_nationkey"))
    outcomes = customers.groupBy("stratum").agg(F.count("*").alias("feature_count")).withColumns({"layer": F.lit("customer"), "status": F.lit("ok")})
    failed = customers.where("c_acctbal < -980").select("stratum").distinct().withColumn("reason", F.lit("bad balance"))
    few = names.join(t.supplier, F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy("stratum").agg(F.count("s_suppkey").alias("n")).where("n < 4")
    layers = t.spark.createDataFrame([("customer", True), ("orders", False)], "layer string, warm boolean")
    return reports.run_rows(names, layers, outcomes, failed, few.select("stratum", F.lit("missing").alias("reason")))


@query("WITH c AS (SELECT c_mktsegment AS stratum, CAST(c_nationkey AS VARCHAR) AS layer, count(*) AS n FROM customer GROUP BY 1, 2), m AS (SELECT CAST(n_nationkey AS VARCHAR) AS layer, CAST(n_regionkey AS VARCHAR) AS p FROM nation), o AS (SELECT *, 'of ' || layer AS status FROM c WHERE n > 10 OR layer IN (SELECT p FROM m)) SELECT p.stratum, m.layer, coalesce(o.n, p.n) AS feature_count, coalesce(o.status, p.status) AS status FROM m JOIN o p ON p.layer = m.p LEFT JOIN o ON o.stratum = p.stratum AND o.layer = m.layer")
def outcome_fallback(t: Tables) -> DataFrame:
    """Layers by nation; the one with the region's number is the primary of the region's group."""
    counted = t.customer.groupBy(F.col("c_mktsegment").alias("stratum"), F.col("c_nationkey").cast("string").alias("layer")).agg(F.count("*").alias("feature_count"))
    members = t.nation.select(F.col("n_nationkey").cast("string").alias("layer"), F.col("n_regionkey").cast("string").alias("primary"))
    primaries = members.select(F.col("primary").alias("layer")).distinct()
    outcomes = counted.where("feature_count > 10").unionByName(counted.where("feature_count <= 10").join(primaries, "layer", "left_semi").select(counted.columns))
    return reports.outcome_fallback(members, outcomes.withColumn("status", F.concat(F.lit("of "), "layer")))


@query("SELECT 'n' || c_nationkey AS bundle_rel, count(*) FILTER (WHERE c_acctbal > 9000) AS shipped, count(*) FILTER (WHERE c_acctbal <= 9000) AS failed, CASE WHEN count(*) FILTER (WHERE c_acctbal > 9000) > 0 THEN 'ok' ELSE 'failed' END AS status FROM customer GROUP BY 1")
def bundle_status(t: Tables) -> DataFrame:
    return reports.bundle_status(t.customer.select(F.concat(F.lit("n"), "c_nationkey").alias("bundle_rel"), (F.col("c_acctbal") > 9000).alias("ok")))


# Caches by customer: expected are customer and orders; present is what the tables have rows of.
_PRESENT = "SELECT o_custkey AS stratum_id, 'orders' AS \"table\" FROM orders UNION SELECT user_id, 'events' FROM events WHERE value > 90 UNION SELECT c_custkey, 'customer' FROM customer WHERE c_acctbal > 0"


def _present(t: Tables) -> DataFrame:
    parts = [
        t.orders.select(F.col("o_custkey").alias("stratum_id"), F.lit("orders").alias("table")),
        t.events.where("value > 90").select("user_id", F.lit("events")),
        t.customer.where("c_acctbal > 0").select("c_custkey", F.lit("customer")),
    ]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@query(f"WITH present AS ({_PRESENT}), expected AS (SELECT c_custkey AS stratum_id, unnest(['customer', 'orders']) AS \"table\" FROM customer) SELECT *, 'missing' AS drift FROM (FROM expected EXCEPT FROM present) UNION ALL SELECT *, 'extra' FROM (FROM present EXCEPT FROM expected)")
def table_drift(t: Tables) -> DataFrame:
    expected = t.customer.select(F.col("c_custkey").alias("stratum_id"), F.explode(F.array(F.lit("customer"), F.lit("orders"))).alias("table"))
    return warm.table_drift(expected, _present(t))


_USABLE = f"""WITH present AS ({_PRESENT}), held AS (SELECT stratum_id, list_sort(list("table")) AS held FROM present GROUP BY 1),
state AS (SELECT c_custkey AS stratum_id, CASE WHEN held IS NULL THEN 'missing'
  WHEN len(list_filter(['customer', 'orders'], lambda x: NOT list_contains(held, x))) > 0 THEN 'lacks ' || array_to_string(list_filter(['customer', 'orders'], lambda x: NOT list_contains(held, x)), ', ')
  WHEN list_contains(held, 'events') THEN 'holds other events' END AS reason FROM customer LEFT JOIN held ON stratum_id = c_custkey)"""


def _state(t: Tables) -> DataFrame:
    return warm.usable(strata.snapshot(t.customer, "c_custkey"), ["customer", "orders"], _present(t))


@query(_USABLE + " SELECT stratum_id, reason IS NULL AS usable, reason FROM state")
def warm_usable(t: Tables) -> DataFrame:
    return _state(t)


@query(_USABLE + " SELECT stratum_id, o_orderkey, CASE WHEN reason IS NULL THEN 'warm' ELSE 'cold-fallback' END AS status FROM state JOIN orders ON o_custkey = stratum_id")
def warm_use(t: Tables) -> DataFrame:
    slices = t.orders.select(F.col("o_custkey").alias("stratum_id"), "o_orderkey")
    cache = stage(slices.join(_state(t).where("usable"), "stratum_id", "left_semi"), "cache")
    return warm.use(cache, slices, _state(t))


@query(_USABLE + " SELECT stratum_id, 'orders' AS layer, 'cold-fallback' AS status, reason FROM state WHERE reason IS NOT NULL")
def cold_fallback(t: Tables) -> DataFrame:
    layers = t.spark.createDataFrame([("orders", True), ("events", False)], "layer string, warm boolean")
    return warm.fallbacks(_state(t), layers)


@query(CUSTOMERS)
def warm_snapshot(t: Tables) -> DataFrame:
    """The cache of a warm table, published, read by strata."""
    built, slices = new_path(t.spark, "built"), _customers(t)
    P.write_partitioned(slices, built)
    return _sums(t.spark.read.schema(slices.schema).parquet(P.publish(t.spark, built, new_path(t.spark, "warm"))), "c_custkey")


@query("SELECT n_name AS stratum, 'customer' AS layer, count(*) AS feature_count, 'warm' AS status, '' AS detail FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1 UNION ALL SELECT '<unmatched>', 'customer', count(*), 'ok', '' FROM customer WHERE c_acctbal > 0 AND c_nationkey NOT IN (SELECT n_nationkey FROM nation) HAVING count(*) > 0")
def warm_update(t: Tables) -> DataFrame:
    """A stale cache is refreshed first, then the packages are built from it."""
    cache = new_path(t.spark, "warm")
    P.write_partitioned(_customers(t).where("stratum_id < 5"), f"{cache}/customer")
    flags = {"customer": {"subset": "c_acctbal > 0", "warm": True}}
    return packager(t, "nation", "n_name", layers=["customer"], flags=flags, warm_dir=cache, warm_mode="update").package(new_path(t.spark, "out"))


@query("SELECT n_name AS stratum, 'customer' AS layer, count(*) AS feature_count, CASE WHEN n_nationkey % 3 > 0 THEN 'warm' ELSE 'cold-fallback' END AS status, CASE WHEN n_nationkey % 3 > 0 THEN '' ELSE 'missing' END AS detail, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey")
def warm_package(t: Tables) -> DataFrame:
    """A run with a cache that two thirds of the strata have: the packages equal those of a cold run."""
    cache, out = new_path(t.spark, "warm"), new_path(t.spark, "out")
    P.write_partitioned(_customers(t).where("stratum_id % 3 > 0"), f"{cache}/customer")
    p = packager(t, "nation", "n_name", layers=["customer"], flags={"customer": {"warm": True}}, warm_dir=cache, warm_mode="use")
    report = p.package(out)
    keys = read_table(t.spark, out, "customer").groupBy("stratum_id").agg(F.sum("c_custkey").alias("keys"))
    names = t.nation.select(F.col("n_name").alias("stratum"), F.col("n_nationkey").alias("stratum_id"))
    return report.join(names, "stratum").join(keys, "stratum_id").drop("stratum_id")


@query("SELECT n_name AS stratum, 'customer' AS layer, count(*) AS feature_count, CASE WHEN n_nationkey < 10 THEN 'old' ELSE 'new' END AS written FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey >= 10 OR c_acctbal > 0 GROUP BY n_name, n_nationkey")
def overwrite_bundles(t: Tables) -> DataFrame:
    """A second run leaves the bundles of the first alone and adds those that are not there."""
    out = new_path(t.spark, "out")
    packager(t, "nation", "n_name", layers=["customer"], flags={"nation": {"subset": "n_nationkey < 10"}, "customer": {"subset": "c_acctbal > 0"}}).package(out)
    report = packager(t, "nation", "n_name", layers=["customer"], overwrite_mode="skip-existing").package(out)
    skipped = report.where("status = 'skipped-existing'").select("stratum")
    rows = read_manifest(t.spark, out).join(read_table(t.spark, out, "customer").groupBy("stratum_id").agg(F.count("*").alias("n")), "stratum_id")
    rows = rows.where("n = feature_count").join(skipped.withColumn("old", F.lit("old")), F.col("name") == F.col("stratum"), "left")
    return rows.select(F.col("name").alias("stratum"), F.col("table").alias("layer"), "feature_count", F.coalesce("old", F.lit("new")).alias("written"))


@query("SELECT n_nationkey AS stratum_id, count(*) AS rows, CAST(sum(s_suppkey) AS BIGINT) AS keys, count(s_acctbal) AS balances FROM nation JOIN supplier ON n_nationkey < 10 AND s_acctbal > 0 GROUP BY 1 UNION ALL SELECT n_nationkey, count(*), CAST(sum(s_suppkey) AS BIGINT), 0 FROM nation JOIN supplier ON n_nationkey >= 10 GROUP BY 1")
def shared_versions(t: Tables) -> DataFrame:
    """A whole export that changes between two runs: packages of the first keep the copy that was written with them."""
    out, supplier = new_path(t.spark, "out"), {"matching_method": "whole_export"}
    packager(t, "nation", "n_name", layers=["supplier"], flags={"nation": {"subset": "n_nationkey < 10"}, "supplier": supplier | {"subset": "s_acctbal > 0"}}).package(out)
    packager(t, "nation", "n_name", layers=["supplier"], overwrite_mode="skip-existing", flags={"supplier": supplier | {"excluded_fields": ("s_acctbal",)}}).package(out)
    sums = F.count("*").alias("rows"), F.sum("s_suppkey").cast("long").alias("keys"), F.count("s_acctbal").alias("balances")
    return read_table(t.spark, out, "supplier").groupBy("stratum_id").agg(*sums)


@query("SELECT r_name AS stratum, 'orders' AS layer, count(*) AS feature_count, 'ok' AS status FROM " + TO_ORDERS + " WHERE n_nationkey < 20 GROUP BY 1 UNION ALL SELECT '<unmatched>', 'orders', count(*), 'ok' FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey >= 20 UNION ALL SELECT '<full>', 'orders', count(*), 'ok' FROM orders UNION ALL SELECT '<full> in manifest', 'orders', count(*), 'ok' FROM orders")
def full_report(t: Tables) -> DataFrame:
    """The full package is a member like others: in the report and in the manifest."""
    out = new_path(t.spark, "out")
    report = packager(t, layers=["orders"], full_package=True, flags={"nation": {"subset": "n_nationkey < 20"}}).package(out)
    listed = read_manifest(t.spark, out).where("name = '<full>'").select(F.concat("name", F.lit(" in manifest")).alias("stratum"), F.col("table").alias("layer"), "feature_count", "status")
    return report.drop("detail").unionByName(listed)


@query("SELECT n_name AS stratum, 'customer' AS layer, CASE WHEN n_regionkey <> 1 THEN count(*) END AS feature_count, CASE WHEN n_regionkey = 1 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN n_regionkey = 1 THEN 'no display name for customer' ELSE '' END AS detail FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, n_regionkey UNION ALL SELECT '<unmatched>', 'customer', count(*), 'ok', '' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
def failed_stratum(t: Tables) -> DataFrame:
    """Strata for which the display name fails are reported; the others are published."""
    bad = ", ".join(f"'{r[0]}'" for r in t.nation.where("n_regionkey = 1").select("n_name").collect())
    name = f"CASE WHEN stratum_name NOT IN ({bad}) THEN concat(layer_name, ' of ', stratum_name) END"
    return packager(t, "nation", "n_name", layers=["customer"], display_expr=name).package(new_path(t.spark, "out"), fail_at_end=False)


@query("SELECT n_name AS stratum, l AS layer, CASE WHEN n_nationkey <> 7 THEN CASE l WHEN 'customer' THEN (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) ELSE (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) END END AS feature_count, CASE WHEN n_nationkey = 7 THEN 'failed' WHEN l = 'supplier' AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier) THEN 'empty-skipped' ELSE 'ok' END AS status, CASE WHEN n_nationkey <> 7 AND l = 'customer' THEN (SELECT CAST(sum(c_custkey % 10) AS BIGINT) FROM customer WHERE c_nationkey = n_nationkey) END AS digits FROM nation, (SELECT unnest(['customer', 'supplier']) AS l)")
def failed_rows(t: Tables) -> DataFrame:
    """A field that cannot be computed for some rows of one stratum: it fails in all its tables, the others ship."""
    out, digit = new_path(t.spark, "out"), "CAST(if(c_nationkey = 7 AND c_custkey % 3 = 0, c_name, right(CAST(c_custkey AS string), 1)) AS int)"
    report = packager(t, "nation", "n_name", layers=["customer", "supplier"], flags={"customer": {"computed": {"digit": digit}}}).package(out, fail_at_end=False)
    sums = read_table(t.spark, out, "customer").groupBy("stratum_id").agg(F.sum("digit").alias("digits"))
    sums = sums.join(t.nation, F.col("stratum_id") == F.col("n_nationkey")).select(F.col("n_name").alias("stratum"), F.lit("customer").alias("layer"), "digits")
    return report.where("stratum <> '<unmatched>'").drop("detail").join(sums, ["stratum", "layer"], "left")


_GRID = "n AS (SELECT n_nationkey, n_name, n_nationkey % 5 * 10 AS bx0, n_nationkey // 5 * 20 AS by0 FROM nation), placed AS (SELECT n_name, p_partkey, p_size - bx0 AS u, p_partkey % 100 - by0 AS v FROM part JOIN n ON p_size BETWEEN bx0 AND bx0 + 10 AND p_partkey % 100 BETWEEN by0 AND by0 + 20), hit AS (SELECT * FROM placed WHERE 2 * u + v <= 20)"


@query(f"WITH {_GRID} SELECT n_name AS stratum, 'points' AS layer, count(p_partkey) AS feature_count, CASE WHEN count(p_partkey) > 0 THEN 'ok' ELSE 'empty-skipped' END AS status, '' AS detail FROM nation LEFT JOIN hit USING (n_name) GROUP BY 1 UNION ALL SELECT '<unmatched>', 'points', count(*), 'ok', '' FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM hit) HAVING count(*) > 0")
def package_polygons(t: Tables) -> DataFrame:
    """Strata are triangles, features are points: a point in a triangle's box may be outside it."""
    i, j = (F.col("n_nationkey") % 5 * 10).cast("double"), (F.floor(F.col("n_nationkey") / 5) * 20).cast("double")
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    triangle = ring_edges(F.array(corner(i, j), corner(i + 10, j), corner(i, j + 20)))
    nations = t.nation.select("n_nationkey", "n_name", i.alias("minx"), j.alias("miny"), (i + 10).alias("maxx"), (j + 20).alias("maxy"), triangle.alias("shape"))
    points = t.part.select("p_partkey", F.col("p_size").cast("double").alias("minx"), (F.col("p_partkey") % 100).cast("double").alias("miny"))
    points = points.select("p_partkey", *[F.col(c).alias(n) for c, n in (("minx", "minx"), ("miny", "miny"), ("minx", "maxx"), ("miny", "maxy"))])
    catalog = Catalog(t.spark).add("nations", nations, "n_nationkey", geometry="polygon", shape="shape").add("points", points, "p_partkey", geometry="point")
    return Packager(t.spark, catalog, "nations", name_expr="n_name").package(new_path(t.spark, "out"))


#: What a customer's feature is, by key: a point, a line, a polygon with a hole, or two of a kind; some have no geometry.
_KINDS = ["Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon"]


@query("SELECT c_name AS label, c_nationkey, CASE c_custkey % 7 WHEN 0 THEN 'Point' WHEN 1 THEN 'LineString' WHEN 2 THEN 'Polygon' WHEN 3 THEN 'MultiPoint' WHEN 4 THEN 'MultiLineString' WHEN 5 THEN 'MultiPolygon' END AS kind, CASE WHEN c_custkey % 7 < 6 THEN c_custkey % 7 // 3 + 1 END AS parts, CASE c_custkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 10 WHEN 3 THEN 2 WHEN 4 THEN 4 WHEN 5 THEN 20 END AS corners, CASE WHEN c_custkey % 7 < 6 THEN c_acctbal END AS minx, CASE c_custkey % 7 WHEN 6 THEN NULL WHEN 0 THEN c_custkey ELSE c_custkey + CASE c_custkey % 7 WHEN 1 THEN 1 WHEN 2 THEN 9 WHEN 3 THEN 20 WHEN 4 THEN 21 ELSE 29 END END * 1.0 AS maxy FROM customer")
def scan_geojsonl(t: Tables) -> DataFrame:
    """Customers written as GeoJSON lines of all kinds and read again."""
    x, y, path = F.col("c_acctbal"), F.col("c_custkey").cast("double"), new_path(t.spark, "geojsonl")

    def shape(kind: str, up: int) -> F.Column:
        corner = lambda dx, dy: F.array(x + dx, y + dy + up)
        square = lambda d, n: F.array(*[corner(d + n * i, d + n * j) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
        return {"Point": corner(0, 0), "LineString": F.array(corner(0, 0), corner(5, 1)), "Polygon": F.array(square(0, 9), square(2, 3))}[kind]

    def coordinates(kind: str) -> F.Column:
        return F.array(*[shape(kind[5:], up) for up in (0, 20)]) if kind.startswith("Multi") else shape(kind, 0)

    geometry = F.lit(None).cast("string")
    for i, kind in enumerate(_KINDS):
        geometry = F.when(F.col("c_custkey") % 7 == i, F.to_json(F.struct(F.lit(kind).alias("type"), coordinates(kind).alias("coordinates")))).otherwise(geometry)
    label = F.to_json(F.struct(F.col("c_name").alias("label"), "c_nationkey"))
    t.customer.select(F.concat(F.lit('{"type": "Feature", "properties": '), label, F.lit(', "geometry": '), F.coalesce(geometry, F.lit("null")), F.lit("}"))).write.text(path)
    read = scans.scan_geojson_lines(t.spark, path, ["label", "c_nationkey"])
    box = {c: v for c, v in zip(("minx", "miny", "maxx", "maxy"), shape_box(F.col("parts")))}
    corners = F.when(F.col("parts").isNotNull(), F.size(F.flatten(F.flatten("parts"))))
    return read.select("label", F.col("c_nationkey").cast("int").alias("c_nationkey"), "kind", F.when(F.col("parts").isNotNull(), F.size("parts")).alias("parts"), corners.alias("corners"), box["minx"].alias("minx"), box["maxy"].alias("maxy"))
