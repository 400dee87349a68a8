"""Scans, attribute matching, orphans and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonepack.operators import membership as M
from zonepack.operators import reports, sharing, strata
from zonepack.plans.packager import Packager
from zonepack.queries.registry import Tables, query, tpch_catalog
from zonepack.sources import scans

TO_ORDERS = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
TO_LINES = "lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def regions(t: Tables) -> DataFrame:
    return strata.snapshot(t.region, "r_regionkey", ["r_regionkey", "r_name"])


def packager(t: Tables, stratification: str = "region", name: str = "r_name", flags: dict | None = None, **options) -> Packager:
    return Packager(t.spark, tpch_catalog(t, **(flags or {})), stratification, name_expr=name, **options)


@query("SELECT * FROM orders")
def scan_layer(t: Tables) -> DataFrame:
    return scans.scan(t.spark, f"{t.dir}/orders.parquet")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 0")
def scan_subset(t: Tables) -> DataFrame:
    return scans.scan(t.spark, f"{t.dir}/customer.parquet", subset="c_acctbal > 0").select("c_custkey", "c_name", "c_acctbal")


@query("SELECT o_orderkey, o_custkey FROM orders")
def hop_fields(t: Tables) -> DataFrame:
    return scans.pruned(t.orders, ["o_custkey"], ["o_orderkey"])


@query("SELECT r_name AS stratum, count(*) AS orders FROM " + TO_ORDERS + " GROUP BY r_name UNION ALL SELECT '<unmatched>', 0")
def orders_per_region(t: Tables) -> DataFrame:
    """The flagship: rows per stratum along the chain of relations, and the unmatched ones."""
    p = packager(t, layers=["orders"])
    member = p.membership("orders")
    counted = p.strata.select("stratum_id", "raw_name").join(M.counts(p.strata, member), "stratum_id").select(F.col("raw_name").alias("stratum"), F.col("feature_count").alias("orders"))
    rest = M.orphans(t.orders, member, ["o_orderkey"]).agg(F.count("*").alias("orders")).select(F.lit("<unmatched>").alias("stratum"), "orders")
    return counted.unionByName(rest)


@query("SELECT c_nationkey AS stratum_id, c_custkey FROM customer")
def match_one_hop(t: Tables) -> DataFrame:
    return packager(t, "nation", "n_name", layers=["customer"]).membership("customer")


@query("SELECT r_regionkey AS stratum_id, o_orderkey FROM " + TO_ORDERS)
def match_chain(t: Tables) -> DataFrame:
    return packager(t, layers=["orders"]).membership("orders")


@query("SELECT n_regionkey AS stratum_id, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def match_pinned(t: Tables) -> DataFrame:
    pin = '["r_lineitem_orders", "r_orders_customer", "r_customer_nation", "r_nation_region"]'
    return packager(t, layers=["lineitem"], flags={"lineitem": {"relation_path": pin}}).membership("lineitem")


@query("SELECT c_nationkey || '|' || c_mktsegment AS stratum_id, c_custkey FROM customer WHERE c_acctbal > 0 AND EXISTS (SELECT 1 FROM customer x WHERE x.c_nationkey = customer.c_nationkey AND x.c_mktsegment = customer.c_mktsegment)")
def match_composite(t: Tables) -> DataFrame:
    pairs = t.customer.select("c_nationkey", "c_mktsegment").distinct().withColumn("stratum_id", F.concat_ws("|", "c_nationkey", "c_mktsegment"))
    return M.match_chain(pairs, [M.Hop(("c_mktsegment", "c_nationkey"), t.customer.where("c_acctbal > 0"), ("c_mktsegment", "c_nationkey"))], ["c_custkey"])


@query("SELECT n_nationkey AS stratum_id, c_custkey FROM nation JOIN customer ON nullif(c_nationkey, 7) = nullif(n_nationkey, 3)")
def match_null_keys(t: Tables) -> DataFrame:
    nations = t.nation.select(F.col("n_nationkey").alias("stratum_id"), F.expr("nullif(n_nationkey, 3)").alias("k"))
    return M.match_chain(nations, [M.Hop(("k",), t.customer.withColumn("k", F.expr("nullif(c_nationkey, 7)")), ("k",))], ["c_custkey"])


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE EXISTS (SELECT 1 FROM lineitem x WHERE x.l_partkey = lineitem.l_partkey AND x.l_suppkey = lineitem.l_suppkey AND x.l_quantity >= 49)")
def key_set_filter(t: Tables) -> DataFrame:
    keys = t.lineitem.where("l_quantity >= 49").select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    return M.key_set_filter(t.lineitem, keys, ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("SELECT r_regionkey AS stratum_id, o_orderkey FROM " + TO_ORDERS + " WHERE c_acctbal > 0")
def match_hop_subset(t: Tables) -> DataFrame:
    return packager(t, layers=["orders"], flags={"customer": {"subset": "c_acctbal > 0"}}).membership("orders")


@query("SELECT c_custkey AS stratum_id, c_custkey FROM customer")
def match_self(t: Tables) -> DataFrame:
    return packager(t, "customer", "c_name", layers=["customer"]).membership("customer")


@query("SELECT r_regionkey AS stratum_id, s_suppkey FROM region, supplier")
def match_whole_export(t: Tables) -> DataFrame:
    return packager(t, layers=["supplier"], flags={"supplier": {"matching_method": "whole_export"}}).membership("supplier")


@query("SELECT DISTINCT r_regionkey AS stratum_id, l_partkey AS p_partkey FROM " + TO_LINES)
def match_fan_out(t: Tables) -> DataFrame:
    return packager(t, layers=["part"]).membership("part")


@query("SELECT n_regionkey AS stratum_id, event_id FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE event_type = 'click' OR value > 50")
def match_union(t: Tables) -> DataFrame:
    members = [packager(t, layers=["events"], flags={"events": {"subset": s}}).membership("events") for s in ("event_type = 'click'", "value > 50")]
    return M.union(*members)


@query("SELECT 'orders' AS layer, c_nationkey AS stratum_id, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 2 UNION ALL SELECT 'events', c_nationkey, count(*) FROM events JOIN customer ON user_id = c_custkey GROUP BY 2")
def match_shared_prefix(t: Tables) -> DataFrame:
    """Two layers behind the same hops; the keys of the shared hops are made once."""
    p = packager(t, "nation", "n_name", layers=["orders", "events"])
    counted = [p.membership(i).groupBy("stratum_id").agg(F.count("*").alias("n")).select(F.lit(i).alias("layer"), "stratum_id", "n") for i in ("orders", "events")]
    return counted[0].unionByName(counted[1])


@query("SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey >= 20")
def orphan_rows(t: Tables) -> DataFrame:
    p = packager(t, layers=["orders"], flags={"nation": {"subset": "n_nationkey < 20"}})
    return M.orphans(t.orders, p.membership("orders"), ["o_orderkey"]).select("o_orderkey")


@query("SELECT r_regionkey AS stratum_id, count(o_orderkey) AS feature_count FROM region LEFT JOIN (SELECT n_regionkey, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 5 <> 2) ON n_regionkey = r_regionkey GROUP BY 1")
def feature_counts(t: Tables) -> DataFrame:
    p = packager(t, layers=["orders"], flags={"nation": {"subset": "n_nationkey % 5 <> 2"}})
    return M.counts(p.strata, p.membership("orders"))


@query("SELECT '<unmatched>' AS stratum, layer, feature_count, 'ok' AS status, '' AS detail FROM (SELECT 'orders' AS layer, count(*) AS feature_count FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey >= 20 UNION ALL SELECT 'events', count(*) FROM events JOIN customer ON user_id = c_custkey WHERE c_nationkey >= 20) WHERE feature_count > 0")
def orphan_counts(t: Tables) -> DataFrame:
    p = packager(t, layers=["orders", "events"], flags={"nation": {"subset": "n_nationkey < 20"}})
    rows = [reports.orphan_row(layer, i, M.orphans(layer, p.membership(i), [key])) for i, layer, key in (("orders", t.orders, "o_orderkey"), ("events", t.events, "event_id"))]
    return rows[0].unionByName(rows[1])


@query("SELECT r_regionkey AS stratum_id, o_orderkey, o_orderstatus, o_totalprice FROM " + TO_ORDERS)
def excluded_fields(t: Tables) -> DataFrame:
    drop = ("o_custkey", "o_orderdate", "o_orderpriority", "no_such_field")
    return packager(t, layers=["orders"], flags={"orders": {"excluded_fields": drop}}).slices("orders")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def dedup_fields(t: Tables) -> DataFrame:
    fields = sharing.group_fields(t.customer.columns, {"plain": ["c_name", "c_custkey"], "rich": ["c_nationkey"]}, {"rich": ["c_acctbal"]})
    return t.customer.select(fields)


@query("SELECT c_nationkey, c_name FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING'")
def member_view(t: Tables) -> DataFrame:
    shared = t.customer.where("c_acctbal > 0 or c_nationkey < 5")
    return sharing.member_view(shared, ["c_nationkey", "c_name"], "c_acctbal > 0 AND c_mktsegment = 'BUILDING'")


@query("SELECT c_custkey AS stratum_id, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def strata_selection(t: Tables) -> DataFrame:
    chosen = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return strata.snapshot(t.customer, "c_custkey", ["c_name"], selection=chosen)


@query("SELECT c_custkey AS stratum_id, c_name, c_mktsegment FROM customer WHERE c_acctbal > 100 ORDER BY c_custkey")
def strata_snapshot(t: Tables) -> DataFrame:
    return strata.snapshot(t.customer, "c_custkey", ["c_name", "c_mktsegment"], subset="c_acctbal > 100").orderBy("stratum_id")
