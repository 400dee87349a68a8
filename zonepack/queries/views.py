"""Query layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonepack.operators import views
from zonepack.queries.matching import packager
from zonepack.queries.registry import Tables, query
from zonepack.sources import packages as P
from zonepack.sources.staging import new_path, stage

_QUERY = "SELECT c_custkey, count(*) AS n, max(o_orderkey) AS last FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"


def _packages(t: Tables, *layers: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The regions, and the layers' slices, written by strata: a stratum's view reads its own folders."""
    p = packager(t, layers=list(layers))
    found = {}
    for layer in layers:
        slices, path = p.slices(layer), new_path(t.spark, "slices")
        P.write_partitioned(slices, path)
        found[layer] = t.spark.read.schema(slices.schema).parquet(path)
    return p.strata, found


@query("SELECT stratum_id, c_custkey, n, last FROM (SELECT n_regionkey AS stratum_id, c_custkey, count(*) AS n, max(o_orderkey) AS last FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY ALL) WHERE n > 2")
def live_view(t: Tables) -> DataFrame:
    """A query over each stratum's tables, with its own filter."""
    strata, slices = _packages(t, "customer", "orders")
    return views.over_strata(t.spark, _QUERY, slices, strata, "n > 2")


@query("SELECT r_regionkey AS stratum_id, o_custkey, o_totalprice, k FROM region JOIN (SELECT n_regionkey, o_custkey, round(o_totalprice, 2) AS o_totalprice, row_number() OVER (PARTITION BY n_regionkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) ON n_regionkey = r_regionkey WHERE k <= 20")
def live_window(t: Tables) -> DataFrame:
    """The dearest orders of each stratum: the query's own window and limit are those of one stratum."""
    strata, slices = _packages(t, "orders")
    text = "SELECT o_custkey, round(o_totalprice, 2) AS o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders ORDER BY k LIMIT 20"
    return views.over_strata(t.spark, text, slices, strata)


@query(f"SELECT c_nationkey AS stratum_id, q.c_custkey, n, last FROM ({_QUERY}) q JOIN customer USING (c_custkey)")
def materialized_view(t: Tables) -> DataFrame:
    """The query is run once; its result is matched and sliced like a table."""
    p = packager(t, "nation", "n_name", layers=["customer"])
    layer = stage(views.over(t.spark, _QUERY, {"customer": t.customer, "orders": t.orders}), "view")
    return p.membership("customer").join(layer, "c_custkey").select("stratum_id", "c_custkey", "n", "last")


@query("SELECT n_regionkey AS stratum_id, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def package_query(t: Tables) -> DataFrame:
    """A query layer that is never read itself runs over the tables that the run creates, in each stratum."""
    text = "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority"
    strata, slices = _packages(t, "orders")
    return views.over_strata(t.spark, text, slices, strata)
