from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from zonepack.plans.catalog import Catalog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class Tables:
    """``t.orders`` is the scan of that table; a table's footer is read for its schema once."""

    _schemas: dict[str, StructType] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        path = f"{self.dir}/{name}.parquet"
        if path not in self._schemas:
            self._schemas[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(self._schemas[path]).parquet(path)


def query(sql: str | None = None):
    """Register ``f(t: Tables)`` under its name."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def tpch_catalog(t: Tables, **flags: dict) -> Catalog:
    """The tables and their foreign keys; ``flags`` are given by layer."""
    keys = {
        "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey",
        "orders": "o_orderkey", "events": "event_id", "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"),
    }
    catalog = Catalog(t.spark)
    for name, key in keys.items():
        catalog.add(name, getattr(t, name), key, **flags.get(name, {}))
    for relation, child, parent, near, far in (
        ("r_nation_region", "nation", "region", "n_regionkey", "r_regionkey"),
        ("r_customer_nation", "customer", "nation", "c_nationkey", "n_nationkey"),
        ("r_supplier_nation", "supplier", "nation", "s_nationkey", "n_nationkey"),
        ("r_orders_customer", "orders", "customer", "o_custkey", "c_custkey"),
        ("r_lineitem_orders", "lineitem", "orders", "l_orderkey", "o_orderkey"),
        ("r_lineitem_supplier", "lineitem", "supplier", "l_suppkey", "s_suppkey"),
        ("r_lineitem_part", "lineitem", "part", "l_partkey", "p_partkey"),
        ("r_events_customer", "events", "customer", "user_id", "c_custkey"),
    ):
        catalog.relate(relation, child, parent, [(near, far)])
    return catalog
