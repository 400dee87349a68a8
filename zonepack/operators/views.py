"""Query layers over a package."""

from __future__ import annotations

import re
import uuid
import warnings
from collections.abc import Mapping
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def missing_tables(spark: SparkSession, query: str, tables: Mapping[str, object]) -> list[str]:
    """Tables that ``query`` reads and the run does not make, ignoring case."""
    from zonepack.functions.text import source_tables

    found = spark.range(1).select(source_tables(F.lit(query)).alias("t")).first()["t"]
    known = {t.lower() for t in tables}
    return [t for t in found if t.lower() not in known]


def over(spark: SparkSession, query: str, tables: Mapping[str, DataFrame], subset: str | None = None) -> DataFrame:
    """``query`` over ``tables``, its filter applied to the result. Table names are bound to these frames only."""
    names = {name: f"{name}_{uuid.uuid4().hex}" for name in tables}
    for name, df in tables.items():
        df.createOrReplaceTempView(names[name])
    bound = ", ".join(f"{name} AS (SELECT * FROM {view})" for name, view in names.items())
    query = f"WITH {bound} {query}"
    out = spark.sql(query)
    return out.where(F.expr(subset)) if subset else out


#: Queries inside a query, and what begins with its own WITH: Spark can't correlate these with a stratum.
NESTED = r"(?is)^\s*with\b|\(\s*(select|with|table|from|values)\b"


def _in_one_plan(spark: SparkSession, query: str, slices: Mapping[str, DataFrame], strata: DataFrame) -> DataFrame | None:
    """(stratum_id, ...): the query as a lateral subquery of the strata, over tables that are correlated with the stratum. The
    optimizer turns that into joins and groups that carry stratum_id along. None for a query that it can't do that with."""
    if re.search(NESTED, query):
        return None
    names = {name: f"{name}_{uuid.uuid4().hex}" for name in (*slices, "strata")}
    for name, df in {**slices, "strata": strata.select("stratum_id")}.items():
        df.createOrReplaceTempView(names[name])
    bound = ", ".join(f"{n} AS (SELECT * EXCEPT (stratum_id) FROM {names[n]} t WHERE t.stratum_id = s.stratum_id)" for n in slices)
    try:
        found = spark.sql(f"SELECT s.stratum_id, q.* FROM {names['strata']} s, LATERAL (WITH {bound} {query}) q")
        found._jdf.queryExecution().executedPlan()  # refused here at the latest, before anything runs
    except (AnalysisException, Py4JError, PySparkException):
        return None
    return found


def over_strata(spark: SparkSession, query: str, slices: Mapping[str, DataFrame], strata: DataFrame, subset: str | None = None) -> DataFrame | None:
    """(stratum_id, ...): ``query`` over the tables of each stratum (``slices``, filtered by its stratum_id), ``subset`` applied to
    the result. Groups, windows, limits and sums over everything are those of one stratum.

    All strata are in one plan. Only a query with queries inside, or one that Spark can't correlate, is run stratum by
    stratum, in a union. None, with a warning, where a table is missing or the query doesn't open.
    """
    if missing := missing_tables(spark, query, slices):
        warnings.warn(f"not created by this run: {', '.join(missing)}", stacklevel=2)
        return None
    found = _in_one_plan(spark, query, slices, strata)
    if found is None:
        try:
            ids = [r[0] for r in strata.select("stratum_id").orderBy("stratum_id").collect()]
            each = lambda i: {name: df.where(F.col("stratum_id") == F.lit(i)).drop("stratum_id") for name, df in slices.items()}
            kind = strata.schema["stratum_id"].dataType
            found = reduce(DataFrame.unionByName, [over(spark, query, each(i)).select(F.lit(i).cast(kind).alias("stratum_id"), "*") for i in ids])
        except AnalysisException as e:
            warnings.warn(f"the query does not open: {str(e).splitlines()[0]}", stacklevel=2)
            return None
    return found.where(F.expr(subset)) if subset else found


def live_view(spark: SparkSession, query: str, slices: Mapping[str, DataFrame], stratum_id, subset: str | None = None) -> DataFrame | None:
    """The query over one stratum's tables (each filtered by its partition); None if a table is missing or it
    doesn't open."""
    if missing_tables(spark, query, slices):
        return None
    try:
        return over(spark, query, {name: df.where(F.col("stratum_id") == F.lit(stratum_id)).drop("stratum_id") for name, df in slices.items()}, subset)
    except AnalysisException:
        return None
