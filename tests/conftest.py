import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    conf = {
        "spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.sql.session.timeZone": "UTC", "spark.local.dir": f"{folder}/local", "spark.checkpoint.dir": f"{folder}/shared",
        "spark.sql.warehouse.dir": f"{folder}/warehouse", "spark.driver.host": "127.0.0.1", "spark.ui.showConsoleProgress": "false",
    }
    session = SparkSession.builder.config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


@pytest.fixture(scope="session")
def rows():
    """Rows of a frame as sorted tuples, columns by name."""

    def of(df, *columns):
        columns = columns or sorted(df.columns)
        return sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)

    return of


@pytest.fixture(scope="session")
def sql_rows(duck):
    def of(sql):
        found = duck.execute(sql)
        names = [c[0] for c in found.description]
        order = sorted(range(len(names)), key=names.__getitem__)
        return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)

    return of
