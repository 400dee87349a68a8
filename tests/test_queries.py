"""Every registered query of the packaging engine against its SQL, on the smallest tables."""

import pytest

from tests.conftest import DATA
from zonepack.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, rows, sql_rows, name):
    df = QUERIES[name](spark, DATA)
    found = rows(df)
    if name in SQL:
        columns, expected = sql_rows(SQL[name])
        assert sorted(df.columns) == columns
        assert found == expected
    else:
        assert found


def test_registry_survives_without_the_llm_part(spark):
    import subprocess
    import sys

    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in ("corpus_pipeline", "zonepack.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "match_chain" in e.queries() and not any(q.startswith("op") and q[2].isdigit() for q in e.queries()), e.queries()
assert "pipeline" not in e.queries() and e.oracle_sql()
"""
    from tests.conftest import ROOT

    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
