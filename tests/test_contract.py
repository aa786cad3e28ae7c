import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
import check

SF = "/root/testdata/sf0.001"
ROWS_ONLY: set[str] = set()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    held = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        held.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return held


def test_every_query_has_sql():
    own = set(contract.queries()) - set(contract.LLM_QUERIES)
    assert own - set(contract.oracle_sql()) == ROWS_ONLY


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    verdict = check.compare(spark, con, SF, name)
    assert verdict.startswith("ok") and "TYPES" not in verdict, verdict
