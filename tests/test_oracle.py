"""Every registered query against its DuckDB oracle on the driver's tables
(sf0.001), the same check the driver runs at sf0.01; plus the entry point."""

import pytest

from prospect.plans import registry
from tests.oracle_harness import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", sorted(registry.QUERIES))
def test_query_matches_oracle(spark, con, key):
    res = compare(spark, key, SF, con)
    assert res["status"] in ("match", "rows-only"), res
    if key in registry.ORACLES:
        assert res["spark_rows"] == res["oracle_rows"]


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_entry_runs(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert len(df.columns) == 26
    assert df.count() >= 0
