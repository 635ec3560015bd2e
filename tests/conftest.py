import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MEDIUM = "/root/testdata/sf0.01"
AS_OF = "2025-06-30"


@pytest.fixture(scope="session")
def spark():
    from prospect.session import local_session

    s = local_session("*", shuffle_partitions=8, app="prospect-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small_tables(spark):
    """Prepared tables from the sf0.001 fixtures, written once as Parquet."""
    from prospect.plans.pipeline import RawSources, prepare_all
    from prospect.session import scratch_path
    from prospect.sources import fixtures as FX

    raw = RawSources(FX.companies_raw(spark, SF_SMALL), FX.psc_raw(spark, SF_SMALL),
                     FX.postcodes_raw(spark, SF_SMALL), FX.officers_raw(spark, SF_SMALL))
    return prepare_all(spark, raw, scratch_path(spark, "test-prepared"), AS_OF)


@pytest.fixture(scope="session")
def medium_tables(spark):
    from prospect.plans.pipeline import RawSources, prepare_all
    from prospect.session import scratch_path
    from prospect.sources import fixtures as FX

    raw = RawSources(FX.companies_raw(spark, SF_MEDIUM), FX.psc_raw(spark, SF_MEDIUM),
                     FX.postcodes_raw(spark, SF_MEDIUM), FX.officers_raw(spark, SF_MEDIUM))
    return prepare_all(spark, raw, scratch_path(spark, "test-prepared-m"), AS_OF)
