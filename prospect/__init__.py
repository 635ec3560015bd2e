"""prospect — company prospecting on Spark.

Prepare open company-register snapshots into Parquet tables, report on their
quality, and find the companies nearest to a place that match a set of
conditions, one request at a time, many requests in one job, or as a stream.

Every operator is a plain ``DataFrame -> DataFrame`` function built from
Spark's own expressions, joins and aggregates; nothing runs as a Python UDF.

Entry points::

    prepare_all(spark, RawSources(...), folder)      # raw snapshots -> prepared tables
    tables = read_prepared(spark, folder)
    search(tables, SearchRequest("SW1A 1AA", 10.0, sic_codes=(62020,)), as_of)
    find_companies(tables, request, as_of, output_path)
    run_requests(tables, requests_df, profiles_df, as_of)   # many requests in one job
"""

from prospect.plans.batch import run_requests  # noqa: F401
from prospect.plans.pipeline import RawSources, prepare_all, raw_sources_from_folder  # noqa: F401
from prospect.plans.search import SearchRequest, find_companies, search, validate_request  # noqa: F401
from prospect.sources.tables import Tables, read_prepared  # noqa: F401

__all__ = ["SearchRequest", "search", "find_companies", "validate_request", "Tables", "read_prepared",
           "RawSources", "prepare_all", "raw_sources_from_folder", "run_requests"]
