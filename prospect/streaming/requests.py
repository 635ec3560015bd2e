"""Search requests as a stream (Structured Streaming).

Requests arrive as JSON files in a folder (one request per line, the
``REQUESTS`` schema plus an optional ``profile``).  Each micro-batch is
resolved, validated and searched against the static prepared tables with the
batch plan (``prospect.plans.batch``), and its results and per-request
counts are written under ``sink``.

Writes are keyed by the micro-batch id (``batch_id=<n>`` folders written
with overwrite), so a batch replayed after a failure replaces its own output
instead of duplicating it; the query's checkpoint location records progress
and must be on the shared file system.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from prospect.plans import batch as B
from prospect.session import scratch_scope
from prospect.sources import schemas
from prospect.sources.tables import Tables

STREAM_SCHEMA = T.StructType(schemas.REQUESTS.fields + [T.StructField("profile", T.StringType())])


def request_stream(spark: SparkSession, source: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of requests read from JSON files under ``source``."""
    reader = spark.readStream.schema(STREAM_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return reader.json(source)


def search_batch(tables: Tables, requests: DataFrame, sink: str, batch_id: int,
                 profiles: DataFrame | None = None, as_of=None) -> None:
    """One micro-batch: B1-B5 on the batch's requests, written by batch id.
    The batch's stage tables are removed once both outputs are written, so a
    long-running stream does not accumulate them."""
    if profiles is None:
        requests = requests.drop("profile")
    with scratch_scope(tables.companies.sparkSession):
        _, _, _, counts = B.run_requests(tables, requests, profiles, as_of,
                                         results_path=f"{sink}/results/batch_id={batch_id}")
        counts.write.mode("overwrite").parquet(f"{sink}/counts/batch_id={batch_id}")


def start_request_search(tables: Tables, source: str, sink: str, checkpoint_location: str,
                         profiles: DataFrame | None = None, as_of=None, available_now: bool = False,
                         processing_time: str | None = None, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the streaming search; returns the running query."""
    spark = tables.companies.sparkSession
    stream = request_stream(spark, source, max_files_per_trigger)
    writer = (
        stream.writeStream
        .option("checkpointLocation", checkpoint_location)
        .foreachBatch(lambda df, batch_id: search_batch(tables, df, sink, batch_id, profiles, as_of))
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
