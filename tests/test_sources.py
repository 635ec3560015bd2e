"""Sources and sinks: explicit schemas, malformed input, snapshots, round trips."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from prospect.session import scratch_path
from prospect.sources import readers as S
from prospect.sources import writers as W


def write_text(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write("\n".join(lines) + "\n")


def local(p):
    return p.replace("file:", "", 1) if p.startswith("file:") else p


def test_company_csv_quotes_dates_and_header_blank(spark):
    base = local(scratch_path(spark, "csv"))
    path = f"{base}/BasicCompanyDataAsOneFile-2025-01-01.csv"
    write_text(path, [
        'CompanyName, CompanyNumber,RegAddress.PostCode,IncorporationDate,SICCode.SicText_1,Extra',
        '"ACME, LTD",00000001,AB1 2CD,01/02/2001,"62020 - IT ""consulting""",x',
        'PLAIN LTD,00000002,,,,y',
    ])
    df = S.scan_companies_csv(spark, path)
    assert "CompanyNumber" in df.columns  # header name trimmed
    rows = {r.CompanyNumber: r for r in df.collect()}
    assert rows["00000001"].CompanyName == "ACME, LTD"
    assert rows["00000001"].IncorporationDate == dt.date(2001, 2, 1)
    assert rows["00000001"]["SICCode.SicText_1"] == '62020 - IT "consulting"'
    assert rows["00000002"].IncorporationDate is None
    assert rows["00000002"]["RegAddress.PostCode"] is None


def test_company_csv_bad_date_aborts(spark):
    base = local(scratch_path(spark, "csvbad"))
    path = f"{base}/companies.csv"
    write_text(path, ["CompanyName,CompanyNumber,IncorporationDate", "A,1,31/31/2001"])
    with pytest.raises(Exception):
        S.scan_companies_csv(spark, path).collect()


def test_psc_ndjson_tolerates_broken_and_blank_lines(spark):
    base = local(scratch_path(spark, "ndjson"))
    path = f"{base}/psc.txt"
    write_text(path, [
        '{"company_number":"1","data":{"name":"Ann","kind":"individual-person-with-significant-control",'
        '"date_of_birth":{"year":1960,"month":5},"notified_on":"2016-04-06"}}',
        '{"company_number":"2","data":{broken',
        '',
        '{"company_number":"3","data":{"name":"Co","kind":"corporate-entity-person-with-significant-control"}}',
        '{"company_number":"4","data":{"name":"Bo","kind":"individual-person-with-significant-control"}}',
    ])
    df = S.scan_psc_ndjson(spark, path)
    assert df.count() == 4  # the blank line is not a record
    from prospect.operators.quality import psc_drop_accounting

    acc = psc_drop_accounting(spark, path).first().asDict()
    assert acc["total_lines"] == 5
    assert acc["parsed_records"] == 1
    assert acc["malformed"] == 1
    assert acc["non_individual"] == 1
    assert acc["missing_birth_year"] == 1
    assert acc["dropped"] == 4


def test_snapshot_dates_are_chronological():
    assert S.snapshot_date("raw/ONSPD_NOV_2024/Data/ONSPD_NOV_2024_UK.csv") == dt.date(2024, 11, 1)
    assert S.snapshot_date("raw/ONSPD_FEB_2025/Data/ONSPD_FEB_2025_UK.csv/part-00000-1234-56.csv") == dt.date(2025, 2, 1)
    assert S.snapshot_date("raw/persons-with-significant-control-snapshot-2025-01-01.txt") == dt.date(2025, 1, 1)
    assert S.snapshot_date("raw/other.csv") is None


def test_latest_snapshot_reads_only_newest(spark):
    base = local(scratch_path(spark, "snap"))
    write_text(f"{base}/ONSPD_NOV_2024/Data/ONSPD_NOV_2024_UK.csv", ["pcds,lat,long,lsoa21,doterm", "OLD 1AA,51,0,E1,"])
    write_text(f"{base}/ONSPD_FEB_2025/Data/ONSPD_FEB_2025_UK.csv", ["pcds,lat,long,lsoa21,doterm", "NEW 1AA,52,0,E2,"])
    df = S.latest_snapshot(spark, f"{base}/ONSPD_*/Data/ONSPD_*_UK.csv", lambda f: S.scan_postcodes_csv(spark, f))
    rows = df.collect()
    assert [(r.pcds, r.snapshot_date) for r in rows] == [("NEW 1AA", dt.date(2025, 2, 1))]
    assert rows[0].lat == 52.0


def test_absent_officers_is_empty(spark):
    df = S.scan_officers(spark, scratch_path(spark, "nothing-here"))
    assert df.count() == 0
    assert df.columns == ["company_number", "appointment_date"]


def test_parquet_roundtrip_zstd_row_groups(spark):
    path = scratch_path(spark, "rg.parquet")
    W.write_parquet(spark.range(2500).select(F.col("id"), (F.col("id") * 2).alias("v")).coalesce(1), path,
                    row_group_rows=1000)
    back = spark.read.parquet(path)
    assert back.count() == 2500
    import glob

    import pyarrow.parquet as pq

    files = glob.glob(local(path) + "/*.parquet")
    meta = pq.ParquetFile(files[0]).metadata
    assert meta.num_row_groups == 3
    assert meta.row_group(0).column(0).compression == "ZSTD"


def test_csv_sink_header_and_nulls(spark):
    path = scratch_path(spark, "out.csv")
    W.write_csv(spark.createDataFrame([("a", None), ("b", "x")], "k string, v string").coalesce(1), path)
    back = spark.read.option("header", True).csv(path)
    assert back.columns == ["k", "v"]
    assert {r.k: r.v for r in back.collect()} == {"a": None, "b": "x"}
