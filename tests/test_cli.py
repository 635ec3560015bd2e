"""Command line: parameter layering and an end-to-end run."""

import argparse

import pytest

from prospect import cli

CONFIG = {
    "defaults": {"output_format": "csv", "company_status": "Active"},
    "profiles": {
        "near": {"description": "test", "postcode": "AB24 0AQ", "radius_miles": 40, "sic_codes": [62020, 62090],
                 "min_psc_age": 60},
    },
}


def ns(**kw):
    base = {f: None for f in cli.FLAG_FIELDS}
    base.update(kw)
    return argparse.Namespace(**base)


def test_layering_defaults_profile_flags():
    p = cli.merge_parameters(CONFIG, "near", ns(radius=10.0, min_psc_age=None))
    assert p["postcode"] == "AB24 0AQ" and p["radius_miles"] == 10.0
    assert p["sic_codes"] == (62020, 62090) and p["min_psc_age"] == 60
    assert p["company_status"] == "Active" and "description" not in p


def test_flag_can_override_status_back_to_default():
    cfg = {"profiles": {"x": {"postcode": "A", "radius_miles": 1, "company_status": "Dissolved"}}}
    assert cli.merge_parameters(cfg, "x", ns(status="Active"))["company_status"] == "Active"


def test_unknown_profile():
    with pytest.raises(KeyError):
        cli.merge_parameters(CONFIG, "nope", ns())


def test_end_to_end(spark, small_tables, tmp_path):
    import yaml

    from prospect.session import scratch_path

    cfg = tmp_path / "config.yaml"
    cfg.write_text(yaml.safe_dump(CONFIG))
    prepared = small_tables.companies.inputFiles()[0].rsplit("/companies.parquet", 1)[0]
    out = scratch_path(spark, "cli-out")
    code = cli.main(["--prepared", prepared, "--config", str(cfg), "--profile", "near", "--output", out,
                     "--as-of", "2025-06-30"], spark=spark)
    assert code == 0
    back = spark.read.option("header", True).csv(out)
    assert len(back.columns) == 26 and back.count() > 0
    assert cli.main(["--prepared", prepared, "--postcode", "ZZ99 9ZZ", "--radius", "5"], spark=spark) == 1
    assert cli.main(["--prepared", prepared, "--postcode", "AB24 0AQ", "--radius", "0"], spark=spark) == 1


def test_listings(tmp_path, capsys):
    import yaml

    cfg = tmp_path / "config.yaml"
    cfg.write_text(yaml.safe_dump(CONFIG))
    assert cli.main(["--list-categories"]) == 0
    assert "MICRO ENTITY" in capsys.readouterr().out
    assert cli.main(["--config", str(cfg), "--list-profiles"]) == 0
    assert "near: test" in capsys.readouterr().out
    assert cli.main(["--config", str(cfg), "--profile", "missing"]) == 1


def test_prepare_from_raw_folder(spark, capsys):
    from prospect.plans.registry import write_postcodes_csv
    from prospect.session import scratch_path
    from prospect.sources import fixtures as FX

    sf = "/root/testdata/sf0.001"
    raw = scratch_path(spark, "cli-raw")
    FX.companies_raw(spark, sf).write.option("header", True).option("dateFormat", "dd/MM/yyyy").csv(
        f"{raw}/BasicCompanyDataAsOneFile-2025-06-01.csv")
    FX.psc_raw(spark, sf).write.option("dateFormat", "yyyy-MM-dd").json(
        f"{raw}/persons-with-significant-control-snapshot-2025-06-01.txt")
    write_postcodes_csv(spark, FX.postcodes_raw(spark, sf), raw, "FEB_2025")
    out = scratch_path(spark, "cli-prepared")
    assert cli.main(["--prepare-from", raw, "--prepared", out, "--as-of", "2025-06-30"], spark=spark) == 0
    text = capsys.readouterr().out
    assert "company_counts: {'total_companies': 150" in text
    assert "psc_drop_accounting: {'total_lines':" in text
    assert spark.read.parquet(f"{out}/company_profiles.parquet").count() > 0
    # With officers a tenure search finds companies; prepared again without
    # them, nothing of the earlier run is left.
    officers = f"{raw}/officers.parquet"
    FX.officers_raw(spark, sf).write.parquet(officers)
    given = ["--prepare-from", raw, "--prepared", out, "--as-of", "2025-06-30"]
    tenure = ["--prepared", out, "--postcode", "AB24 0AQ", "--radius", "500", "--min-psc-tenure", "1", "--as-of", "2025-06-30"]
    assert cli.main([*given, "--officers", officers], spark=spark) == 0
    assert cli.main(tenure, spark=spark) == 0
    assert cli.main(given, spark=spark) == 0
    assert spark.read.parquet(f"{out}/officers.parquet").count() == 0
    assert cli.main(tenure, spark=spark) == 1
    assert cli.main([*given, "--officers", f"{raw}/none.parquet"], spark=spark) == 1
    capsys.readouterr()
    assert cli.main(["--profile-from", raw], spark=spark) == 0
    assert "row_counts: {'source': 'companies', 'row_count': 150" in capsys.readouterr().out
