"""Command line: one search over a prepared folder, written as CSV.

    spark-submit -m prospect.cli --prepared hdfs:///prepared --config config.yaml \\
        --profile local_owners --radius 20 --output hdfs:///out/local_owners

Parameters are layered as in the original tool: configuration ``defaults``,
then the chosen ``profiles`` entry, then the flags given on the command line
(a flag that is not given does not override).  The search itself runs as
Spark jobs (``prospect.plans.search.find_companies``); the driver only merges
the parameters and prints the outcome.
"""

from __future__ import annotations

import argparse
import sys

from prospect.plans.search import VALID_CATEGORIES, SearchRequest, find_companies

# Flag -> request field.
FLAG_FIELDS = {
    "postcode": "postcode", "radius": "radius_miles", "sic": "sic_codes", "categories": "account_categories",
    "status": "company_status", "min_company_age": "min_company_age_years",
    "max_company_age": "max_company_age_years", "min_psc_age": "min_psc_age", "max_psc_age": "max_psc_age",
    "min_psc_tenure": "min_psc_tenure_years", "max_psc_tenure": "max_psc_tenure_years",
    "strict_psc_tenure": "strict_psc_tenure", "format": "output_format", "max_results": "max_results",
}
REQUEST_FIELDS = set(SearchRequest.__dataclass_fields__)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="prospect", description="Find companies near a postcode (Spark).")
    p.add_argument("--prepared", help="folder of prepared Parquet tables")
    p.add_argument("--prepare-from", help="raw snapshot folder: prepare it into --prepared, then report quality")
    p.add_argument("--officers", help="Parquet officer appointments to prepare with --prepare-from")
    p.add_argument("--profile-from", help="raw snapshot folder: profile its sources")
    p.add_argument("--config", help="YAML file with 'defaults' and 'profiles'")
    p.add_argument("--profile", help="profile name from the configuration")
    p.add_argument("--list-profiles", action="store_true")
    p.add_argument("--list-categories", action="store_true")
    p.add_argument("--postcode", "-p")
    p.add_argument("--radius", "-r", type=float)
    p.add_argument("--sic", "-s", type=int, nargs="+")
    p.add_argument("--categories", "-c", nargs="+")
    p.add_argument("--status")
    p.add_argument("--min-company-age", type=int)
    p.add_argument("--max-company-age", type=int)
    p.add_argument("--min-psc-age", type=int)
    p.add_argument("--max-psc-age", type=int)
    p.add_argument("--min-psc-tenure", type=int)
    p.add_argument("--max-psc-tenure", type=int)
    p.add_argument("--strict-psc-tenure", action="store_true", default=None)
    p.add_argument("--format", "-f", choices=["csv"], help="output format (CSV folder)")
    p.add_argument("--output", "-o", help="output folder")
    p.add_argument("--max-results", type=int)
    p.add_argument("--as-of", help="date used for ages and tenures (default: today)")
    p.add_argument("--master", help="Spark master when not launched by spark-submit")
    return p


def load_config(path: str | None) -> dict:
    if not path:
        return {}
    import yaml

    with open(path) as fh:
        return yaml.safe_load(fh) or {}


def merge_parameters(config: dict, profile: str | None, args: argparse.Namespace) -> dict:
    """defaults <- profile <- given flags (later wins; not-given flags are skipped)."""
    params: dict = {}
    params.update({k: v for k, v in (config.get("defaults") or {}).items() if k in REQUEST_FIELDS})
    if profile:
        profiles = config.get("profiles") or {}
        if profile not in profiles:
            raise KeyError(f"Profile '{profile}' not found; available: {', '.join(profiles)}")
        params.update({k: v for k, v in profiles[profile].items() if k in REQUEST_FIELDS})
    for flag, field in FLAG_FIELDS.items():
        value = getattr(args, flag, None)
        if value is not None:
            params[field] = value
    for key in ("sic_codes", "account_categories"):
        if params.get(key) is not None:
            params[key] = tuple(params[key])
    if params.get("radius_miles") is not None:
        params["radius_miles"] = float(params["radius_miles"])
    return params


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    config = load_config(args.config)
    if args.list_categories:
        print("\n".join(VALID_CATEGORIES))
        return 0
    if args.list_profiles:
        for name, settings in (config.get("profiles") or {}).items():
            print(f"{name}: {settings.get('description', '')}")
        return 0
    if args.prepare_from:
        if not args.prepared:
            print("--prepared is required", file=sys.stderr)
            return 1
        return prepare(args, spark)
    if args.profile_from:
        return profile(args, spark)
    try:
        params = merge_parameters(config, args.profile, args)
    except KeyError as exc:
        print(exc.args[0], file=sys.stderr)
        return 1
    if params.get("postcode") is None or params.get("radius_miles") is None:
        print("Missing required parameters: postcode and radius (or use --profile)", file=sys.stderr)
        return 1
    if not args.prepared:
        print("--prepared is required", file=sys.stderr)
        return 1
    spark = spark or session(args, "prospect")
    from prospect.sources.tables import read_prepared

    from prospect.session import scratch_scope

    request = SearchRequest(**params)
    try:
        # Stage tables live only while the search and its export run.
        with scratch_scope(spark):
            _, count = find_companies(read_prepared(spark, args.prepared), request, args.as_of, args.output)
    except ValueError as exc:
        print(f"Invalid parameters: {exc}", file=sys.stderr)
        return 1
    if count == 0:
        print("No companies match the specified criteria", file=sys.stderr)
        return 1
    print(f"Found {count} companies" + (f"; written to {args.output}" if args.output else ""))
    return 0


def prepare(args: argparse.Namespace, spark=None) -> int:
    """Setup: newest raw snapshots -> prepared folder, then the quality report
    (one aggregate row per check, printed)."""
    spark = spark or session(args, "prospect-prepare")
    from prospect.plans.pipeline import parsed_once, prepare_all, quality_report, raw_sources_from_folder
    from prospect.session import scratch_scope
    from prospect.sources.readers import path_exists

    if args.officers and not path_exists(spark, args.officers):
        print(f"No officers at {args.officers}", file=sys.stderr)
        return 1
    if not args.officers:
        print("No officers given: tenure searches will find nothing (see --officers)", file=sys.stderr)
    with scratch_scope(spark):
        raw = parsed_once(raw_sources_from_folder(spark, args.prepare_from, args.officers))
        tables = prepare_all(spark, raw, args.prepared, args.as_of)
        show(quality_report(raw, tables))
    return 0


def profile(args: argparse.Namespace, spark=None) -> int:
    """Profile the newest raw snapshots (printed)."""
    spark = spark or session(args, "prospect-profile")
    from prospect.plans.pipeline import parsed_once, profile_report, raw_sources_from_folder
    from prospect.session import scratch_scope

    with scratch_scope(spark):
        show(profile_report(parsed_once(raw_sources_from_folder(spark, args.profile_from))))
    return 0


def session(args: argparse.Namespace, name: str):
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.appName(name)
    if args.master:
        builder = builder.master(args.master)
    return builder.getOrCreate()


def show(reports) -> None:
    for name, df in reports.items():
        for row in df.collect():  # aggregates, top lists and samples of a few rows
            print(f"{name}: {row.asDict()}")


if __name__ == "__main__":
    sys.exit(main())
