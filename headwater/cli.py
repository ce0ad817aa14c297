"""Command line: `python -m headwater.cli fit PEAKS.csv`, `regime DAILY.parquet`, `query NAME SF_DIR`, `list`."""

from __future__ import annotations

import argparse

from headwater.plans import catalog
from headwater.session import session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="headwater")
    commands = parser.add_subparsers(dest="command", required=True)
    fit = commands.add_parser("fit", help="frequency fit of each site's annual peaks")
    fit.add_argument("path")
    fit.add_argument("--regional-skew", type=float)
    fit.add_argument("--regional-mse", type=float)
    regime = commands.add_parser("regime", help="annual flow-regime metrics of each site")
    regime.add_argument("path")
    regime.add_argument("--min-days", type=int, default=350)
    query = commands.add_parser("query", help="a registered query over a folder of tables")
    query.add_argument("name", choices=sorted(catalog.queries()))
    query.add_argument("sf_dir")
    commands.add_parser("list", help="the registered queries")
    args = parser.parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(catalog.queries())))
        return 0
    spark = session("headwater-cli")
    if args.command == "fit":
        from headwater.operators.frequency import fit_peaks
        from headwater.sources.readers import PEAKS, read_flow

        df = fit_peaks(read_flow(spark, args.path, PEAKS), regional_skew=args.regional_skew, regional_mse=args.regional_mse)
    elif args.command == "regime":
        from headwater.operators.regime import flashiness
        from headwater.sources.readers import read_flow

        df = flashiness(read_flow(spark, args.path), min_days=args.min_days)
    else:
        df = catalog.queries()[args.name](spark, args.sf_dir)
    df.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
