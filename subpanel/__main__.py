"""Run all stages over a folder of CSV extracts: spark-submit -m or python -m subpanel --data DIR --out DIR"""

from __future__ import annotations

import argparse
import json
from datetime import date

from subpanel.operators.params import ClusterParams, OfferParams, RiskParams
from subpanel.plans.stages import Stages
from subpanel.schemas import LATEST_MONTH, SOURCE_COLUMNS
from subpanel.session import build_session
from subpanel.sources.files import months_found, read_extracts


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="subpanel", description=__doc__)
    p.add_argument("--data", required=True, help="folder with one subfolder per source (N1, N2, ...)")
    p.add_argument("--out", required=True, help="folder for stage tables, exports and serving views")
    p.add_argument("--months", nargs="*", help="months YYYYMM to read, default all found")
    p.add_argument("--latest", help="month of the offers, default the last month read")
    p.add_argument("--on-error", choices=["skip", "fail"], default="fail", help="what to do with unreadable files")
    p.add_argument("--params", help="JSON file with objects `offers`, `risk` and `clusters`")
    p.add_argument("--day", default=str(date.today()), help="date written into the serving tables")
    p.add_argument("--buckets", type=int, default=8, help="files by subscriber per stage table")
    for source in SOURCE_COLUMNS:
        p.add_argument(f"--{source}", nargs="*", metavar="FILE", help=f"explicit files of {source}")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    args = parse(argv)
    settings = {}
    if args.params:
        with open(args.params, encoding="utf-8") as f:
            settings = json.load(f)
    spark = build_session()
    chosen = {s: getattr(args, s) for s in SOURCE_COLUMNS if getattr(args, s)}
    latest = args.latest or max(args.months or months_found(spark, args.data, "N10"), default=LATEST_MONTH)
    run = Stages(spark, lambda: read_extracts(spark, args.data, args.months, chosen, args.on_error), f"{args.out}/stages",
                 month=latest, offer_params=OfferParams(**settings.get("offers", {})),
                 risk_params=RiskParams(**settings.get("risk", {})),
                 cluster_params=ClusterParams(**settings.get("clusters", {})), day=args.day,
                 buckets=args.buckets)
    run.run()
    run.export(f"{args.out}/export")
    run.publish(f"{args.out}/serving")


if __name__ == "__main__":
    main()
