"""Command line: `python -m veilwright anonymize ...` and `python -m veilwright seed-demo ...`."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys

from pyspark.sql import SparkSession

from .errors import AnonymizeError
from .plans.report import Report
from .plans.resume import PAGES
from .plans.runner import Run, RunOptions
from .sources.dataset import Catalog, Folder
from .sources.files import read_bounded, read_seed
from .sources.fixtures import seed as seed_demo


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="veilwright")
    commands = top.add_subparsers(dest="command", required=True)
    run = commands.add_parser("anonymize", help="apply a policy to a dataset")
    run.add_argument("--policy", required=True, help="policy document, JSON")
    run.add_argument("--seed-file", help="at least 32 raw bytes; without it the run draws its own seed")
    run.add_argument("--run-uid", required=True)
    run.add_argument("--reference-time", required=True, help="ISO date or time, UTC")
    run.add_argument("--input", help="folder of <database>/<table>; without it, the session catalog")
    run.add_argument("--format", default="parquet")
    run.add_argument("--overlays", help="JSON: database -> table -> keys, lengths, uniqueness")
    run.add_argument("--output", required=True)
    run.add_argument("--steps-dir")
    run.add_argument("--constants-dir")
    run.add_argument("--workers", type=int, default=4)
    run.add_argument("--page-size", type=int)
    run.add_argument("--chunks", type=int, help="without it, as many as --pages pages make")
    run.add_argument("--pages", type=int, default=PAGES, help="pages of one chunk")
    run.add_argument("--chunk-by", choices=("key", "files"))
    run.add_argument("--allow-keyless", action="store_true")
    run.add_argument("--checksums", action="store_true", help="record the checksum of what each chunk writes")
    run.add_argument("--dry-run", action="store_true")
    run.add_argument("--report", help="file for the one-line report")
    demo = commands.add_parser("seed-demo", help="write the demo dataset once")
    demo.add_argument("--output", required=True)
    demo.add_argument("--scale", type=int, default=1)
    return top


def _anonymize(spark: SparkSession, args: argparse.Namespace) -> Report:
    try:
        policy = read_bounded(args.policy, (1 << 20) + 1)
        seed = read_seed(args.seed_file) if args.seed_file else None
        overlays = json.loads(read_bounded(args.overlays)) if args.overlays else None
    except AnonymizeError as error:
        return Report("error", error.failure_class, error.message)
    except ValueError:
        return Report("error", "policy", "overlays must be one JSON document")
    dataset = Folder(spark, args.input, args.format, overlays) if args.input else Catalog(spark, overlays)
    options = RunOptions(
        args.run_uid, seed, dt.datetime.fromisoformat(args.reference_time), args.output, workers=args.workers,
        page_size=args.page_size, chunks=args.chunks, pages=args.pages, chunk_by=args.chunk_by, dry_run=args.dry_run,
        steps_dir=args.steps_dir, constants_dir=args.constants_dir, allow_keyless=args.allow_keyless, checksums=args.checksums,
        progress=lambda line: print(json.dumps(line), file=sys.stderr),
    )
    return Run(spark, policy, dataset, options).execute()


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("veilwright").getOrCreate()
    if args.command == "seed-demo":
        try:
            present = seed_demo(spark, args.output, args.scale)
        except AnonymizeError as error:
            print(error.message, file=sys.stderr)
            return 1
        print("demo dataset already present" if present else "demo dataset written")
        return 0
    report = _anonymize(spark, args)
    line = report.to_json()
    print(line)
    if args.report:
        with open(args.report, "w", encoding="utf-8") as handle:
            handle.write(line + "\n")
    return report.exit_code()


if __name__ == "__main__":
    sys.exit(main())
