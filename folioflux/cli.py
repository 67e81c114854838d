"""Command line: process (images and recorded lines to a workbook) and evaluate (truth and predictions, or truth, images
and recorded lines, to reports)."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from folioflux.plans import pipeline as P
from folioflux.sources import catalogs as C
from folioflux.sources import images as I


JOB = ("images", "centers", "specialties", "given-names", "surnames", "lines")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="folioflux", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("process")
    for name in JOB + ("output",):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--places")
    p.add_argument("--diagnostics")
    p.add_argument("--limit", type=int)
    p.add_argument("--mode", default="auto", choices=P.MODES)
    p.add_argument("--force", action="store_true")
    e = sub.add_parser("evaluate")
    e.add_argument("--expected", required=True)
    for name in ("predicted", "places", "output", *JOB):  # predictions, or all that a job needs
        e.add_argument(f"--{name}")
    e.add_argument("--mode", default="auto", choices=P.MODES)
    e.add_argument("--validate-only", action="store_true")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "process" and os.path.exists(args.output) and not args.force:
        raise FileExistsError(args.output)  # before any work
    spark = spark or SparkSession.builder.appName("folioflux").getOrCreate()
    if args.command == "process":
        config = P.Config(args.images, args.centers, args.specialties, args.given_names, args.surnames, args.places, args.output, mode=args.mode, limit=args.limit, force=args.force)
        result = P.run(spark, config, lines=spark.read.parquet(args.lines))
        names = sorted({a.name for a in C.read_specialties(spark, args.specialties)})
        P.export(result, args.output, names, args.force)
        if args.diagnostics:
            P.diagnose(result, args.diagnostics)
        print(f"{result.people.count()} people, {result.errors.count()} pages with errors: {args.output}")
        return 0
    expected = I.read_truth(spark, args.expected)
    errors = P.E.truth_errors(expected).unionByName(I.encoding_errors(spark, args.expected)).orderBy("stem", "row_no").limit(200).collect()
    for r in errors:
        print(f"{r['stem']}:{r['row_no']}: {r['error']}")
    if errors or args.validate_only:
        return int(bool(errors))
    if args.predicted:
        found = P.evaluate(expected, I.read_truth(spark, args.predicted), args.output)
    else:
        missing = [f"--{name}" for name in JOB if not getattr(args, name.replace("-", "_"))]
        if missing:
            raise SystemExit(f"evaluate needs --predicted or {', '.join(missing)}")
        config = P.Config(args.images, args.centers, args.specialties, args.given_names, args.surnames, args.places, args.output, mode=args.mode)
        found = P.evaluate_images(spark, config, args.expected, lines=spark.read.parquet(args.lines), folder=args.output)
        found["faltantes"].show(truncate=False)
    found["casos"].show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
