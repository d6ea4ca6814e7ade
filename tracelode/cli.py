"""Command line: scans a string, a file, a directory or standard input and prints findings.

python -m tracelode.cli [-t CATEGORIES] [-a] [-m CERTAINTY] [-g decode|encode|both] [-p FORMAT] [-v1 V] [-v2 V] [-v3 V] STRING
or with -f FILE, -d DIRECTORY [-r] [-fp GLOB], -s (standard input), -l (list of detectors), --version.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.operators import codecs, packed, report
from tracelode.operators.scan import scan
from tracelode.operators.validators import validate
from tracelode.plans.catalogue import CATEGORIES, DEFAULT
from tracelode.sources import readers

VERSION = "1.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracelode", description="finds typed artefacts in text and binary data")
    p.add_argument("string", nargs="?", help="text to scan")
    p.add_argument("-t", dest="filters", metavar="CATEGORIES", help=f"comma-separated, of {', '.join(CATEGORIES)}")
    p.add_argument("-a", "-analyze", dest="details", action="store_true", help="type, place and certainty with each finding")
    p.add_argument("-v", "-verbose", dest="verbose", action="store_true", help="counts on standard error")
    p.add_argument("-m", "-minimum-certainty", dest="min_certainty", type=int, default=0, help="0 to 100")
    p.add_argument("-p", "--preprocessor", dest="preprocessor", help="struct format of packed records")
    p.add_argument("-g", "-generator", dest="generator", choices=["decode", "encode", "both"], help="scan what codecs make of the data")
    for i in (1, 2, 3):
        p.add_argument(f"-v{i}", f"-validator{i}", dest=f"validator{i}", help="all:CLASS, has:CLASS or search:PATTERN")
    p.add_argument("-r", "-recursive", dest="recursive", action="store_true", help="directories within the directory too")
    p.add_argument("-f", "-file", dest="filename", help="a file")
    p.add_argument("-d", "-directory", dest="directory", help="a directory")
    p.add_argument("-fp", "-file-pattern", dest="file_pattern", default="*", help="glob on file names")
    p.add_argument("-l", "-list", dest="list", action="store_true", help="lists the detectors")
    p.add_argument("-s", "-stdin", dest="stdin", action="store_true", help="lines of standard input, each on its own")
    p.add_argument("-ver", "--version", action="version", version=f"tracelode {VERSION}")
    return p


def _files(args: argparse.Namespace) -> tuple[str, str, bool] | None:
    """Path, glob and whether to go down into folders; None if no files are named."""
    if args.filename:
        return args.filename, "*", False
    if args.directory or args.recursive:
        return args.directory or ".", args.file_pattern, args.recursive
    return None


def _cells(spark: SparkSession, args: argparse.Namespace, stdin: Sequence[str] | None) -> DataFrame | None:
    """The string, or the lines of standard input, unpacked if asked for."""
    if args.string is not None:
        data = readers.strings(spark, [args.string])
    elif args.stdin:
        data = readers.strings(spark, list(stdin if stdin is not None else sys.stdin))
    else:
        return None
    if args.preprocessor:
        data = packed.preprocess(data.withColumn("content", F.encode("text", "ISO-8859-1")), args.preprocessor)
    return data.withColumn("last", F.lit(True))


def findings(spark: SparkSession, args: argparse.Namespace, stdin: Sequence[str] | None = None) -> DataFrame | None:
    """The findings that the arguments ask for, with a column `line`; None if they name no source."""
    options = {"filters": tuple(args.filters.split(",")) if args.filters else DEFAULT, "min_certainty": args.min_certainty}
    files, data = _files(args) if args.string is None else None, None
    if files is None:
        data = _cells(spark, args, stdin)
        if data is None:
            return None
    elif args.preprocessor:
        data = packed.file_records(spark, files[0], args.preprocessor, files[1], files[2])
    if args.generator and data is None:
        found = codecs.scan_files(spark, *files, mode=args.generator, **options)
    elif args.generator:
        found = codecs.scan_generated(data, ids=["source"], mode=args.generator, **options)
    else:
        found = scan(data if data is not None else readers.directory(spark, *files), ids=["source"], base_offset="base_offset", last="last", **options)
    found = report.displayed(found, args.details)
    if args.generator:
        found = found.withColumn("line", F.concat(F.lit("after "), "direction", F.lit(" "), "codec", F.lit(": "), "line"))
    return validate(found, [v for v in (args.validator1, args.validator2, args.validator3) if v])


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    if not (args.list or args.string is not None or args.filename or args.directory or args.recursive or args.stdin):
        p.print_help()
        return 0
    spark = spark or SparkSession.builder.appName("tracelode").config("spark.ui.enabled", "false").getOrCreate()
    if args.list:
        for r in report.catalogue(spark).orderBy("detector_seq").toLocalIterator():
            print(f"{', '.join(r.types)}: {r.about} [{', '.join(r.categories)}]")
        return 0
    found = findings(spark, args)
    last = None
    for r in found.orderBy("source", "detector_seq", "location", "match_seq").toLocalIterator():
        if r.source != last and (args.directory or args.recursive):
            print(f"== file: {r.source}")
        last = r.source
        print(r.line)
    if args.verbose:
        print(f"{found.count()} findings", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
