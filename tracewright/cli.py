"""python -m tracewright.cli convert|info|storage: the engine from a shell."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .operators.formats import FORMATS
from .plans import adapters, engine
from .sources import storage


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tracewright", description="Agent traces to training records.")
    what = top.add_subparsers(dest="what", required=True)
    c = what.add_parser("convert", help="read records, write training records")
    c.add_argument("source")
    c.add_argument("input", help="a path, a URI, or - for the standard input")
    c.add_argument("-f", "--format", default="openai_chat", choices=FORMATS)
    c.add_argument("-o", "--output", default="-", help="a path, a URI, or - for the standard output")
    c.add_argument("--compression", default="infer", choices=("infer", "none", "gzip"))
    c.add_argument("--append", action="store_true")
    c.add_argument("--parts", action="store_true", help="a folder of part files instead of one file")
    c.add_argument("--skip-invalid", action="store_true")
    c.add_argument("--dataset", default="default")
    c.add_argument("--batch-size", type=int, default=1000)
    c.add_argument("--metadata", action="append", default=[], metavar="K=V")
    what.add_parser("info", help="formats, sources and schemes")
    s = what.add_parser("storage", help="what is known of a place")
    s.add_argument("check", choices=["check"])
    s.add_argument("uri")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.what == "convert":
            source, metadata = adapters.source_name(args.source), storage.key_values(args.metadata)
        spark = spark or SparkSession.builder.appName("tracewright").getOrCreate()
        if args.what == "info":
            for row in engine.info(spark).toLocalIterator():
                print(f"{row['kind']}\t{row['name']}")
        elif args.what == "storage":
            print(json.dumps(storage.check(spark, args.uri)))
        else:
            out = engine.convert(spark, args.input, source, args.format, args.skip_invalid, messages_only=True)
            if args.output == "-":
                n = storage.stdout(out)
            else:
                n = storage.write_jsonl(out, args.output, "a" if args.append else "w", args.compression, not args.parts, args.batch_size, args.dataset, args.format, metadata).records_written
            print(f"{n} records", file=sys.stderr)
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
