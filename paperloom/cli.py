"""Command line: python -m paperloom.cli translate|meta|edit|detect INPUT OUTPUT [options]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("command", choices=["translate", "meta", "edit", "detect"])
    parser.add_argument("input", help="folder or file of documents")
    parser.add_argument("output", help="folder to write")
    parser.add_argument("--diff", help="JSON lines of file_id, diff (for edit)")
    args = parser.parse_args(argv)
    from .operators import edit, html
    from .sources import decode, detect, files

    spark = SparkSession.builder.getOrCreate()
    found = files.from_disk(spark, args.input)
    if args.command == "translate":
        html.html_views(found).write.mode("overwrite").parquet(args.output)
    elif args.command == "meta":
        decode.meta_json(decode.meta(found)).write.mode("overwrite").json(args.output)
    elif args.command == "detect":
        detect.detect(found).write.mode("overwrite").json(args.output)
    else:
        diffs = spark.read.schema("file_id long, diff string").json(args.diff)
        edit.save_documents(found, diffs).write.mode("overwrite").parquet(args.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
