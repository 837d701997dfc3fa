"""Command line: ``python -m gridwright.cli FILE [--output DIR] [--config FILE] [--sqlite-db FILE] [--verbose]``."""

from __future__ import annotations

import argparse
import logging
import sys
from pathlib import Path

from gridwright.config import load_settings


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gridwright", description="Extract clean, traceable records from a messy workbook or delimited file.")
    parser.add_argument("file")
    parser.add_argument("--output", default="output", help="folder for the run's own folder")
    parser.add_argument("--config", help="YAML file of settings")
    parser.add_argument("--sqlite-db", help="also append the records to this SQLite file")
    parser.add_argument("--master", help="Spark master; the environment's if left out")
    parser.add_argument("--verbose", action="store_true")
    a = parser.parse_args(args)
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.INFO, format="%(levelname)s %(name)s: %(message)s")
    settings = load_settings(a.config)
    if "://" not in a.file:
        if not Path(a.file).exists():
            print(f"No such file: {a.file}", file=sys.stderr)
            return 1
        if Path(a.file).stat().st_size > settings.max_file_size_mb * 1024 * 1024:
            print(f"File exceeds the limit of {settings.max_file_size_mb} MB", file=sys.stderr)
            return 1
    from pyspark.sql import SparkSession

    from gridwright.plans import pipeline

    builder = SparkSession.builder.appName("gridwright")
    spark = (builder.master(a.master) if a.master else builder).getOrCreate()
    x, folder = pipeline.run(spark, a.file, a.output, settings, sqlite_path=a.sqlite_db)
    print(f"{x.records.count()} records from {len(x.profiles)} sheets; files in {folder}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
