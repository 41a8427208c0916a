"""Clean a table from the command line: python -m millrace.cli -i in.csv -o out.csv."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from millrace.plans.pipeline import Prep
from millrace.sources.tables import format_of, read_table, write_table


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="millrace", description="Detect data problems, clean a table and report")
    p.add_argument("--input", "-i", required=True, help="table to read (csv, parquet, json, orc)")
    p.add_argument("--output", "-o", help="table to write")
    p.add_argument("--report", "-r", help="report to write (.html or .json)")
    p.add_argument("--task", choices=["classification", "regression"])
    p.add_argument("--target", help="target column")
    p.add_argument("--config", "-c", help="settings (.yaml or .json)")
    p.add_argument("--no-plots", action="store_true")
    p.add_argument("--detect-only", action="store_true")
    p.add_argument("--single-file", action="store_true", help="write one part file")
    p.add_argument("--verbose", "-v", action="store_true")
    given = p.parse_args(args)
    try:
        format_of(given.input)
        if not given.detect_only:
            if not given.output:
                raise ValueError("--output is needed")
            format_of(given.output)
        spark = SparkSession.builder.appName("millrace").getOrCreate()
        prep = Prep(read_table(spark, given.input), config_path=given.config)
        found = prep.detect(given.target)
        print(f"columns with missing values: {len(found['missing_values'])}; outlying rows: {found['outliers'].get('outlier_count', 0)}")
        if given.target and "class_imbalance" in found:
            print(f"imbalanced: {found['class_imbalance'].get('is_imbalanced')}")
        if not given.detect_only:
            cleaned, _ = prep.clean(given.task, given.target)
            write_table(cleaned, given.output, given.single_file)
        if given.report:
            prep.save_report(given.report, include_plots=not given.no_plots)
    except Exception as error:
        if given.verbose:
            raise
        print(f"Error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
