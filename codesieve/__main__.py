"""python -m codesieve PATH..."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import PySparkException

from .api import lint_path
from .operators import report
from .plans.lint import Config
from .session import get_spark, stash


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("codesieve", description="Static analysis of Python sources on Spark")
    p.add_argument("paths", nargs="*")
    p.add_argument("-e", "-E", "--errors-only", action="store_true")
    p.add_argument("-f", "--output-format", default="text", help="text, json, parseable, summary-json, quiet or standard")
    p.add_argument("-j", "--jobs", type=int, default=0, help="executor threads in local mode; 0: all")
    p.add_argument("--rcfile")
    p.add_argument("--enable")
    p.add_argument("--disable")
    p.add_argument("--colour", action="store_true")
    p.add_argument("-v", "--verbose", action="store_true")
    a = p.parse_args(argv)
    if not a.paths:
        p.print_usage(sys.stderr)
        return report.exit_status([])
    config = (Config.from_file(a.rcfile) if a.rcfile else Config.from_default_places()).with_options(a.enable, a.disable, a.errors_only, a.output_format, a.jobs, a.verbose)
    spark = get_spark(f"local[{a.jobs or '*'}]")
    spark.sparkContext.setLogLevel("ERROR")
    formats = {"quiet": report.quiet_report, "standard": report.standard_report, "summary-json": report.json_summary_report}
    outcomes: list[int | bool | None] = []
    for path in a.paths:
        try:
            issues = stash(lint_path(spark, path, config.ignore_patterns, enable=config.enabled_checkers, disable=config.disabled_checkers, errors_only=config.errors_only), "issues")
            lines = formats[a.output_format](issues) if a.output_format in formats else report.report(issues, a.output_format, a.colour)
            for r in lines.toLocalIterator():
                print(r["text"])
            outcomes.append(not issues.isEmpty())
        except (FileNotFoundError, PySparkException) as e:  # among the latter a file that isn't UTF-8
            print(f"Error: {str(e).splitlines()[0]}", file=sys.stderr)
            outcomes.append(None)
    return report.exit_status(outcomes)


if __name__ == "__main__":
    sys.exit(main())
