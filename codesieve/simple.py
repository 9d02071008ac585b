"""python -m codesieve.simple PATH: one path, results as lines, as JSON or as a number."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.errors import PySparkException

from .api import LintError, lint_directory, lint_file
from .operators import report
from .session import get_spark, stash

VERSION = "0.1.0"


def main(argv: list[str] | None = None) -> int:
    """1 if there are issues or the path fails, 130 if interrupted."""
    p = argparse.ArgumentParser("codesieve.simple", description="Static analysis of a Python file or folder on Spark")
    p.add_argument("path")
    p.add_argument("--json", action="store_true", help="one JSON object with the issues and their summary")
    p.add_argument("--no-recursive", action="store_true", help="the folder's own files only")
    p.add_argument("-q", "--quiet", action="store_true", help="the number of issues only")
    p.add_argument("-E", "--errors-only", action="store_true")
    p.add_argument("--disable")
    p.add_argument("--enable")
    p.add_argument("-v", "--version", action="version", version=f"%(prog)s {VERSION}")
    a = p.parse_args(argv)
    path = Path(a.path)
    if not path.is_file() and not path.is_dir():
        print(f"Error: {path} is not a valid file or directory", file=sys.stderr)
        return 1
    try:
        spark = get_spark()
        spark.sparkContext.setLogLevel("ERROR")
        options = {"errors_only": a.errors_only, "disable": a.disable, "enable": a.enable}
        issues = stash(lint_file(spark, a.path, **options) if path.is_file() else lint_directory(spark, a.path, not a.no_recursive, **options), "issues")
        lines = report.json_summary_report(issues) if a.json else report.quiet_report(issues) if a.quiet else report.standard_report(issues)
        for r in lines.toLocalIterator():
            print(r["text"])
        return int(not issues.isEmpty())
    except (LintError, PySparkException) as e:
        print(f"Error: {str(e).splitlines()[0]}", file=sys.stderr)
        return 1
    except KeyboardInterrupt:
        print("\nInterrupted", file=sys.stderr)
        return 130


if __name__ == "__main__":
    sys.exit(main())
