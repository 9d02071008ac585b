"""lint_file and lint_directory, and what the command line does with their results."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from .plans.lint import lint
from .sources.scan import existing, from_path


class LintError(RuntimeError):
    pass


def lint_path(spark: SparkSession, path: str, ignore: Iterable[str] = (), **options) -> DataFrame:
    """A file, or a folder with everything below it that isn't ignored; FileNotFoundError for a path that isn't there. Imported modules are looked for on disk."""
    return lint(from_path(spark, path, ignore), lookup=existing, **options)


def lint_file(spark: SparkSession, path: str, errors_only: bool = False, disable: str | Iterable[str] | None = None, enable: str | Iterable[str] | None = None) -> DataFrame:
    return lint(from_path(spark, path), enable, disable, errors_only, lookup=existing)


def lint_directory(spark: SparkSession, folder: str, recursive: bool = True, errors_only: bool = False, disable: str | Iterable[str] | None = None, enable: str | Iterable[str] | None = None) -> DataFrame:
    """All .py files of a folder, none ignored; files that aren't UTF-8 are skipped."""
    system = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not system.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(system).isDirectory():
        raise LintError(f"not a directory: {folder}")
    return lint(from_path(spark, folder, recursive=recursive, extensions=("py",), strict=False, skip=False), enable, disable, errors_only, lookup=existing)
