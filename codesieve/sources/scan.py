"""Sources: files, folders and tables -> (file, source)."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import has_component, is_python
from ..session import ship

SKIPPED = ["__pycache__", ".git", ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache"]


def is_ignored(path: Column, patterns: Iterable[str] = ()) -> Column:
    """A path that contains one of the patterns, or has a skipped folder among its components."""
    result = has_component(path, SKIPPED)
    for p in patterns:
        result = result | path.contains(p)
    return result


def from_table(df: DataFrame, file_col: str, text_col: str) -> DataFrame:
    """Any table with a text column. Other columns are dropped; a null name becomes empty, a null text has no issues."""
    return df.select(F.coalesce(F.col(file_col).cast("string"), F.lit("")).alias("file"), F.col(text_col).cast("string").alias("source"))


def _local(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _read(spark: SparkSession, path: str, recursive: bool, glob: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def _named(df: DataFrame, root: str, full: str) -> DataFrame:
    """Paths as they were asked for, not as the file system spells them."""
    return df.withColumn("path", F.concat(F.lit(root.rstrip("/")), F.substring(F.col("path"), F.lit(len(full.rstrip("/")) + 1), F.length("path"))))


def from_path(spark: SparkSession, path: str, ignore: Iterable[str] = (), recursive: bool = True, extensions: tuple[str, ...] = ("py", "pyi"), strict: bool = True, skip: bool = True) -> DataFrame:
    """(file, source) of a file, or of a folder's Python files that aren't ignored; a path that isn't there raises FileNotFoundError.

    A file that is named is read whatever it is called; skip=False ignores nothing. Empty files are left out. Text that isn't UTF-8 fails the query if strict, and leaves its file out
    otherwise.
    """
    system, at = _local(spark, path)
    if not system.exists(at):
        raise FileNotFoundError(f"Path does not exist: {path}")
    status = system.getFileStatus(at)
    full = status.getPath().toString()
    if status.isDirectory():
        files = _named(_read(spark, path, recursive, "*.{" + ",".join(extensions) + "}" if len(extensions) > 1 else f"*.{extensions[0]}"), path, full)
        files = files.where(is_python(F.col("path")))
        files = files.where(~is_ignored(F.col("path"), ignore)) if skip else files
    else:
        files = _named(_read(spark, path, False, None), path, full)
    files = files.where("length > 0")
    text = F.validate_utf8(F.col("content").cast("string")) if strict else F.try_validate_utf8(F.col("content").cast("string"))
    return files.select(F.col("path").alias("file"), text.alias("source")).where("source IS NOT NULL")


def _open_modules(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        files, texts = [], []
        for path in b.column("path").to_pylist():
            system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path if path.startswith("/") else f"{folder}/{path}")
            if system.get_file_info(at).type == fs.FileType.File:
                with system.open_input_stream(at) as f:
                    data = f.read()
                files.append(path)
                try:
                    texts.append(data.decode())
                except UnicodeDecodeError:
                    texts.append(None)
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(texts, pa.string())], names=["file", "source"])


def existing(paths: DataFrame) -> DataFrame:
    """(file, source) of the paths (path) that are files, read by executors; a text that isn't UTF-8 is null. Relative paths start at the driver's folder."""
    ship(paths.sparkSession)
    folder = os.getcwd()
    return paths.select("path").mapInArrow(lambda b: _open_modules(folder, b), "file string, source string")
