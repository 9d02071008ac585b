"""Lint as files arrive: a file stream through the batch planner, micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.text import is_python
from ..plans.lint import lint
from ..sources.scan import is_ignored

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def source_stream(spark: SparkSession, folder: str, ignore: Iterable[str] = ()) -> DataFrame:
    """(file, source, modified) of Python files as they come into a folder."""
    files = spark.readStream.format("binaryFile").schema(_BINARY).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{py,pyi}").load(folder)
    files = files.where((F.col("length") > 0) & is_python(F.col("path")) & ~is_ignored(F.col("path"), ignore))
    return files.select(F.col("path").alias("file"), F.try_validate_utf8(F.col("content").cast("string")).alias("source"), F.col("modificationTime").alias("modified")).where("source IS NOT NULL")


def lint_stream(stream: DataFrame, out: str, checkpoint: str, enable: str | None = None, disable: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Writes each micro-batch's issues as Parquet under out/batch=N; a batch that is run again replaces its folder, so each file's issues are there once."""

    def write(batch: DataFrame, number: int) -> None:
        lint(batch.select("file", "source"), enable, disable).drop("seq").write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def counts_by_window(issues: DataFrame, time_col: str = "modified", length: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Issues by severity and time window, for a stream of issues with a time; later than late is left out."""
    return issues.withWatermark(time_col, late).groupBy(F.window(time_col, length), "severity").agg(F.count("*").alias("n"))
