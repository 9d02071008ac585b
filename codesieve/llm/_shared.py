"""What the operators of this subpackage share: the shared folder, text slices, ranks."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of most contracts: runs of what isn't one of these six characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python worker turns into words at once.
SLICE_BYTES = 2 << 20
#: Rows in an Arrow batch where the session doesn't say: texts are long, and a batch is held by the JVM and by Python.
BATCH_ROWS = 2000
_ROOT = str(Path(__file__).resolve().parents[2])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none one is made, in local mode (tests) only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = current.get() if current.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith(("local[", "local ")) and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="codesieve-")
        atexit.register(shutil.rmtree, named, True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Every path that shared_path() has given out, in order.
_given: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    _given.append(f"{shared_dir(spark)}/codesieve-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}")
    return _given[-1]


def mark() -> int:
    """For sweep(): what has been written into the shared folder so far."""
    return len(_given)


def sweep(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Removes what was written since then, but for these tables: they must be all that is read later."""
    kept = {t._stashed_at for t in keep}
    for path in _given[since:]:
        if path not in kept:
            _remove(spark, path)
    _given[since:] = sorted(kept)


def stash(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes a table into the shared folder and reads it again: the lineage ends there, and a lost executor costs nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    stashed = df.sparkSession.read.schema(df.schema).parquet(path)
    stashed._stashed_at = path
    return stashed


def again(table: DataFrame) -> DataFrame:
    """A table that stash() returned, read once more: for joins of what comes from it with itself."""
    return table.sparkSession.read.schema(table.schema).parquet(table._stashed_at)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def unstash(*tables: DataFrame) -> None:
    """Removes tables that stash() returned and that nothing reads any more."""
    for t in tables:
        _remove(t.sparkSession, t._stashed_at)


def clear(spark: SparkSession) -> None:
    """Removes what this application wrote into the shared folder; results that weren't written elsewhere can't be read after it."""
    for t in spark.catalog.listTables():
        if t.name.startswith("codesieve_chunks_"):
            spark.sql(f"DROP TABLE {t.name}")
    _remove(spark, f"{shared_dir(spark)}/codesieve-{spark.sparkContext.applicationId}")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, each with as many underscores as it takes to be none of df's columns."""
    have, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        found.append(name)
    return found


def column(name: str) -> Column:
    """A top-level column, whatever signs are in its name."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole(df: DataFrame) -> Column:
    """All of a row's columns in one, 'row': no other column can clash with those of the caller. select("row.*") gives them back."""
    return F.struct(*[column(c) for c in df.columns]).alias("row")


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package when the driver found it by its path only, and keeps Arrow batches of texts small.

    The batch size stays set for the session, since results are computed later; a session that sets one itself keeps it.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(rows)) > BATCH_ROWS and spark.sparkContext.getConf().get(rows) is None:
        spark.conf.set(rows, BATCH_ROWS)
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in have and not any("site-packages" in p and p == _ROOT for p in sys.path):
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *have])


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with at most limit bytes of text each; a longer text is a part of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes.astype(np.int64)), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def give_back() -> None:
    """At the end of a task: an idle Python worker keeps no memory that it has freed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def out(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v.cast(f.type) if isinstance(v := columns[f.name], pa.Array) else pa.array(v, f.type) for f in schema], schema=schema)


def with_rank(df: DataFrame, *order, name: str) -> DataFrame:
    """Adds each row's place (from 0) in the global order: a range-partitioned sort, then one count a partition goes to the driver."""
    mask = (1 << 33) - 1
    placed = stash(df.orderBy(*order).select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit(mask)).alias("__in")), name)
    counts = {r["__part"]: r["n"] for r in placed.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    before, starts = 0, []
    for part in range(max(counts, default=-1) + 1):
        starts.append(before)
        before += counts.get(part, 0)
    at = F.element_at(F.array(*map(F.lit, starts or [0])), F.col("__part") + 1)
    return placed.withColumn(name, (at + F.col("__in")).cast("long")).drop("__part", "__in")
