"""Sources -> events: each text is parsed once, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.udtf import UserDefinedTableFunction

from ..session import ship
from .walker import DDL, KINDS, Walker, quiet

#: Rows that a Python worker turns into one batch of events.
ROWS = 20_000


def _schema() -> pa.Schema:
    names = T._parse_datatype_string(DDL)
    return to_arrow_schema(names)


def _walk(wanted: frozenset[str], sparse: bool, needs: tuple | None, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    files: list[str] = []
    events: list[tuple] = []
    walk = Walker(wanted, sparse, needs).run

    def batch() -> pa.RecordBatch:
        columns = [pa.nulls(len(c), f.type) if c.count(None) == len(c) else pa.array(c, f.type) for c, f in zip([files, *zip(*events)], schema)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def fill(rows: Iterator[tuple[str, str]]) -> bool:
        """Whether there is a batch before the rows end."""
        with quiet():
            for file, source in rows:
                found = walk(source or "")
                if found:
                    files.extend([file] * len(found))
                    events.extend(found)
                    if len(events) >= ROWS:
                        return True
        return False

    for b in batches:
        rows = zip(b.column("file").to_pylist(), b.column("source").to_pylist())
        while fill(rows):
            yield batch()
            files.clear()
            events.clear()
    if events:
        yield batch()


def events(sources: DataFrame, kinds: Iterable[str] = KINDS, sparse: bool = False, needs: tuple | None = None) -> DataFrame:
    """The event table of sources (file, source): one row for each event of the wanted kinds, in the order of seq within a file.

    The first event of each file is 'module'. A text that can't be parsed gives one more, 'syntax'; a null or empty text none. sparse leaves out
    the events that no rule can make an issue of, and with needs those of texts without the words for any.
    """
    ship(sources.sparkSession)
    wanted, schema = frozenset(kinds), _schema()
    return sources.select("file", "source").mapInArrow(lambda b: _walk(wanted, sparse, needs, schema, b), DDL)


class ParseEvents:
    """For SQL: SELECT t.file, e.* FROM t, LATERAL parse_events(t.source) e"""

    kinds = frozenset(KINDS)

    def __init__(self) -> None:
        self.walker = Walker(self.kinds)

    def eval(self, source: str) -> Iterator[tuple]:
        with quiet():
            found = self.walker.run(source or "")
        yield from found


def register(spark: SparkSession, name: str = "parse_events", kinds: Iterable[str] = KINDS) -> UserDefinedTableFunction:
    """Makes the parser a table function of SQL, for events of these kinds. A query keeps the function that it was made with."""
    ship(spark)
    chosen = type("ParseEvents", (ParseEvents,), {"kinds": frozenset(kinds)})
    function = F.udtf(chosen, returnType=DDL.partition(", ")[2])
    spark.udtf.register(name, function)
    return function
