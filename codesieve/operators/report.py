"""Reports: issues -> lines of text, JSON, counts and exit codes.

Lines come as a table (file, line) in order, so a report of any size is written by executors; nothing is gathered in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import severity_rank
from ..session import stash

FIELDS = ("code", "message", "file", "line", "column", "severity", "symbol")
_COLOURS = {"error": "31", "warning": "33", "convention": "34", "refactor": "35", "info": "36"}


def _coloured(text: Column, colour: bool) -> Column:
    if not colour:
        return text
    painted = text
    for name, number in _COLOURS.items():
        painted = F.when(F.col("severity") == name, F.concat(F.lit(f"\x1b[{number}m"), text, F.lit("\x1b[0m"))).otherwise(painted)
    return painted


def severity_counts(issues: DataFrame) -> DataFrame:
    """(severity, n) of those that occur, from error to info."""
    return issues.groupBy("severity").agg(F.count("*").alias("n")).orderBy(severity_rank(F.col("severity")))


def _joined(*parts: Column | str) -> Column:
    """Texts and columns in a row; null is 'null'. What format_string gives, in generated code: reports make each line twice, since they are sorted."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts])


def _line(code: Column) -> Column:
    c = F.col
    return _joined(c("file"), ":", c("line"), ":", c("column"), ": ", code, ": ", c("message"), " (", c("symbol"), ")")


def text_report(issues: DataFrame, colour: bool = False, stored: bool = False) -> DataFrame:
    """(text) in order: for each file a headline and its issues by line and column, as they were met where those are equal; then the counts. No issues: no line.

    stored: issues are cheap to read again; else they are written first, since four parts read them.
    """
    issues = issues if stored else stash(issues, "issues")
    place = lambda part, file, line, column, seq: (F.lit(part).alias("part"), file.alias("file"), line.alias("line"), column.alias("column"), seq.cast("long").alias("seq"))
    c, at = F.col, F.lit(-1)
    headline = issues.select("file").distinct().select(*place(0, c("file"), at, at, at), F.concat(F.lit("\n************* Module "), "file").alias("text"))
    body = issues.select(*place(0, c("file"), c("line"), c("column"), c("seq")), _line(_coloured(c("code"), colour)).alias("text"))
    counts = severity_counts(issues).select(*place(1, F.lit(""), severity_rank(c("severity")), at, at), F.format_string("  %d %s(s)", "n", "severity").alias("text"))
    title = issues.limit(1).select(*place(1, F.lit(""), at, at, at), F.lit("\nSummary:").alias("text"))
    return headline.unionByName(body).unionByName(title).unionByName(counts).orderBy("part", "file", "line", "column", "seq").select("text")


def in_order(issues: DataFrame) -> DataFrame:
    """issues with place, from 1 within each file: by line and column, as they were met where those are equal."""
    return issues.withColumn("place", F.row_number().over(Window.partitionBy("file").orderBy("line", "column", "seq")))


def parseable_report(issues: DataFrame) -> DataFrame:
    """(text) as issues were met: file:line:column: [code] message"""
    return issues.orderBy("file", "seq").select(_joined(F.col("file"), ":", F.col("line"), ":", F.col("column"), ": [", F.col("code"), "] ", F.col("message")).alias("text"))


def _json_name(severity: Column) -> Column:
    return F.when(severity == "info", "Information").otherwise(F.initcap(severity))


def _quoted(c: Column) -> Column:
    whole = F.to_json(F.struct(c.alias("x")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def _pretty(indent: int, severity_name: Column) -> Column:
    gap = " " * indent
    fields = [F.concat(F.lit(f'{gap}  "{f}": '), F.col(f).cast("string") if f in ("line", "column") else _quoted(severity_name if f == "severity" else F.col(f))) for f in FIELDS]
    return F.concat(F.lit(gap + "{\n"), F.concat_ws(",\n", *fields), F.lit("\n" + gap + "}"))


def json_lines(issues: DataFrame) -> DataFrame:
    """(text): an object for each issue, severity by its name in full."""
    return issues.orderBy("file", "seq").select(F.to_json(F.struct(*[_json_name(F.col(c)).alias(c) if c == "severity" else F.col(c) for c in FIELDS])).alias("text"))


def _array(issues: DataFrame, indent: int, severity_name: Column) -> DataFrame:
    last = issues.agg(F.max(F.struct("file", "seq")).alias("last")).first()["last"]  # the one that has no comma after it
    if last is None:
        last = ("", -1)
    comma = F.when((F.col("file") == last[0]) & (F.col("seq") == last[1]), "").otherwise(",")
    return issues.select(F.lit(1).alias("part"), "file", "seq", F.concat(_pretty(indent, severity_name), comma).alias("text"))


def _edge(rows: DataFrame, part: int, text: Column | str) -> DataFrame:
    return rows.select(F.lit(part).alias("part"), F.lit("").alias("file"), F.lit(0).cast("long").alias("seq"), (F.lit(text) if isinstance(text, str) else text).alias("text"))


def json_report(issues: DataFrame, stored: bool = False) -> DataFrame:
    """(text): the parts of one JSON array, an issue each. No issues: no line."""
    issues = issues if stored else stash(issues, "issues")
    some = issues.limit(1)
    rows = _array(issues, 2, _json_name(F.col("severity"))).unionByName(_edge(some, 0, "[")).unionByName(_edge(some, 2, "]"))
    return rows.orderBy("part", "file", "seq").select("text")


def json_summary_report(issues: DataFrame, stored: bool = False) -> DataFrame:
    """(text): the parts of one JSON object with the issues and their summary."""
    issues = issues if stored else stash(issues, "issues")
    counts = summary(issues)
    end = F.format_string('  ],\n  "summary": {\n    "total": %d,\n    "errors": %d,\n    "warnings": %d\n  }\n}', "total", "errors", "warnings")
    rows = _array(issues, 4, F.col("severity")).unionByName(_edge(counts, 0, '{\n  "issues": [')).unionByName(_edge(counts, 2, end))
    return rows.orderBy("part", "file", "seq").select("text")


def summary(issues: DataFrame) -> DataFrame:
    """(total, errors, warnings): one row."""
    return issues.agg(F.count("*").alias("total"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))


def quiet_report(issues: DataFrame) -> DataFrame:
    """(text): '3 issue(s) found'."""
    return summary(issues).select(F.format_string("%d issue(s) found", "total").alias("text"))


def standard_report(issues: DataFrame, stored: bool = False) -> DataFrame:
    """(text): a line for each issue and their number, or 'No issues found!'."""
    issues = issues if stored else stash(issues, "issues")
    lines = issues.select(F.lit(0).alias("part"), "file", "seq", _line(F.col("code")).alias("text"))
    end = F.when(F.col("total") == 0, F.lit("No issues found!")).otherwise(F.format_string("\nSummary: %d issue(s) found", "total"))
    return lines.unionByName(_edge(summary(issues), 1, end)).orderBy("part", "file", "seq").select("text")


def report(issues: DataFrame, output_format: str = "text", colour: bool = False) -> DataFrame:
    """json, parseable, or text for any other name."""
    return json_report(issues) if output_format == "json" else parseable_report(issues) if output_format == "parseable" else text_report(issues, colour)


def parse_text_report(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """Issues from the lines of a text report; headlines, blank and malformed lines are skipped, and what isn't an error is a warning."""
    t = F.col(text_col)
    parts = F.split(t, ":", 4)
    rest = F.trim(F.get(parts, F.lit(3)))
    code = F.rtrim(F.substring_index(rest, " ", 1), F.lit(":"))
    said = F.substring(rest, F.locate(" ", rest) + F.lit(1), F.length(rest))
    named = said.rlike(r"\([^(]*\)$")
    number = lambda k: F.get(parts, F.lit(k)).try_cast("int")
    kept = lines.where((t != "") & ~t.startswith("*") & number(1).isNotNull() & number(2).isNotNull() & rest.contains(" "))
    return kept.select(
        code.alias("code"), F.when(named, F.trim(F.regexp_replace(said, r"\([^(]*\)$", ""))).otherwise(said).alias("message"), F.get(parts, F.lit(0)).alias("file"), number(1).alias("line"), number(2).alias("column"),
        F.when(code.startswith("E"), "error").otherwise("warning").alias("severity"), F.when(named, F.regexp_extract(said, r"\(([^(]*)\)$", 1)).otherwise("").alias("symbol"),
    )


def exit_status(outcomes: list[int | bool | None]) -> int:
    """Of the paths in order: an issue count or whether there were issues, None for a path that failed. The last path with issues (1) or that failed (2)
    decides; one without issues changes nothing. No path: 1."""
    if not outcomes:
        return 1
    status = 0
    for x in outcomes:
        status = 2 if x is None else 1 if x else status
    return status


def exit_statuses(outcomes: DataFrame, run: str = "run", place: str = "place", issues: str = "issues") -> DataFrame:
    """(run, status) of many runs at once: rows are paths in order of place, with their number of issues, null for a path that failed."""
    event = F.when(F.col(issues).isNull(), 2).when(F.col(issues) > 0, 1)
    return outcomes.groupBy(run).agg(F.coalesce(F.max_by(event, F.when(event.isNotNull(), F.col(place))), F.lit(0)).alias("status"))
