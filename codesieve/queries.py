"""Registered queries over whole tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .corpus import CASES, expected_sql, modules
from .functions.catalog import BUILTINS, LIVE, RULES, rules_table, severity
from .functions.text import column_of, count_placeholders, line_of, module_path
from .operators import diff, report
from .plans.lint import COLUMNS, keep, lint
from .plans.parse import register
from .sources.scan import SKIPPED, is_ignored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


_ALL = expected_sql()
#: With the place of each issue among those of its module, as they are met.
_MET = expected_sql(", c.place AS place")


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules(table(spark, sf_dir, "orders").select("o_orderkey"))


def _issues(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return lint(_corpus(spark, sf_dir), **options)


@query(_ALL)
def lint_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir).select(*COLUMNS)


def _rule(code: str) -> None:
    @query(f"SELECT * FROM ({_ALL}) WHERE code = '{code}'", f"rule_{code.lower()}")
    def rule(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _issues(spark, sf_dir, enable=[code]).where(F.col("code") == code).select(*COLUMNS)


for _code in LIVE:
    _rule(_code)


@query(f"SELECT * FROM ({_ALL}) WHERE code IN ('E0103', 'E0602')")
def enable_wins_over_disable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir, enable="E0103, E0602", disable="E0103").select(*COLUMNS)


@query(f"SELECT * FROM ({_ALL}) WHERE code NOT IN ('E0102', 'E1120', 'E0606')")
def disable_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir, disable="E0102,E1120,E0606").select(*COLUMNS)


@query(f"SELECT * FROM ({_ALL}) WHERE severity = 'error' AND code NOT IN ('E0001')")
def errors_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep(_issues(spark, sf_dir, errors_only=True), disable="E0001", errors_only=True).select(*COLUMNS)


@query(f"SELECT severity, CAST(count(*) AS BIGINT) AS n FROM ({_ALL}) GROUP BY severity")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.severity_counts(_issues(spark, sf_dir))


@query(f"SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE severity = 'error') AS BIGINT) AS errors, CAST(count(*) FILTER (WHERE severity = 'warning') AS BIGINT) AS warnings FROM ({_ALL})")
def issue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary(_issues(spark, sf_dir))


_LINE = "file || ':' || CAST(line AS VARCHAR) || ':' || CAST(\"column\" AS VARCHAR) || ': '"


@query(f"SELECT {_LINE} || '[' || code || '] ' || message AS text FROM ({_ALL})")
def report_parseable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.parseable_report(_issues(spark, sf_dir))


@query(
    f"WITH i AS ({_ALL}) SELECT {_LINE} || code || ': ' || message || ' (' || symbol || ')' AS text FROM i UNION ALL SELECT DISTINCT chr(10) || '************* Module ' || file FROM i "
    "UNION ALL SELECT chr(10) || 'Summary:' WHERE EXISTS (SELECT 1 FROM i) UNION ALL SELECT '  ' || CAST(count(*) AS VARCHAR) || ' ' || severity || '(s)' FROM i GROUP BY severity"
)
def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.text_report(_issues(spark, sf_dir, stored=True), stored=True)


@query(f"SELECT {_LINE} || code || ': ' || message || ' (' || symbol || ')' AS text FROM ({_ALL}) UNION ALL SELECT chr(10) || 'Summary: ' || CAST(count(*) AS VARCHAR) || ' issue(s) found' FROM ({_ALL})")
def report_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.standard_report(_issues(spark, sf_dir, stored=True), stored=True)


_JSON = (
    f"WITH i AS ({_MET}), l AS (SELECT file, max(place) AS place FROM i WHERE file = (SELECT max(file) FROM i) GROUP BY file), "
    "o AS (SELECT i.*, CASE WHEN l.place IS NULL THEN ',' ELSE '' END AS comma FROM i LEFT JOIN l ON l.file = i.file AND l.place = i.place) "
)


def _json_sql(indent: int, severity_sql: str) -> str:
    """One issue as the JSON reports have it."""
    gap = " " * indent
    quoted = lambda c: f"'\"' || replace({c}, '\"', chr(92) || '\"') || '\"'"
    fields = [f"'{gap}  \"{f}\": ' || " + (f'CAST("{f}" AS VARCHAR)' if f in ("line", "column") else quoted(severity_sql if f == "severity" else f)) for f in report.FIELDS]
    return f"'{gap}{{' || chr(10) || " + " || ',' || chr(10) || ".join(fields) + f" || chr(10) || '{gap}}}' || comma"


@query(f"{_JSON} SELECT {_json_sql(2, repr('Error'))} AS text FROM o UNION ALL SELECT '[' UNION ALL SELECT ']'")
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.json_report(_issues(spark, sf_dir, stored=True), stored=True)


@query(
    f"{_JSON} SELECT {_json_sql(4, 'severity')} AS text FROM o UNION ALL SELECT '{{' || chr(10) || '  \"issues\": [' UNION ALL SELECT '  ],' || chr(10) || '  \"summary\": {{' || chr(10) || '    \"total\": ' || CAST(count(*) AS VARCHAR) "
    "|| ',' || chr(10) || '    \"errors\": ' || CAST(count(*) AS VARCHAR) || ',' || chr(10) || '    \"warnings\": 0' || chr(10) || '  }' || chr(10) || '}' FROM o"
)
def report_json_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.json_summary_report(_issues(spark, sf_dir, stored=True), stored=True)


@query(f"SELECT CAST(count(*) AS VARCHAR) || ' issue(s) found' AS text FROM ({_ALL})")
def report_quiet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.quiet_report(_issues(spark, sf_dir))


@query(f'SELECT file, code, line, "column", CAST(row_number() OVER (PARTITION BY file ORDER BY line, "column", place) AS INTEGER) AS place FROM ({_MET})')
def issues_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stable order within each file, as a number."""
    return report.in_order(_issues(spark, sf_dir)).select("file", "code", "line", "column", "place")


@query(f"SELECT text FROM (SELECT {_LINE} || '[' || code || '] ' || message AS text, file, place FROM ({_MET})) ORDER BY file, place LIMIT 30")
def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a report that are shown: here the limit is the feature."""
    return diff.limited_output(report.parseable_report(_issues(spark, sf_dir)))


_OUTCOMES = "SELECT o_custkey AS run, o_orderkey AS place, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN o_orderkey % 7 ELSE 0 END AS issues FROM orders"


@query(f"SELECT run, CAST(coalesce(max_by(CASE WHEN issues IS NULL THEN 2 ELSE 1 END, place) FILTER (WHERE issues IS NULL OR issues > 0), 0) AS INTEGER) AS status FROM ({_OUTCOMES}) GROUP BY run")
def exit_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as runs over their orders: the last with issues or a failure decides."""
    k = F.col("o_orderkey")
    issues = F.when(k % 5 == 0, None).when(k % 3 == 0, k % 7).otherwise(0)
    return report.exit_statuses(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), k.alias("place"), issues.alias("issues")))


_TIMES = "SELECT l_linenumber + 1 AS expected_time, CASE WHEN l_linenumber = 7 THEN 0 ELSE 8 END AS found_time FROM lineitem"


@query(f"SELECT CAST(round(avg(s), 4) AS DOUBLE) AS mean_speedup, CAST(round(min(s), 4) AS DOUBLE) AS min_speedup, CAST(round(max(s), 4) AS DOUBLE) AS max_speedup, CAST(count(*) AS BIGINT) AS n FROM (SELECT expected_time * 1.0 / found_time AS s FROM ({_TIMES}) WHERE expected_time > 0 AND found_time > 0)")
def speedups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.when(F.col("l_linenumber") == 7, 0.0).otherwise(8.0)
    return diff.speedups(table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") + 1).cast("double").alias("expected_time"), found.alias("found_time")))


_STATUS = "SELECT 'E' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') || ' ' || p_name || CASE WHEN p_partkey % 3 = 0 THEN ' ✅ Implemented' ELSE ' ⚠️' END AS value FROM part"


@query(f"SELECT regexp_extract(value, '^(E[0-9]+)', 1) AS code FROM ({_STATUS}) WHERE strpos(value, '✅ Implemented') > 0")
def implemented_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.when(F.col("p_partkey") % 3 == 0, " ✅ Implemented").otherwise(" ⚠️")
    lines = table(spark, sf_dir, "part").select(F.concat(F.lit("E"), F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.lit(" "), "p_name", mark).alias("value"))
    return diff.listed_codes(lines)


@query(
    f"SELECT file, chr(39) || name || chr(39) AS name FROM (SELECT 'm' || CAST(o_orderkey AS VARCHAR) || '.py' AS file, o_orderkey % {len(CASES)} AS n FROM orders) "
    "JOIN (VALUES (3, 'break'), (3, 'break'), (3, 'break'), (3, 'continue'), (15, 'break'), (15, 'continue'), (18, 'continue'), (18, 'break')) j(n, name) USING (n)"
)
def jumps_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parser as a table function of SQL."""
    register(spark, kinds=["jump"])  # no others are asked for
    _corpus(spark, sf_dir).createOrReplaceTempView("codesieve_modules")
    found = spark.sql("SELECT m.file, e.name FROM codesieve_modules m, LATERAL parse_events(m.source) e WHERE e.kind = 'jump'")
    register(spark)
    return found


_BY_FILE = f'WITH i AS ({_ALL}), e AS (SELECT file AS fixture, * FROM i), f AS (SELECT file AS fixture, code, message, CASE WHEN code = \'E0104\' THEN line + 1 ELSE line END AS line, "column" FROM i WHERE code <> \'E0102\') '
_NOT_IN = "WHERE NOT EXISTS (SELECT 1 FROM {} b WHERE b.fixture = a.fixture AND b.code = a.code AND b.line = a.line)"


@query(
    f'{_BY_FILE} SELECT *, CAST(row_number() OVER (PARTITION BY fixture, side ORDER BY line, "column", code, message) AS INTEGER) AS place FROM ('
    f"SELECT fixture, 'missed' AS side, code, line, \"column\", message FROM e a {_NOT_IN.format('f')} UNION ALL SELECT fixture, 'extra', code, line, \"column\", message FROM f a {_NOT_IN.format('e')})"
)
def diff_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What only one side has, by file, in the order of lines and columns."""
    issues = _issues(spark, sf_dir, stored=True).select(F.col("file").alias("fixture"), "code", "line", "column", "message")
    found = issues.where("code <> 'E0102'").withColumn("line", F.when(F.col("code") == "E0104", F.col("line") + 1).otherwise(F.col("line")))
    return diff.unmatched(issues, found, ("fixture",))


@query(f"SELECT code, message, file, line, \"column\", severity, symbol FROM ({_ALL})")
def parse_text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.parse_text_report(report.text_report(_issues(spark, sf_dir, stored=True), stored=True), "text")


@query(f"SELECT code, line, \"column\", message FROM ({_ALL})")
def parse_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = _issues(spark, sf_dir)
    one = F.format_string("%s:%d:%d: %s: %s (%s)", "file", "line", "column", "code", "message", "symbol")
    other = F.format_string("%s:%d:%d: E: %s (%s:%s)", "file", "line", "column", "message", "code", "symbol")
    return diff.parse_findings(issues.select(F.when(F.col("line") % 2 == 0, one).otherwise(other).alias("text")), "text")


_SIDES = f"WITH i AS ({_ALL}), f AS (SELECT code AS fixture, code, CASE WHEN code = 'E0104' THEN line + 1 ELSE line END AS line FROM i WHERE code <> 'E0102'), e AS (SELECT code AS fixture, code, line FROM i)"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Expected: all issues; found: without E0102, and E0104 a line too low."""
    issues = _issues(spark, sf_dir, stored=True).select(F.col("code").alias("fixture"), "code", "line")
    return issues, issues.where("code <> 'E0102'").withColumn("line", F.when(F.col("code") == "E0104", F.col("line") + 1).otherwise(F.col("line")))


@query(f"{_SIDES} SELECT code, line FROM e INTERSECT SELECT code, line FROM f")
def diff_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.matched(*_sides(spark, sf_dir))


@query(f"{_SIDES} SELECT code, line FROM e EXCEPT SELECT code, line FROM f")
def diff_missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.missed(*_sides(spark, sf_dir))


@query(f"{_SIDES} SELECT code, line FROM f EXCEPT SELECT code, line FROM e")
def diff_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.extra(*_sides(spark, sf_dir))


_ACCURACY = (
    f"{_SIDES}, s AS (SELECT fixture, code, line, 1 AS e, 0 AS f FROM e UNION ALL SELECT fixture, code, line, 0, 1 FROM f), k AS (SELECT fixture, code, line, sum(e) AS e, sum(f) AS f FROM s GROUP BY fixture, code, line), "
    "c AS (SELECT fixture, CAST(sum(e) AS BIGINT) AS n_expected, CAST(sum(f) AS BIGINT) AS n_found, CAST(count(*) FILTER (WHERE e > 0 AND f > 0) AS BIGINT) AS n_matched, "
    "CAST(count(*) FILTER (WHERE e > 0 AND f = 0) AS BIGINT) AS n_missed, CAST(count(*) FILTER (WHERE e = 0 AND f > 0) AS BIGINT) AS n_extra FROM k GROUP BY fixture), "
    "a AS (SELECT *, CASE WHEN n_expected > 0 THEN round(100.0 * n_matched / n_expected, 4) WHEN n_found = 0 THEN 100.0 ELSE 0.0 END AS accuracy FROM c)"
)


@query(f"{_ACCURACY} SELECT fixture, n_expected, n_found, n_matched, n_missed, n_extra, CAST(accuracy AS DOUBLE) AS accuracy, CASE WHEN accuracy >= 100 THEN 'perfect' WHEN accuracy > 0 THEN 'partial' ELSE 'failure' END AS bucket FROM a")
def diff_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.accuracy(*_sides(spark, sf_dir))


@query(
    f"{_ACCURACY} SELECT CAST(sum(n_expected) AS BIGINT) AS n_expected, CAST(sum(n_found) AS BIGINT) AS n_found, CAST(sum(n_matched) AS BIGINT) AS n_matched, CAST(sum(n_missed) AS BIGINT) AS n_missed, CAST(sum(n_extra) AS BIGINT) AS n_extra, "
    "CAST(count(*) FILTER (WHERE accuracy >= 100) AS BIGINT) AS perfect, CAST(count(*) FILTER (WHERE accuracy > 0 AND accuracy < 100) AS BIGINT) AS partial, CAST(count(*) FILTER (WHERE accuracy <= 0) AS BIGINT) AS failure, "
    "CAST(round(100.0 * sum(n_matched) / sum(n_expected), 4) AS DOUBLE) AS accuracy FROM a"
)
def diff_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.overall(diff.accuracy(*_sides(spark, sf_dir)))


@query(f"SELECT CAST(substr(file, 2, 1) AS VARCHAR) AS bucket, code, CAST(count(*) AS BIGINT) AS n FROM ({_ALL}) GROUP BY ROLLUP (bucket, code)")
def issues_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = _issues(spark, sf_dir).withColumn("bucket", F.substring("file", 2, 1))
    return issues.rollup("bucket", "code").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES " + ", ".join("('%s', '%s', '%s', 'error', %s)" % (c, s, t.replace("'", "''"), str(live).lower()) for c, (s, t, live) in RULES.items()) + ") r(code, symbol, template, severity, live)")
def rules_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules_table(spark)


_CODE = "CASE CAST(o_orderkey % 6 AS INTEGER) WHEN 0 THEN 'E' WHEN 1 THEN 'W' WHEN 2 THEN 'C' WHEN 3 THEN 'R' WHEN 4 THEN 'I' ELSE 'X' END"


@query(f"SELECT severity, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE {_CODE} WHEN 'W' THEN 'warning' WHEN 'C' THEN 'convention' WHEN 'R' THEN 'refactor' WHEN 'I' THEN 'info' ELSE 'error' END AS severity FROM orders) GROUP BY severity")
def severity_of_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "orders").select(F.element_at(F.array(*map(F.lit, "EWCRIX")), (F.col("o_orderkey") % 6 + 1).cast("int")).alias("letter"))
    return report.severity_counts(codes.select(severity(F.concat("letter", F.lit("0001"))).alias("severity")))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(replace(text, '%%', chr(1)), '%[^%(\s]')) + len(regexp_extract_all(replace(text, '%%', chr(1)), '\{[}0-9:]')) AS INTEGER) AS n FROM documents")
def placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", count_placeholders(F.col("text")).cast("int").alias("n"))


@query(
    "SELECT doc_id, CAST(length(b) - length(replace(b, chr(10), '')) + 1 AS INTEGER) AS line, CAST(length(b) - (CASE WHEN strpos(reverse(b), chr(10)) > 0 THEN length(b) - strpos(reverse(b), chr(10)) + 1 ELSE 0 END) + 1 AS INTEGER) AS \"column\" "
    "FROM (SELECT doc_id, substr(text, 1, strpos(text, '@') - 1) AS b FROM documents WHERE strpos(text, '@') > 0)"
)
def line_and_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("at", F.instr("text", "@") - 1).where("at >= 0")
    return docs.select("doc_id", line_of(F.col("text"), F.col("at")).alias("line"), column_of(F.col("text"), F.col("at")).alias("column"))


@query("SELECT url, replace(replace(url, '://', '.'), '.', '/') || '.py' AS path FROM pages")
def module_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("url", module_path(F.replace("url", F.lit("://"), F.lit("."))).alias("path"))


@query("SELECT page_id, (strpos(url, '7') > 0 OR " + " OR ".join(f"list_contains(string_split(url, '/'), '{n}')" for n in SKIPPED) + ") AS ignored FROM pages")
def ignored_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", is_ignored(F.col("url"), ["7"]).alias("ignored"))


@query("SELECT l_orderkey, l_suppkey, l_linenumber, first_line FROM (SELECT l_orderkey, l_suppkey, l_linenumber, row_number() OVER w AS n, first_value(l_linenumber) OVER w AS first_line FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber)) WHERE n > 1")
def duplicates_after_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey", "l_suppkey").orderBy("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", F.row_number().over(w).alias("n"), F.first("l_linenumber").over(w).alias("first_line"))
    return rows.where("n > 1").drop("n")


@query("SELECT l_orderkey, l_suppkey, l_linenumber, last_line FROM (SELECT l_orderkey, l_suppkey, l_linenumber, max(l_linenumber) OVER (PARTITION BY l_orderkey, l_suppkey) AS last_line FROM lineitem) WHERE l_linenumber <> last_line")
def duplicates_before_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey", "l_suppkey")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", F.max("l_linenumber").over(w).alias("last_line"))
    return rows.where("l_linenumber <> last_line")


@query(
    "SELECT event_id, latest FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM events) "
    "WHERE event_type = 'purchase' AND latest IS NOT NULL"
)
def as_of_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase the user's latest click before it, as a call takes the latest signature before it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    click = F.when(F.col("event_type") == "click", F.col("event_id"))
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.last(click, ignorenulls=True).over(w).alias("latest"))
    return rows.where("event_type = 'purchase' AND latest IS NOT NULL").select("event_id", "latest")


_NAMES = ", ".join(f"'{b}'" for b in BUILTINS)


@query(f"SELECT DISTINCT word FROM (SELECT unnest(string_split(lower(text), ' ')) AS word FROM documents) WHERE word <> '' AND word NOT IN ({_NAMES})")
def words_not_builtin(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), " ")).alias("word")).where("word <> ''")
    return words.where(f"word NOT IN ({_NAMES})").distinct()
