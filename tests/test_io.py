"""Sources, configuration, reports, comparison, streams and the command line."""

import json

import pytest

from codesieve import LintError, lint_directory, lint_file, lint_path
from codesieve.__main__ import main
from codesieve.functions.catalog import BUILTINS, LIVE, RULES
from codesieve.operators import diff, report
from codesieve.plans.lint import Config, lint
from codesieve.sources.scan import from_path, from_table
from codesieve.streaming import lint_stream, source_stream


@pytest.fixture
def tree(tmp_path):
    for name, text in {"a/x.py": "break\n", "a/venv/y.py": "break\n", "b/z.pyi": "return 1\n", "b/n.txt": "break\n", "b/empty.py": "", "b/skip_me.py": "break\n"}.items():
        p = tmp_path / "t" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return tmp_path / "t"


def names(df, root):
    return sorted(r["file"].removeprefix(f"{root}/") for r in df.select("file").distinct().collect())


def test_scans(spark, tree):
    assert names(from_path(spark, str(tree)), tree) == ["a/x.py", "b/skip_me.py", "b/z.pyi"]
    assert names(from_path(spark, str(tree), ["skip"]), tree) == ["a/x.py", "b/z.pyi"]
    assert names(from_path(spark, str(tree / "b/n.txt")), tree) == ["b/n.txt"]
    with pytest.raises(FileNotFoundError):
        from_path(spark, str(tree / "none"))
    assert names(lint_directory(spark, str(tree)), tree) == ["a/venv/y.py", "a/x.py", "b/skip_me.py"]
    assert names(lint_directory(spark, str(tree / "a"), recursive=False), tree) == ["a/x.py"]
    assert [r["code"] for r in lint_file(spark, str(tree / "b/z.pyi")).collect()] == ["E0104"]
    with pytest.raises(LintError):
        lint_directory(spark, str(tree / "a/x.py"))


def test_bytes_that_are_no_text(spark, tree):
    (tree / "a/bad.py").write_bytes(b"x = '\xff'\n")
    assert names(from_path(spark, str(tree / "a"), strict=False), tree) == ["a/x.py"]
    with pytest.raises(Exception, match="(?i)utf"):
        from_path(spark, str(tree / "a")).collect()


def test_tables(spark):
    df = spark.createDataFrame([(1, "break\n", 5), (2, None, 6), (None, "return\n", 7)], "id int, body string, file int")
    assert sorted((r["file"], r["code"]) for r in lint(from_table(df, "id", "body")).collect()) == [("", "E0104"), ("1", "E0103")]
    assert lint(from_table(df.where("false"), "id", "body")).collect() == []


def test_config(tmp_path):
    full = {"jobs": 2, "output_format": "JSON", "enabled_checkers": ["E0103"], "disabled_checkers": [], "ignore_patterns": ["x"], "errors_only": False, "verbose": True}
    (tmp_path / "c.json").write_text(json.dumps(full))
    (tmp_path / "codesieve.toml").write_text('jobs = 1\noutput_format = "text"\nenabled_checkers = []\ndisabled_checkers = ["E0104"]\nignore_patterns = []\nerrors_only = true\nverbose = false\n')
    (tmp_path / "part.json").write_text('{"jobs": 2}')
    c = Config.from_file(tmp_path / "c.json").with_options(enable="E0104 , E0105", disable="e1")
    assert c.enabled_checkers == {"E0103", "E0104", "E0105"} and c.disabled_checkers == {"e1"} and c.output_format == "json"
    assert Config.from_default_places(tmp_path).errors_only and Config.from_default_places(tmp_path / "none").jobs >= 1
    with pytest.raises(ValueError):
        Config.from_file(tmp_path / "part.json")


def texts(df):
    return [r["text"] for r in df.collect()]


def test_reports(spark, tree):
    issues = lint_path(spark, str(tree), ["skip"])
    lines = texts(report.text_report(issues))
    assert lines[0] == f"\n************* Module {tree}/a/x.py" and lines[1] == f"{tree}/a/x.py:1:1: E0103: 'break' not properly in loop (not-in-loop)"
    assert lines[-2:] == ["\nSummary:", "  2 error(s)"]
    assert "\x1b[31mE0103\x1b[0m" in "".join(texts(report.text_report(issues, colour=True)))
    assert texts(report.parseable_report(issues))[0].endswith(":1:1: [E0103] 'break' not properly in loop")
    data = json.loads("\n".join(texts(report.json_report(issues))))
    assert [d["code"] for d in data] == ["E0103", "E0104"] and list(data[0]) == list(report.FIELDS) and data[0]["severity"] == "Error"
    data = json.loads("\n".join(texts(report.json_summary_report(issues))))
    assert data["summary"] == {"total": 2, "errors": 2, "warnings": 0} and data["issues"][0]["severity"] == "error"
    assert [json.loads(x)["code"] for x in texts(report.json_lines(issues))] == ["E0103", "E0104"]
    assert texts(report.quiet_report(issues)) == ["2 issue(s) found"] and texts(report.standard_report(issues))[-1] == "\nSummary: 2 issue(s) found"
    back = report.parse_text_report(report.text_report(issues), "text")
    assert sorted(back.select(*report.FIELDS).collect()) == sorted(issues.select(*report.FIELDS).collect())
    none = issues.where("false")
    assert [texts(f(none)) for f in (report.text_report, report.json_report, report.parseable_report)] == [[], [], []]
    assert texts(report.standard_report(none)) == ["No issues found!"] and json.loads("".join(texts(report.json_summary_report(none))))["issues"] == []


def test_parse_of_odd_lines(spark):
    lines = spark.createDataFrame([(x,) for x in ("", "****", "a:b:c: E1: x (y)", "f:1:2: W1: said (it) twice (sym)", "f:1:2: E2: no symbol", "f:1:2: E3", "f:1", "f: 3 :4: X")], "value string")
    rows = sorted(report.parse_text_report(lines).select("code", "message", "severity", "symbol").collect())
    assert [tuple(r) for r in rows] == [("E2", "no symbol", "error", ""), ("W1", "said (it) twice", "warning", "sym")]
    found = diff.parse_findings(spark.createDataFrame([("x.py:3:4: E0602: Undefined (a) (undefined-variable)",), ("x.py:5:6: E: Undefined b (E0602:undefined-variable)",), ("nothing",)], "value string"))
    assert [(r["code"], r["line"], r["column"]) for r in found.orderBy("line").collect()] == [("E0602", 3, 4), ("E0602", 5, 6)]
    codes = diff.listed_codes(spark.createDataFrame([("E0103 x ✅ Implemented",), ("E0001 ✅ Implemented",), (" E0104 ✅ Implemented",), ("E0105 ⚠️",)], "value string"))
    assert [r["code"] for r in codes.collect()] == ["E0103"]


def test_accuracy(spark):
    columns = "fixture string, code string, line int"
    expected = spark.createDataFrame([("a", "E1", 1), ("a", "E1", 1), ("a", "E1", 2), ("b", "E2", 1)], columns)
    got = spark.createDataFrame([("a", "E1", 1), ("a", "E1", 9), ("c", "E3", 1)], columns)
    rows = {r["fixture"]: r for r in diff.accuracy(expected, got).collect()}
    assert (rows["a"]["n_expected"], rows["a"]["n_found"], rows["a"]["n_matched"], rows["a"]["n_missed"], rows["a"]["n_extra"], rows["a"]["accuracy"]) == (3, 2, 1, 1, 1, 33.3333)
    assert rows["b"]["bucket"] == "failure" and rows["c"]["accuracy"] == 0
    assert diff.overall(diff.accuracy(expected, got)).first()["accuracy"] == 25.0
    times = spark.createDataFrame([(4.0, 2.0), (9.0, 1.0), (1.0, 0.0)], "expected_time double, found_time double")
    assert tuple(diff.speedups(times).first()) == (5.5, 2.0, 9.0, 2)


def test_exit_status():
    assert [report.exit_status(x) for x in ([], [0], [3], [None], [3, 0], [0, None], [None, 2], [None, 0], [0, 0])] == [1, 0, 1, 2, 1, 2, 1, 2, 0]


def test_catalogue():
    assert len(RULES) == 41 and len(LIVE) == 24 and len(set(BUILTINS)) == 143


def test_command_line(spark, tree, capsys, monkeypatch):
    monkeypatch.chdir(tree)
    assert main([]) == 1
    assert main([str(tree / "a"), "--enable", "E0104"]) == 0
    assert main([str(tree / "a"), "-f", "parseable"]) == 1 and "[E0103]" in capsys.readouterr().out
    assert main([str(tree / "a"), str(tree / "none")]) == 2
    (tree / "bytes.py").write_bytes(b"x = '\xff'\n")
    assert main([str(tree / "bytes.py")]) == 2 and main([str(tree / "bytes.py"), str(tree / "a")]) == 1 and "Error: " in capsys.readouterr().err
    (tree / "clean.py").write_text("x = 1\n")
    assert main([str(tree / "a"), str(tree / "clean.py")]) == 1


def test_simple_command_line(spark, tree, capsys, monkeypatch):
    from codesieve import simple

    assert simple.main([str(tree / "a"), "--no-recursive", "-q"]) == 1 and capsys.readouterr().out == "1 issue(s) found\n"
    assert simple.main([str(tree / "a"), "--json"]) == 1 and json.loads(capsys.readouterr().out)["summary"]["total"] == 2
    assert simple.main([str(tree / "b/z.pyi"), "--disable", "E0104"]) == 0 and capsys.readouterr().out == "No issues found!\n"
    assert simple.main([str(tree / "none")]) == 1
    with pytest.raises(SystemExit) as e:
        simple.main(["--version"])
    assert e.value.code == 0

    def interrupted(*_, **__):
        raise KeyboardInterrupt

    monkeypatch.setattr(simple, "lint_file", interrupted)
    assert simple.main([str(tree / "b/z.pyi")]) == 130


def test_imports_from_disk(spark, tree):
    """Modules that an import names are read though they aren't linted, and give no issues of their own."""
    (tree / "lib").mkdir()
    (tree / "lib/main.py").write_text("from helper import f\nfrom upper import g\nfrom here.deep import h\nfrom broken import k\nfrom gone import z\nf(1)\ng()\nh()\nk()\nz()\n")
    (tree / "lib/helper.py").write_text("def f(a, b): pass\nbreak\n")
    (tree / "upper.py").write_text("def g(a): pass\n")
    (tree / "here").mkdir()
    (tree / "here/deep.py").write_text("def h(a): pass\n")
    (tree / "lib/broken.py").write_bytes(b"def k(a): pass\nx = '\xff'\n")
    (tree / "broken.py").write_text("def k(a): pass\n")
    one = [(r["code"], r["line"]) for r in lint_file(spark, str(tree / "lib/main.py")).orderBy("seq").collect()]
    assert one == [("E1120", 6), ("E1120", 7), ("E1120", 8)]
    (tree / "lib/broken.py").unlink()
    whole = [(r["code"], r["line"]) for r in lint_path(spark, str(tree)).where("file LIKE '%/main.py'").orderBy("seq").collect()]
    assert whole == [*one, ("E1120", 9)]


def test_differential(spark):
    """Codes of a status list, their fixtures, both sides' findings, results and what is unmatched in order."""
    status = spark.createDataFrame([("E0103 loops ✅ Implemented",), ("E0104 return ✅ Implemented",), ("E0711 name ✅ Implemented",), ("E0001 ✅ Implemented",), ("E0105 ⚠️",), ("E0112 ✅ Implemented",)], "value string")
    files = [("t/e0103.py", "break\ncontinue\nreturn 1\n"), ("t/E0104.py", "return 1\nreturn 2\n"), ("t/e0711.py", "x = 1\n"), ("t/e0105.py", "yield 1\n"), ("t/other.py", "break\n")]
    expected = [("E0103", "E0103", 1, 9, "a"), ("E0103", "E0103", 7, 2, "late"), ("E0103", "E0103", 5, 1, "early"), ("E0103", "E0104", 3, 1, "not its code"), ("E0104", "E0104", 1, 1, "x"), ("E0104", "E0104", 2, 1, "y"), ("E0105", "E0105", 1, 1, "not listed")]
    run = diff.differential(status, spark.createDataFrame(files, "file string, source string"), spark.createDataFrame(expected, "fixture string, code string, line int, column int, message string"))
    rows = {r["fixture"]: (r["n_expected"], r["n_found"], r["n_matched"], round(r["accuracy"], 1), r["bucket"]) for r in run.results.collect()}
    assert rows == {"E0103": (3, 2, 1, 33.3, "partial"), "E0104": (2, 2, 2, 100.0, "perfect"), "E0711": (0, 0, 0, 100.0, "perfect")}
    assert run.overall.first()["accuracy"] == 60.0
    assert [tuple(r) for r in run.unmatched.orderBy("fixture", "side", "place").select("fixture", "side", "line", "message").collect()] == [("E0103", "extra", 2, "'continue' not properly in loop"), ("E0103", "missed", 5, "early"), ("E0103", "missed", 7, "late")]


def test_stream(spark, tree, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    lint_stream(source_stream(spark, str(tree)), out, check).awaitTermination(120)
    assert sorted(r["code"] for r in spark.read.parquet(out).collect()) == ["E0103", "E0103", "E0104"]
    (tree / "a/new.py").write_text("return\n")
    lint_stream(source_stream(spark, str(tree)), out, check).awaitTermination(120)
    assert sorted(r["code"] for r in spark.read.parquet(out).collect()) == ["E0103", "E0103", "E0104", "E0104"]
