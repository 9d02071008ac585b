"""What keeps the linter's cost in proportion to what is asked for."""

import pytest
from test_rules import SNIPPETS, found

from codesieve.corpus import CASES, modules
from codesieve.functions.catalog import LIVE
from codesieve.operators import diff, report, rules
from codesieve.plans import walker
from codesieve.plans.lint import lint
from codesieve.plans.parse import register
from codesieve.plans.walker import Walker, quiet

ALL = [*SNIPPETS, *(m.replace("{k}", "7").replace("{j}", "4") for m, _ in CASES)]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def parsed(monkeypatch, codes, source) -> int:
    """How often a module is parsed for these rules."""
    calls = []
    monkeypatch.setattr(walker, "compile", lambda *a, **k: calls.append(a) or compile(*a, **k), raising=False)
    with quiet():
        Walker(frozenset(rules.kinds_of(codes)), True, rules.needs_of(codes)).run(source)
    return len(calls)


@pytest.mark.parametrize("code, without, with_it", [("E0104", "def f(): pass\n", "return\n"), ("E0117", "x = 1\n", "nonlocal x\n"), ("E0213", "x = 1\n", "class A:\n    def m(): pass\n"), ("E0213", "def f(): pass\n", "class A:\n    def m(): pass\n"), ("E0102", "class A: pass\n", "class A: pass\nclass A: pass\n"), ("E0606", "print(x)\n", "if c:\n    x = 1\nprint(x)\n")])
def test_a_text_without_the_words_of_a_rule_is_not_parsed_for_it(monkeypatch, code, without, with_it):
    assert (parsed(monkeypatch, (code,), without), parsed(monkeypatch, (code,), with_it)) == (0, 1)
    assert parsed(monkeypatch, (code, "E0001"), without) == 1


def test_each_rule_alone_finds_what_all_find(spark):
    sources = {f"s{k:03}.py": s for k, s in enumerate(ALL)}
    rows = lambda got: sorted((r["file"], r["code"], r["line"], r["column"], r["message"]) for rows in got.values() for r in rows)
    every = rows(found(spark, sources))
    for code in LIVE:
        assert rows(found(spark, sources, enable=[code])) == [r for r in every if r[1] == code], code


@pytest.mark.parametrize("code", ["E0102", "E0104", "E0117", "E0213", "E0606"])
def test_rules_within_a_file_shuffle_nothing(spark, code):
    table = spark.createDataFrame([("a.py", "x = 1\n")], "file string, source string")
    text = plan(lint(table, enable=[code]))
    assert "Exchange" not in text and "Window" not in text


def test_events_that_no_rule_can_use_stay_in_the_worker():
    source = "import os\ndef f(a):\n    for x in a:\n        if x: break\n    return g(a)\nclass A:\n    def m(self): return f(self)\nf(1)\n{1: 2, 3: 4}\n"
    with quiet():
        assert [e[1] for e in Walker(frozenset(rules.kinds_of(LIVE)), True).run(source)] == ["module", "unresolved"]


def test_a_large_table_has_more_parts_than_cores(spark):
    assert modules(spark.range(1000).withColumnRenamed("id", "o_orderkey")).rdd.getNumPartitions() > spark.sparkContext.defaultParallelism


def test_own_function_and_imports_in_turn(spark):
    """The latest import that finds something counts, unless the file's own function came after it."""
    got = found(
        spark,
        {
            "m.py": "def g(a, b): pass\ndef h(): pass\ndef g(): pass\n",
            "a.py": "from m import g\ng()\ndef g(): pass\ng()\nfrom nowhere import g\ng()\nfrom m import nothing as g\ng()\nfrom m import g\ng()\n",
            "b.py": "def g(x): pass\nfrom m import h as g\ng()\nfrom nowhere import g\ng()\n",
            "c.py": "from m import g\nfrom nowhere import g\ng()\n",
        },
    )
    assert {f: [r["line"] for r in rows if r["code"] == "E1120"] for f, rows in got.items()} == {"m.py": [], "a.py": [2, 10], "b.py": [], "c.py": [3]}


def test_rules_are_decided_before_the_generator(spark):
    """The array of an event's issues is made by generated code, once."""
    text = plan(lint(spark.createDataFrame([("a.py", "x\n")], "file string, source string"), enable=["E0602"]))
    assert text.count("E0602") and text.index("Generate posexplode(found") < text.index("E0602,"), text


def test_stored_issues_are_not_written_again(spark, monkeypatch):
    """A report over issues that lie in the shared folder reads them there."""
    table = spark.createDataFrame([("a.py", "x\n")], "file string, source string")
    issues, written = lint(table, stored=True), []
    monkeypatch.setattr(report, "stash", lambda df, name: written.append(name) or df)
    for f in (report.text_report, report.standard_report, report.json_report, report.json_summary_report):
        assert [r["text"] for r in f(issues, stored=True).collect()] and not written


def test_a_side_with_few_keys_is_made_distinct_before_the_sides_meet(spark):
    """Else all rows of a key, which are as many as the modules, go through one task."""
    rows = spark.range(4000).selectExpr("concat('E010', id % 3) AS code", "cast(id % 2 AS int) AS line")
    for f in (diff.matched, diff.missed, diff.extra):
        text = plan(f(rows, rows.where("code <> 'E0102'")))
        assert text.index("Join") < text.index("HashAggregate", text.index("Join")) and "Join" not in text[text.rindex("HashAggregate") :], text


def test_findings_with_line_ends_and_marks(spark):
    lines = ["a.py:1:2: E0102: one \x01 two (sym)", "a.py:3:4: E: said (E0103:sym) more\nand more", "a.py:1: E0102: no (x)", "a.py:5:6: E0104:  (s)"]
    got = diff.parse_findings(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [tuple(r) for r in got] == [("E0102", 1, 2, "one \x01 two"), ("E0103", 3, 4, "said"), ("E0104", 5, 6, "")]


def test_the_table_function_of_a_query_gives_the_kinds_that_it_keeps(spark):
    spark.createDataFrame([("a.py", "break\nx\n")], "file string, source string").createOrReplaceTempView("kept")
    kinds = lambda: [r["kind"] for r in spark.sql("SELECT e.kind FROM kept k, LATERAL parse_events(k.source) e").collect()]
    register(spark, kinds=["jump"])
    before = spark.sql("SELECT e.kind FROM kept k, LATERAL parse_events(k.source) e")
    register(spark)
    assert [r["kind"] for r in before.collect()] == ["jump"] and kinds() == ["module", "jump", "unresolved"]
