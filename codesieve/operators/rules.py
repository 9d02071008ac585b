"""Rules: event table -> issues (file, seq, code, message, line, column, severity, symbol).

Nearly all rules look at one event, which says what came before it in its file, and are fused into one projection over one scan. Only calls of
imported names need other files: those, the imports and the functions that modules offer are joined by path and name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import LIVE, RULES, message, severity_of
from ..functions.text import count_placeholders, inside, module_path, parent

C = F.col
_ISSUE = "array<struct<code: string, message: string, line: int, column: int, severity: string, symbol: string>>"
#: Within one event the join rules come first, then those of the projection in this order.
STEP = 100_000


def _kinds(code: str) -> list[Column]:
    return [F.lit(severity_of(code)).alias("severity"), F.lit(RULES[code][0]).alias("symbol")]


def _one(code: str, when: Column, *args: Column) -> Column:
    issue = F.struct(F.lit(code).alias("code"), message(code, *args).alias("message"), C("line"), C("column"), *_kinds(code))
    return F.when(when & ~C("unreachable"), F.array(issue))


def _many(code: str, when: Column, items: Column, name: Callable[[Column], Column], line: Callable[[Column], Column] | None = None, column: Callable[[Column], Column] | None = None) -> Column:
    """An issue for each item of an array."""
    make = lambda x: F.struct(F.lit(code).alias("code"), message(code, name(x)).alias("message"), (line(x) if line else C("line")).alias("line"), (column(x) if column else C("column")).alias("column"), *_kinds(code))
    return F.when(when & ~C("unreachable") & items.isNotNull(), F.transform(items, make))


def _kind(*kinds: str) -> Column:
    return C("kind").isin(*kinds)


def _repeats(items: Column) -> Column:
    """The items whose name an earlier one has."""
    names = F.transform(items, lambda x: x["name"])
    placed = F.transform(items, lambda x, k: F.struct(x.alias("x"), (F.array_position(names, x["name"]) <= k).alias("again")))
    return F.transform(F.filter(placed, lambda p: p["again"]), lambda p: p["x"])


def _lead() -> Column:
    """The first parameter that takes a position."""
    return F.get(F.filter(C("params"), lambda p: p["kind"].isin("positional_only", "positional")), F.lit(0))["name"]


def _method() -> Column:
    return _kind("def") & C("in_class") & ~C("in_function") & ~F.array_contains(C("decorators"), "staticmethod")


def _init() -> Column:
    return _kind("def") & (C("name") == "__init__")


def _nameless() -> Column:
    return F.size("params") == 0


def _misled() -> Column:
    return ~_nameless() & ~_lead().eqNullSafe(F.when(F.array_contains(C("decorators"), "classmethod"), "cls").otherwise("self"))


def _redefined() -> Column:
    """Of a definition: in a class there is one of its name before it, or at the top it isn't in the place of the module's last one."""
    return _kind("def", "class") & (C("n").isNotNull() | C("places").isNotNull())


def _definition() -> Column:
    method, function = F.concat(F.lit("method already defined line "), C("n").cast("string")), F.concat(F.lit("function already defined line "), F.get("places", F.lit(0))["line"].cast("string"))
    return F.when(_kind("class"), C("name")).when(C("in_class"), method).otherwise(function)


def _lacking() -> Column:
    """The first required name of a call that neither a position nor a keyword gives."""
    rest = F.when(F.size("required") > C("n"), F.slice(C("required"), C("n") + 1, F.size("required")))
    return F.get(F.filter(rest, lambda r: ~F.coalesce(F.array_contains(C("names"), r), F.lit(False))), F.lit(0))


#: code -> (kinds of events, issues of one event, made when they are asked for: each column costs calls to the JVM). Names that are built in aren't among the unresolved.
LOCAL: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {
    "E0102": (("def", "class"), lambda: _one("E0102", _redefined(), _definition())),
    "E1120": (("call",), lambda: _one("E1120", _kind("call") & C("value").isNull() & _lacking().isNotNull(), _lacking())),
    "E0001": (("syntax",), lambda: _one("E0001", _kind("syntax"), C("name"))),
    "E0211": (("def",), lambda: _one("E0211", _method() & _nameless(), C("name"))),
    "E0213": (("def",), lambda: _one("E0213", _method() & _misled(), C("name"))),
    "E0108": (("def",), lambda: _many("E0108", _kind("def"), _repeats(C("params")), lambda p: p["name"])),
    "E0100": (("def",), lambda: _one("E0100", _init() & C("yields"))),
    "E0101": (("def",), lambda: _one("E0101", _init() & ~C("yields") & C("returns_value"))),
    "E0115": (("nested",), lambda: _many("E0115", _kind("nested"), C("names"), lambda n: n)),
    "E0103": (("jump",), lambda: _one("E0103", _kind("jump") & ~C("in_loop"), C("name"))),
    "E0104": (("return",), lambda: _one("E0104", _kind("return") & ~C("in_function"))),
    "E0105": (("yield",), lambda: _one("E0105", _kind("yield") & ~C("in_function"))),
    "E0109": (("dict",), lambda: _many("E0109", _kind("dict"), _repeats(C("places")), lambda p: p["name"], lambda p: p["line"], lambda p: p["column"])),
    "E0112": (("stars",), lambda: _one("E0112", _kind("stars") & (C("n") > 1))),
    "E0113": (("star_target",), lambda: _one("E0113", _kind("star_target"))),
    "E0117": (("nonlocal",), lambda: _one("E0117", _kind("nonlocal") & ~C("in_function"), C("name"))),
    "E0118": (("global",), lambda: _many("E0118", _kind("global"), F.filter(C("places"), lambda p: p["line"] < C("line")), lambda p: p["name"], lambda p: p["line"], lambda p: p["column"])),
    "E0601": (("unresolved",), lambda: _one("E0601", _kind("unresolved") & (C("value") == "local"), C("name"))),
    "E0602": (("unresolved",), lambda: _one("E0602", _kind("unresolved") & (C("value") == "unknown"), C("name"))),
    "E0606": (("unresolved",), lambda: _one("E0606", _kind("unresolved") & C("value").isin("local_conditional", "module_conditional", "conditional"), C("name"))),
    "E0704": (("raise",), lambda: _one("E0704", _kind("raise") & ~C("in_except"))),
    "E0711": (("raise_name",), lambda: _one("E0711", _kind("raise_name"))),
    "E1142": (("await",), lambda: _one("E1142", _kind("await") & ~C("in_async"))),
    "E1205": (("log",), lambda: _one("E1205", _kind("log") & (C("n") - 1 > count_placeholders(C("value"))))),
}


#: code -> what a text must have for an issue: of each of these groups of words so many. Rules that aren't here need what their events need. (Python's keywords are spelled in one way only, unlike names.)
WORDS: dict[str, tuple[tuple[int, tuple[str, ...]], ...]] = {
    "E0102": ((2, ("def", "class")),), "E0211": ((1, ("class",)), (1, ("def",))), "E0213": ((1, ("class",)), (1, ("def",))), "E0112": ((2, ("*",)),), "E0115": ((1, ("global",)), (1, ("nonlocal",))),
    "E0601": ((1, ("def",)),), "E0606": ((1, ("if", "try")),),
}


def needs_of(codes: tuple[str, ...]) -> tuple | None:
    """A text that has what one of these says may have issues, any other has none; None: any text may have some."""
    return tuple(WORDS[c] for c in codes) if codes and set(codes) <= WORDS.keys() else None


def kinds_of(codes: tuple[str, ...]) -> set[str]:
    """The kinds of events that these rules read: the parser is asked for no others."""
    wanted = {"module", "import"} if "E1120" in codes else set()
    for code in codes:
        wanted.update(LOCAL[code][0] if code in LOCAL else ())
    return wanted


#: The kinds of rows that say what lies across files; of calls those of names that were imported.
_LINKS = ("module", "import", "call")
_LINK_COLUMNS = ("name", "value", "n", "names", "required", "since", "offers")
COLUMNS = ("code", "message", "line", "column", "severity", "symbol")


def decided(events: DataFrame, codes: tuple[str, ...]) -> DataFrame:
    """Issues of all one-event rules in one projection, which asks an event only for the rules of its kind, and the events that issues across files need.

    (file, seq, kind, code, message, line, column, severity, symbol) and the columns of links. An issue has no kind, and its seq is times STEP; a link has no code.
    """
    by_kind: dict[str, list[Callable[[], Column]]] = {}
    for code, (kinds, issues) in LOCAL.items():
        for kind in kinds if code in codes else ():
            by_kind.setdefault(kind, []).append(issues)
    none, found = F.array().cast(_ISSUE), None
    for kind, rules in by_kind.items():
        here = [F.coalesce(issues(), none) for issues in rules]
        issues = here[0] if len(here) == 1 else F.concat(*here)
        found = F.when(C("kind") == kind, issues) if found is None else found.when(C("kind") == kind, issues)
    link = _kind("module", "import") | _kind("call") & (C("value") == "import") & ~C("unreachable") if "E1120" in codes else F.lit(False)
    wanted = sorted({*by_kind, *(_LINKS if "E1120" in codes else ())})
    if found is None:
        return events.where("false").select("file", C("seq").cast("long").alias("seq"), "kind", *[F.lit(None).cast("int" if c in ("line", "column") else "string").alias(c) for c in COLUMNS], *_LINK_COLUMNS)
    # The array is a column before it is taken apart, within the generator it would be evaluated without generated code; and nothing is asked of it before that, since each filter would evaluate it again.
    flat = events.where(_kind(*wanted)).select("file", "seq", F.when(link, C("kind")).alias("kind"), "line", "column", *_LINK_COLUMNS, found.alias("found"))
    flat = flat.select("file", "seq", "kind", "line", "column", *_LINK_COLUMNS, F.posexplode_outer("found").alias("k", "i")).where(C("i").isNotNull() | C("kind").isNotNull())
    seq = F.when(C("i").isNull(), C("seq").cast("long")).otherwise(C("seq").cast("long") * STEP + C("k") + 1)
    return flat.select("file", seq.alias("seq"), "kind", *[F.coalesce(f"i.{c}", c).alias(c) if c in ("line", "column") else C(f"i.{c}").alias(c) for c in COLUMNS], *_LINK_COLUMNS)


def _paths(events: DataFrame, cwd: str) -> DataFrame:
    """(file, seq, name, wanted, rank, path) of each place where an imported module may be: beside its file, one folder up, in cwd."""
    folder = parent(C("file"))
    module = module_path(C("value"))
    places = [inside(folder, module), inside(parent(folder), module), inside(F.lit(cwd.rstrip("/")), module)]
    options = F.filter(F.array(*[F.struct(F.lit(k).alias("rank"), p.alias("path")) for k, p in enumerate(places)]), lambda o: o["path"].isNotNull())
    return events.where(_kind("import")).select("file", "seq", "name", F.get("names", F.lit(0)).alias("wanted"), F.explode(options).alias("o")).select("file", "seq", "name", "wanted", "o.rank", "o.path")


def unread_modules(events: DataFrame, cwd: str = "") -> DataFrame:
    """(path) where an import would look for a module that isn't among the files of events."""
    return _paths(events, cwd).select("path").distinct().join(events.where(_kind("module")).select(C("file").alias("path")), "path", "left_anti")


def imported(events: DataFrame, cwd: str = "", others: DataFrame | None = None) -> DataFrame:
    """(file, seq, name, required) of the functions that imports find.

    An import takes the first of its paths that is a file of events, or of others, which are events of modules that aren't linted; in it the first
    top-level def of the name counts.
    """
    every = events.where(_kind("module")).select(C("file").alias("path"), "offers")
    if others is not None:
        every = every.unionByName(others.where(_kind("module")).select(C("file").alias("path"), "offers"))
    paths = _paths(events, cwd)
    there = every.join(paths.select("path").distinct(), "path", "left_semi")
    # A row for the module itself and one for each function, and for an import a row that looks for either: a module that all import is joined by name.
    offers = F.split(F.concat(F.lit("\n"), F.coalesce("offers", F.lit(""))), "\n")
    offered = there.select("path", F.explode(F.array_distinct(offers)).alias("o")).select("path", F.split("o", " ").alias("o"))
    offered = offered.select("path", F.get("o", F.lit(0)).alias("key"), F.slice("o", F.lit(2), F.size("o")).alias("required"))
    met = paths.withColumn("key", F.explode(F.array(F.lit(""), C("wanted")))).join(offered, ["path", "key"])
    best = met.groupBy("file", "seq", "name").agg(F.min("rank").alias("rank"), F.min(F.when(C("key") != "", F.struct("rank", "required"))).alias("best"))
    return best.where("best.rank = rank").select("file", "seq", "name", "best.required")


def missing_arguments(events: DataFrame, cwd: str = "", others: DataFrame | None = None) -> DataFrame:
    """E1120 of names that were imported after the file's own function of that name, if any: a call takes the latest import before it that finds
    a function, or else that own one, unless it came later."""
    none = F.lit(None)
    known = imported(events, cwd, others).select("file", "name", "seq", "required", none.cast("int").alias("n"), none.cast("array<string>").alias("names"), none.cast("int").alias("since"), none.cast("int").alias("line"), none.cast("int").alias("column"))
    calls = events.where(_kind("call")).select(*known.columns)
    so_far = Window.partitionBy("file", "name").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    latest = F.last(F.when(C("n").isNull(), F.struct("seq", "required")), ignorenulls=True).over(so_far)
    met = known.unionByName(calls).withColumn("latest", latest).where(C("n").isNotNull())
    met = met.withColumn("required", F.when(C("latest.seq") > C("since"), C("latest.required")).otherwise(C("required"))).withColumn("lacking", _lacking())
    return met.where("lacking IS NOT NULL").select("file", (C("seq").cast("long") * STEP).alias("seq"), F.lit("E1120").alias("code"), message("E1120", C("lacking")).alias("message"), "line", "column", *_kinds("E1120"))


def issues(table: DataFrame, codes: tuple[str, ...] = LIVE, linked: DataFrame | None = None) -> DataFrame:
    """Issues of the given rules from what decided() returns, and those across files; seq orders those of a file as they are met."""
    found = table.where(C("code").isNotNull()).select("file", "seq", *COLUMNS)
    return found if linked is None else found.unionByName(linked.select("file", "seq", *COLUMNS))
