"""The planner: which rules run, what the parser has to report for them, and the issues table."""

from __future__ import annotations

import json
import os
import tomllib
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import LIVE
from ..operators import rules
from ..session import stash
from .parse import events as parse

COLUMNS = ("code", "message", "file", "line", "column", "severity", "symbol")
DEFAULT_PLACES = (".codesieverc", ".codesieve.toml", "codesieve.toml", ".config/codesieve.toml")


def codes_in(text: str | Iterable[str] | None) -> set[str]:
    """'E0103, E0104' or an iterable of codes; case counts."""
    if not text:
        return set()
    return {c for x in (text.split(",") if isinstance(text, str) else text) if (c := x.strip())}


@dataclass(frozen=True)
class Config:
    jobs: int = field(default_factory=lambda: os.cpu_count() or 1)
    output_format: str = "text"
    enabled_checkers: frozenset[str] = frozenset()
    disabled_checkers: frozenset[str] = frozenset()
    ignore_patterns: tuple[str, ...] = ()
    errors_only: bool = False
    verbose: bool = False

    @classmethod
    def from_file(cls, path: str | Path) -> Config:
        """TOML if the name ends so, JSON otherwise; every field must be there."""
        text = Path(path).read_text(encoding="utf-8")
        data = tomllib.loads(text) if str(path).endswith(".toml") else json.loads(text)
        if missing := [f for f in cls.__dataclass_fields__ if f not in data]:
            raise ValueError(f"{path}: missing {', '.join(missing)}")
        return cls(int(data["jobs"]), str(data["output_format"]).lower(), frozenset(data["enabled_checkers"]), frozenset(data["disabled_checkers"]), tuple(data["ignore_patterns"]), bool(data["errors_only"]), bool(data["verbose"]))

    @classmethod
    def from_default_places(cls, folder: str | Path = ".") -> Config:
        found = next((p for n in DEFAULT_PLACES if (p := Path(folder, n)).exists()), None)
        return cls.from_file(found) if found else cls()

    def with_options(self, enable: str | Iterable[str] | None = None, disable: str | Iterable[str] | None = None, errors_only: bool = False, output_format: str | None = None, jobs: int = 0, verbose: bool = False) -> Config:
        """Options on top of a file: code lists add to its lists."""
        return replace(
            self, enabled_checkers=self.enabled_checkers | codes_in(enable), disabled_checkers=self.disabled_checkers | codes_in(disable), errors_only=self.errors_only or errors_only,
            output_format=output_format or self.output_format, jobs=jobs or self.jobs, verbose=self.verbose or verbose,
        )


def chosen(enable: Iterable[str] = (), disable: Iterable[str] = (), errors_only: bool = False) -> tuple[str, ...]:
    """The rules that run. An enabled list leaves the disabled one without effect."""
    on, off = set(enable), set(disable)
    codes = [c for c in LIVE if (c in on if on else c not in off)]
    return tuple(c for c in codes if c[0] == "E") if errors_only else tuple(codes)


def lint(
    sources: DataFrame, enable: str | Iterable[str] | None = None, disable: str | Iterable[str] | None = None, errors_only: bool = False, cwd: str = "", materialize: bool | None = None, lookup: Callable[[DataFrame], DataFrame] | None = None,
    stored: bool = False,
) -> DataFrame:
    """Issues (code, message, file, line, column, severity, symbol, seq) of sources (file, source); seq orders those of one file.

    A module that can't be parsed has its one E0001 whatever rules run, unless those leave that code out. Where rules look across files
    the issues of single files and what those rules read are written to the shared folder first, so that nothing is parsed twice (materialize). lookup gets the paths
    (path) of imported modules that sources hasn't, and returns (file, source) of those that exist: their signatures are known, their issues aren't reported.
    stored: all issues lie in the shared folder, for callers that read them more than once.
    """
    codes = chosen(codes_in(enable), codes_in(disable), errors_only)
    table, across = rules.decided(parse(sources, rules.kinds_of(codes), sparse=True, needs=rules.needs_of(codes)), codes), "E1120" in codes
    if stored or (across if materialize is None else materialize):
        table = stash(table, "events")
    linked = None
    if across:
        others = stash(parse(lookup(rules.unread_modules(table, cwd)), ("module",), sparse=True), "imported") if lookup else None
        linked = rules.missing_arguments(table, cwd, others)
        if stored:
            linked = stash(linked, "linked")
    return rules.issues(table, codes, linked).select(*COLUMNS, "seq")


def keep(issues: DataFrame, enable: str | Iterable[str] | None = None, disable: str | Iterable[str] | None = None, errors_only: bool = False) -> DataFrame:
    """The same choice on an issues table that is already there."""
    on, off = codes_in(enable), codes_in(disable)
    if on:
        issues = issues.where(F.col("code").isin(*on))
    elif off:
        issues = issues.where(~F.col("code").isin(*off))
    return issues.where(F.col("severity") == "error") if errors_only else issues
