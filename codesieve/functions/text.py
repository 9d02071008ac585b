"""Scalar functions over columns, all without Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_placeholders(text: Column) -> Column:
    """Format places of a logging string: %x unless x is a parenthesis, white space or missing, with %% skipped; a brace before }, a digit or a colon."""
    plain = F.replace(text, F.lit("%%"), F.lit("\x01"))
    return F.regexp_count(plain, F.lit(r"%[^%(\s]")) + F.regexp_count(plain, F.lit(r"\{[}0-9:]"))


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of the character at a 0-based offset; only \\n ends a line."""
    before = F.substring(text, F.lit(1), offset)
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int")


def column_of(text: Column, offset: Column) -> Column:
    """1-based column, in characters."""
    return (F.length(F.substring_index(F.substring(text, F.lit(1), offset), "\n", -1)) + 1).cast("int")


def module_path(module: Column) -> Column:
    """a.b -> a/b.py"""
    return F.concat(F.replace(module, F.lit("."), F.lit("/")), F.lit(".py"))


def parent(path: Column) -> Column:
    """The folder of a path; empty if it has none, null for an empty path."""
    return F.when(path == "", None).when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def inside(folder: Column, name: Column) -> Column:
    return F.when(folder == "", name).otherwise(F.concat(folder, F.lit("/"), name))


def has_component(path: Column, names: list[str]) -> Column:
    """Whether one of the parts between slashes is one of the names."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, names)))


def is_python(path: Column) -> Column:
    """Extension py or pyi, of a file name that isn't the extension alone."""
    return path.rlike(r"[^/]\.pyi?$")
