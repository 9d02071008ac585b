"""One module -> its events: what rules need of the syntax tree, in visiting order, with the context each was met in.

The only code that runs in Python workers. It decides no rule: it says where a name couldn't be resolved and how it was known, what an event's
name was before or is last in its file, and leaves codes, messages and what lies across files to the plans over the event table. The traversal is
partial on purpose: what it doesn't enter has no events.

Most of the cost of a module is its parse, so nothing is done here for kinds of events that nobody asked for: without names to resolve none are
kept, without events in expressions those aren't entered, and a text without any of the words that its events need isn't walked at all.
"""

from __future__ import annotations

import ast
import bisect
import re
import sys
import warnings
from array import array
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from ..functions.catalog import BUILTINS

FIELDS = (
    "seq kind line column name value n in_function in_class current_class in_loop in_except in_async unreachable names places params decorators yields returns_value required since offers"
).split()
DDL = (
    "file string, seq int, kind string, line int, column int, name string, value string, n int, in_function boolean, in_class boolean, current_class string, in_loop boolean, "
    "in_except boolean, in_async boolean, unreachable boolean, names array<string>, places array<struct<name: string, line: int, column: int>>, "
    "params array<struct<name: string, kind: string, has_default: boolean>>, decorators array<string>, yields boolean, returns_value boolean, required array<string>, since int, offers string"
)
#: Kinds of events; a plan names those it wants.
KINDS = ("module", "syntax", "def", "module_def", "class", "return", "jump", "yield", "await", "raise", "raise_name", "stars", "star_target", "dict", "nested", "global", "nonlocal", "call", "log", "import", "unresolved")
_LOGGERS = ("LOG", "logger", "logging")
_LOG_METHODS = frozenset("debug info warning warn w error e critical d i".split())
_BUILTINS = frozenset(BUILTINS)
_BREAKS = re.compile(r"\r\n|\r|\n")
#: The words of which a text with such an event has at least one; kinds that aren't here may be anywhere.
_WORDS = {
    "module": ("def",), "syntax": (), "def": ("def",), "module_def": ("def", "class"), "class": ("class",), "return": ("return",), "jump": ("break", "continue"), "yield": ("yield",), "await": ("await",), "raise": ("raise",),
    "raise_name": ("raise",), "stars": ("*",), "star_target": ("*",), "dict": ("{",), "nested": ("global",), "global": ("global",), "nonlocal": ("nonlocal",), "call": ("(",), "log": ("(",), "import": ("import",),
}
#: Kinds that are met in expressions, or need the names met there.
_INSIDE = frozenset(("yield", "await", "dict", "call", "log", "global", "unresolved"))
#: Kinds that count where nothing is reachable too.
_LINKS = frozenset(("module", "module_def", "import"))


@contextmanager
def quiet() -> Iterator[None]:
    """For parsing: no warnings about the texts, and room for the nesting that the parser takes (it ends below 10,000, and a level is two calls)."""
    limit = sys.getrecursionlimit()
    try:
        sys.setrecursionlimit(max(limit, 30_000))
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            yield
    finally:
        sys.setrecursionlimit(limit)


def terminates(body: list[ast.stmt]) -> bool:
    """Whether some statement of the block leaves it: a jump, or an if whose two branches do."""
    return any(isinstance(s, (ast.Return, ast.Raise, ast.Continue, ast.Break)) or isinstance(s, ast.If) and bool(s.orelse) and terminates(s.body) and terminates(s.orelse) for s in body)


def last_else_terminates(node: ast.If) -> bool:
    while len(node.orelse) == 1 and isinstance(node.orelse[0], ast.If):
        node = node.orelse[0]
    return terminates(node.orelse)


def has_yield(body: list[ast.stmt]) -> bool:
    """A yield that is a statement of its own or the test of an if, through the blocks of if, for, while, try and with."""
    for s in body:
        if isinstance(s, ast.Expr) and isinstance(s.value, (ast.Yield, ast.YieldFrom)):
            return True
        if isinstance(s, ast.If) and isinstance(s.test, (ast.Yield, ast.YieldFrom)):
            return True
        if isinstance(s, (ast.If, ast.For, ast.While)) and (has_yield(s.body) or has_yield(s.orelse)):
            return True
        if isinstance(s, ast.With) and has_yield(s.body):
            return True
        if isinstance(s, ast.Try) and (has_yield(s.body) or any(has_yield(h.body) for h in s.handlers) or has_yield(s.orelse) or has_yield(s.finalbody)):
            return True
    return False


def stars(target: ast.expr) -> int:
    if isinstance(target, (ast.Tuple, ast.List)):
        return sum(map(stars, target.elts))
    return int(isinstance(target, ast.Starred))


def decorator_name(node: ast.expr) -> str | None:
    while isinstance(node, ast.Call):
        node = node.func
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


def key_text(value: Any) -> str | None:
    """A dict key as text: 1 and '1' are alike, true and false are lower case, whole floats have no point."""
    if value is None:
        return "None"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (str, int)):
        return str(value)
    if isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")):
            return "NaN" if value != value else "inf" if value > 0 else "-inf"
        text = repr(value)
        if "e" in text:
            text = format(value, "f") if abs(value) >= 1 else format(value, ".400f").rstrip("0")
            text = text.rstrip("0").rstrip(".") if "." in text else text
        return text.removesuffix(".0")
    return None


class Names(set):
    """A set of names that goes back to an earlier state at the cost of what changed since: branches and functions copy nothing."""

    def __init__(self) -> None:
        super().__init__()
        self.log: list[tuple[bool, str]] = []

    def add(self, name: str) -> None:
        if name not in self:
            super().add(name)
            self.log.append((True, name))

    def discard(self, name: str) -> None:
        if name in self:
            super().discard(name)
            self.log.append((False, name))

    def mark(self) -> int:
        return len(self.log)

    def since(self, mark: int) -> set[str]:
        """The names that are here and weren't at the mark."""
        first: dict[str, bool] = {}
        for added, name in self.log[mark:]:
            first.setdefault(name, added)
        return {name for name, added in first.items() if added and name in self}

    def back(self, mark: int) -> None:
        for added, name in reversed(self.log[mark:]):
            super().discard(name) if added else super().add(name)
        del self.log[mark:]


class Walker:
    """The events of modules. sparse: those that no rule can make an issue of are left out, by the context that the rules ask for too; needs: so are
    those of texts without the words for any issue, as rules.needs_of() has them."""

    #: Methods by node type, filled below.
    statements: dict[type, Callable] = {}
    expressions: dict[type, Callable] = {}

    def __init__(self, wanted: frozenset[str] = frozenset(KINDS), sparse: bool = False, needs: tuple | None = None) -> None:
        self.wanted, self.sparse, self.needs = wanted, sparse, needs
        self.calls, self.resolve = "call" in wanted, "unresolved" in wanted
        self.signs, self.again = not wanted.isdisjoint(("def", "call")), "class" in wanted
        if _INSIDE.isdisjoint(wanted):
            self.expressions = {}
        # Without any of these words a text has no wanted event but 'module' and 'syntax'.
        self.words = None if wanted - _WORDS.keys() else tuple(dict.fromkeys(w for kind in wanted for w in _WORDS[kind]))
        self.locals, self.sure, self.maybe = Names(), Names(), Names()

    def start(self, source: str) -> None:
        self.source, self.events, self.seq, self.lines = source, [], 0, None
        self.plain = source.isascii() and "\r" not in source
        self.in_function = self.in_class = self.in_except = self.in_async = self.unreachable = False
        self.loops, self.current_class = 0, None
        self.module_defs: dict[str, ast.stmt] = {}  # the last of each name at the top
        self.track, self.nested = "global" in self.wanted and "global" in source, "nested" in self.wanted and "nonlocal" in source
        self.usages: dict[str, list[ast.Name]] = {}
        if self.resolve:
            self.args: set[str] = set()
            for names in (self.locals, self.sure, self.maybe):
                if names.log:
                    names.clear()
                    names.log.clear()
            self.module_maybe: set[str] = set()
            self.declared: set[str] = set()  # global and nonlocal names, for the rest of the file
            self.imports: set[str] = set()
        if self.again:
            self.members: dict[tuple[str | None, str], int] = {}  # the line of the first definition in classes of a name
        if self.calls:
            self.signed: dict[str, tuple[list[str], int]] = {}  # what the file's own latest function requires, and the seq of its def
            self.linked: set[str] = set()  # names that were imported after that
            self.asked: set[str] = set()  # those of them that were called then

    # -- output --------------------------------------------------------------------------------------------------------------

    def place(self, node: Any) -> tuple[int, int]:
        """Line and column from 1; columns count characters, and only \\n ends a line."""
        line, offset = node.lineno, node.col_offset
        if self.plain:
            return line, offset + 1
        if self.lines is None:
            self.ascii, self.chars = self.source.isascii(), {}
            cuts = [0, *[m.end() for m in _BREAKS.finditer(self.source)]] if "\r" in self.source else None
            self.cuts = cuts
            self.ends = [k for k, c in enumerate(self.source) if c == "\n"] if cuts else None
            self.lines = _BREAKS.split(self.source)
        if not self.ascii and not (text := self.lines[line - 1]).isascii():
            if line not in self.chars:  # the character of each byte, once for a line
                self.chars[line] = array("I", [k for k, c in enumerate(text) for _ in range(len(c.encode("utf-8", "surrogatepass")))] + [len(text)])
            offset = self.chars[line][offset]
        if self.cuts is not None:
            at = self.cuts[line - 1] + offset
            k = bisect.bisect_left(self.ends, at)
            return k + 1, at - (self.ends[k - 1] if k else -1)
        return line, offset + 1

    def emit(
        self, kind: str, node: Any = None, at: tuple[int, int] | None = None, name=None, value=None, n=None, names=None, places=None, params=None, decorators=None, yields=None, returns_value=None, required=None, since=None, offers=None, idle: bool = False
    ) -> None:
        """A tuple in the order of FIELDS. idle: no rule looks at it."""
        self.seq += 1
        if kind not in self.wanted or self.sparse and (idle or self.unreachable and kind not in _LINKS):
            return
        line, column = at or self.place(node)
        self.events.append((self.seq, kind, line, column, name, value, n, self.in_function, self.in_class, self.current_class, self.loops > 0, self.in_except, self.in_async, self.unreachable, names, places, params, decorators, yields, returns_value, required, since, offers))

    def run(self, source: str) -> list[tuple]:
        """The events of a module. Within quiet() only."""
        self.start(source)
        idle = self.words is not None and not any(w in source for w in self.words)
        if self.needs and not idle:
            idle = not any(all(sum(map(source.count, words)) >= n for n, words in groups) for groups in self.needs)
        if not source or idle and "syntax" not in self.wanted:
            self.emit("module", at=(1, 1))
            return self.events
        try:
            tree = compile(source, "<unknown>", "exec", ast.PyCF_ONLY_AST, dont_inherit=True)
            self.module([] if idle else tree.body)
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
            self.events, self.seq, self.unreachable = [], 0, False
            self.emit("module", at=(1, 1))
            text = e.msg if isinstance(e, SyntaxError) and e.msg else "too deeply nested" if isinstance(e, (RecursionError, MemoryError)) else str(e)
            self.emit("syntax", at=(getattr(e, "lineno", None) or 1, getattr(e, "offset", None) or 1), name=text)
        return self.events

    def module(self, body: list[ast.stmt]) -> None:
        offered: dict[str, str] = {}  # of each name the first function, which imports take: a line of its name and those that it requires
        for s in body:
            if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                self.module_defs[s.name] = s
                if "module" in self.wanted and isinstance(s, ast.FunctionDef) and s.name not in offered:
                    offered[s.name] = " ".join([s.name, *required(params(s.args))])
        self.emit("module", at=(1, 1), offers="\n".join(offered.values()) or None)
        if "module_def" in self.wanted:
            for s in body:
                if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    plain = isinstance(s, ast.FunctionDef)
                    self.emit("module_def", s, name=s.name, value="def" if plain else "async" if isinstance(s, ast.AsyncFunctionDef) else "class", params=params(s.args) if plain else None)
        self.block(body)
        if self.calls and self.sparse and "import" in self.wanted:
            self.events = [e for e in self.events if e[1] != "import" or e[4] in self.asked]

    def redefined(self, node: Any) -> tuple[int | None, list[tuple[str, int, int]] | None]:
        """For a definition in a class the line of the first one of its name before it there; at the top the place of the module's last one of its name, if that is another."""
        if self.in_class:
            key = self.current_class, node.name
            first = self.members.get(key)
            if first is None:
                self.members[key] = self.place(node)[0]
            return first, None
        last = None if self.in_function else self.module_defs.get(node.name)
        return None, [(node.name, *self.place(last))] if last is not None and last is not node else None

    # -- statements ----------------------------------------------------------------------------------------------------------

    def block(self, body: list[ast.stmt]) -> None:
        get = self.statements.get
        for s in body:
            visit = get(type(s))
            if visit:
                visit(self, s)

    def stmt_AsyncFunctionDef(self, f: ast.AsyncFunctionDef) -> None:
        self.function(f, True)

    def stmt_FunctionDef(self, f: ast.FunctionDef) -> None:
        self.function(f, False)

    def function(self, f: Any, is_async: bool) -> None:
        before_async, self.in_async = self.in_async, is_async
        every = params(f.args) if self.signs else ()
        given = {p[0] for p in every}
        if "def" in self.wanted:
            self.definition(f, is_async, every, given)
        else:
            self.seq += 1
        if self.calls and not self.in_class and not self.in_function:
            self.signed[f.name] = required(every), self.seq
            self.linked.discard(f.name)
        before, self.usages = (self.in_function, self.usages), {}
        if self.resolve:
            if self.in_function:
                self.locals.add(f.name)
                self.sure.add(f.name)
            marks, before_args = (len(self.locals.log), len(self.sure.log), len(self.maybe.log)), self.args
            if not self.signs:
                given = {p[0] for p in params(f.args)}
            self.args = given | before_args if self.in_function else given
        self.in_function = True
        if self.nested:
            for s in f.body:
                if isinstance(s, ast.FunctionDef):
                    said: dict[type, set[str]] = {ast.Global: set(), ast.Nonlocal: set()}
                    for x in s.body:
                        if type(x) in said:
                            said[type(x)].update(x.names)
                    if both := said[ast.Global] & said[ast.Nonlocal]:
                        self.emit("nested", s, names=sorted(both))
        self.block(f.body)
        self.in_function, self.usages = before
        if self.resolve:
            self.args = before_args
            for names, mark in zip((self.locals, self.sure, self.maybe), marks):
                if len(names.log) > mark:
                    names.back(mark)
        self.in_async = before_async

    def definition(self, f: Any, is_async: bool, every: list[tuple[str, str, bool]], given: set[str]) -> None:
        first, last = self.redefined(f) if self.again else (None, None)
        init = f.name == "__init__"
        yields, returns = (has_yield(f.body), any(isinstance(s, ast.Return) and s.value is not None for s in f.body)) if init or not self.sparse else (None, None)
        if self.sparse and not (yields or returns or first or last) and len(given) == len(every):
            method = self.in_class and not self.in_function
            if not method or every and every[0][:2] == ("self", "positional") and not f.decorator_list:
                self.seq += 1
                return
        decorators = [d for x in f.decorator_list if (d := decorator_name(x))]
        self.emit("def", f, name=f.name, value="async" if is_async else "def", n=first, places=last, params=every, decorators=decorators, yields=yields, returns_value=returns)

    def stmt_ClassDef(self, c: ast.ClassDef) -> None:
        first, last = self.redefined(c) if self.again else (None, None)
        self.emit("class", c, name=c.name, n=first, places=last, idle=not first and not last)
        if self.resolve and self.in_function and not self.in_class:
            self.locals.add(c.name)
            self.sure.add(c.name)
        before = self.in_class, self.current_class
        self.in_class, self.current_class = True, c.name
        self.block(c.body)
        self.in_class, self.current_class = before

    def stmt_Return(self, s: ast.Return) -> None:
        self.emit("return", s, idle=self.in_function)
        self.expr(s.value)

    def stmt_Break(self, s: ast.Break) -> None:
        self.emit("jump", s, name="'break'", idle=self.loops > 0)

    def stmt_Continue(self, s: ast.Continue) -> None:
        self.emit("jump", s, name="'continue'", idle=self.loops > 0)

    def stmt_Raise(self, s: ast.Raise) -> None:
        if s.exc is None:
            self.emit("raise", s, idle=self.in_except)
        elif isinstance(s.exc, ast.Name) and s.exc.id == "NotImplemented":
            self.emit("raise_name", s.exc)
        self.expr(s.exc)
        self.expr(s.cause)

    def stmt_For(self, s: Any) -> None:
        self.loops += 1
        self.expr(s.iter)
        self.bind(s.target)
        self.block(s.body)
        self.block(s.orelse)
        self.loops -= 1

    stmt_AsyncFor = stmt_For

    def stmt_While(self, s: ast.While) -> None:
        self.loops += 1
        self.expr(s.test)
        self.block(s.body)
        self.block(s.orelse)
        self.loops -= 1

    def stmt_With(self, s: Any) -> None:
        for item in s.items:
            self.expr(item.context_expr)
            target = item.optional_vars
            for name in target.elts if isinstance(target, ast.Tuple) else (target,):
                if self.resolve and isinstance(name, ast.Name):
                    self.locals.add(name.id)
                    self.sure.add(name.id)
        self.block(s.body)

    stmt_AsyncWith = stmt_With

    def doubt(self, names: set[str], at_module: bool = True, as_local: bool = True) -> None:
        """The names may be assigned from here on."""
        for name in names:
            self.maybe.add(name)
            if self.in_function and as_local:
                self.locals.add(name)
        if at_module and not self.in_function and not self.in_class:
            self.module_maybe |= names

    def settle(self, known: Callable[[str], bool]) -> None:
        """Names that are sure and known aren't in doubt any more."""
        for name in self.maybe & self.sure:
            if known(name):
                self.maybe.discard(name)

    # Blocks only add to what is sure before them, so a branch is what it adds; handlers alone take a name away, their own, and only for themselves.

    def stmt_If(self, s: ast.If) -> None:
        self.expr(s.test)
        hidden = self.unreachable
        start = self.sure.mark() if self.resolve else 0
        self.unreachable = hidden or isinstance(s.test, ast.Constant) and s.test.value is False
        self.block(s.body)
        self.unreachable = hidden
        if not self.resolve:
            self.block(s.orelse)
            return
        then = self.sure.since(start)
        self.sure.back(start)
        if not s.orelse:
            self.doubt(then)
            return
        self.block(s.orelse)
        other = self.sure.since(start)
        if last_else_terminates(s):
            for name in then:
                self.sure.add(name)
            self.settle(lambda name: True)
        else:
            for name in other - then:
                self.sure.discard(name)
            if self.in_function:
                self.settle(lambda name: name not in then)
        self.doubt({name for name in then | other if name not in self.sure})

    def stmt_Try(self, s: ast.Try) -> None:
        if not self.resolve:
            self.block(s.body)
            before_except, self.in_except = self.in_except, True
            for h in s.handlers:
                self.block(h.body)
            self.in_except = before_except
            self.block(s.orelse)
            self.block(s.finalbody)
            return
        start, unsure = self.sure.mark(), self.maybe.mark()
        self.block(s.body)
        tried, doubted = self.sure.since(start), self.maybe.since(unsure)
        leave = bool(s.handlers) and all(terminates(h.body) for h in s.handlers)
        self.sure.back(start)
        if s.handlers and not leave:
            self.doubt(tried | {name for name in doubted if name not in self.sure}, at_module=False)
        common, own = None, {h.name for h in s.handlers if h.name}
        for h in s.handlers:
            mark, before_except, self.in_except = self.sure.mark(), self.in_except, True
            if h.name:
                for names in (self.locals, self.sure, self.args):
                    names.add(h.name)
            self.block(h.body)
            if h.name:
                for names in (self.locals, self.sure, self.args):
                    names.discard(h.name)
            self.in_except = before_except
            added = self.sure.since(mark)
            common = added if common is None else common & added
            self.sure.back(mark)
        if common is None or leave:
            for name in tried:
                self.sure.add(name)
        else:
            both = tried & common
            for name in both:
                self.sure.add(name)
            self.settle(lambda name: name in both or name not in own)
        if s.orelse:
            self.sure.back(start)
            for name in tried:
                self.sure.add(name)
            self.block(s.orelse)
            self.sure.back(start)
            self.doubt(tried, at_module=False, as_local=False)
        self.block(s.finalbody)

    def stmt_Global(self, s: ast.Global) -> None:
        for name in s.names:
            used = self.usages.get(name)
            self.emit("global", s, name=name, places=[(name, *self.place(e)) for e in used] if used else None, idle=not used)
            if self.resolve:
                self.declared.add(name)

    def stmt_Nonlocal(self, s: ast.Nonlocal) -> None:
        for name in s.names:
            self.emit("nonlocal", s, name=name, idle=self.in_function)
            if self.resolve:
                self.declared.add(name)

    def stmt_Expr(self, s: ast.Expr) -> None:
        self.expr(s.value)

    def stmt_Assign(self, s: ast.Assign) -> None:
        self.expr(s.value)
        if "stars" in self.wanted and (n := sum(map(stars, s.targets))) > 0:
            self.emit("stars", s, n=n, idle=n < 2)
        for t in s.targets:
            if isinstance(t, ast.Starred):
                self.emit("star_target", s)
            self.bind(t)

    def stmt_AnnAssign(self, s: ast.AnnAssign) -> None:
        if s.value is not None:
            self.expr(s.value)
            self.bind(s.target)

    def bind(self, target: ast.expr) -> None:
        if not self.resolve:
            return
        if isinstance(target, ast.Name):
            if self.in_function:
                self.locals.add(target.id)
            self.sure.add(target.id)
            self.maybe.discard(target.id)
        elif isinstance(target, (ast.Tuple, ast.List)):
            for t in target.elts:
                self.bind(t)

    def stmt_Import(self, s: ast.Import) -> None:
        if self.resolve:
            self.imports.update(a.asname or a.name for a in s.names)

    def stmt_ImportFrom(self, s: ast.ImportFrom) -> None:
        if s.module:
            for a in s.names:
                name = a.asname or a.name
                if self.resolve:
                    self.imports.add(name)
                if self.calls:
                    self.linked.add(name)
                self.emit("import", s, name=name, value=s.module, names=[a.name])

    # -- expressions ---------------------------------------------------------------------------------------------------------

    def expr(self, e: ast.expr | None) -> None:
        visit = self.expressions.get(type(e))
        if visit:
            visit(self, e)

    def expr_Name(self, e: ast.Name) -> None:
        name = e.id
        if self.track and self.in_function:
            self.usages.setdefault(name, []).append(e)
        if not self.resolve or name in self.sure or name in self.args or name in self.declared or name in self.imports or name in self.module_defs:
            return
        if self.in_function:
            known = ("local_conditional" if name in self.maybe else "local") if name in self.locals else "module_conditional" if name in self.module_maybe else "unknown"
        else:
            known = "conditional" if name in self.maybe else "unknown"
        if known == "unknown" and name in _BUILTINS:  # most names that aren't found; no rule asks for them
            return
        self.emit("unresolved", e, name=name, value=known)

    def expr_Yield(self, e: Any) -> None:
        self.emit("yield", e, idle=self.in_function)

    expr_YieldFrom = expr_Yield

    def expr_Call(self, e: ast.Call) -> None:
        f = e.func
        if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id in _LOGGERS and f.attr in _LOG_METHODS:
            first = e.args[0] if e.args else None
            if isinstance(first, ast.Constant) and isinstance(first.value, str):
                self.emit("log", e, value=first.value, n=len(e.args), idle=len(e.args) < 2)
        elif self.calls and isinstance(f, ast.Name):
            need, since = self.signed.get(f.id, (None, 0))
            linked, n = f.id in self.linked, len(e.args)
            if self.sparse and not linked and (need is None or len(need) <= n):
                self.seq += 1
            else:
                if linked and not self.unreachable:
                    self.asked.add(f.id)
                self.emit("call", e, name=f.id, value="import" if linked else None, n=n, names=[k.arg for k in e.keywords if k.arg], required=need, since=since)
        self.expr(f)
        for a in e.args:
            self.expr(a)
        for k in e.keywords:
            self.expr(k.value)

    def expr_Tuple(self, e: Any) -> None:
        for x in e.elts:
            self.expr(x)

    expr_List = expr_Tuple

    def expr_Dict(self, e: ast.Dict) -> None:
        keys = [(text, k) for k in e.keys if isinstance(k, ast.Constant) and (text := key_text(k.value)) is not None] if "dict" in self.wanted else []
        if len(keys) > 1:
            idle = self.sparse and len({text for text, _ in keys}) == len(keys)
            self.emit("dict", e, places=None if idle else [(text, *self.place(k)) for text, k in keys], idle=idle)
        for k in e.keys:
            self.expr(k)
        for v in e.values:
            self.expr(v)

    def expr_BinOp(self, e: ast.BinOp) -> None:
        self.expr(e.left)
        self.expr(e.right)

    def expr_UnaryOp(self, e: ast.UnaryOp) -> None:
        self.expr(e.operand)

    def expr_JoinedStr(self, e: ast.JoinedStr) -> None:
        for v in e.values:
            self.expr(v)

    def expr_FormattedValue(self, e: ast.FormattedValue) -> None:
        self.expr(e.value)

    def expr_Await(self, e: ast.Await) -> None:
        self.emit("await", e, idle=self.in_async)
        self.expr(e.value)


Walker.statements.update({getattr(ast, k[5:]): f for k, f in vars(Walker).items() if k.startswith("stmt_")})
Walker.expressions.update({getattr(ast, k[5:]): f for k, f in vars(Walker).items() if k.startswith("expr_")})


def params(a: ast.arguments) -> list[tuple[str, str, bool]]:
    """(name, kind, has a default) in the order positional-only, positional, keyword-only, *, **."""
    plain = [*a.posonlyargs, *a.args] if a.posonlyargs else a.args
    first = len(plain) - len(a.defaults)
    if not (a.posonlyargs or a.kwonlyargs or a.vararg or a.kwarg):
        return [(x.arg, "positional", k >= first) for k, x in enumerate(plain)]
    found = [(x.arg, "positional_only" if k < len(a.posonlyargs) else "positional", k >= first) for k, x in enumerate(plain)]
    found += [(x.arg, "keyword_only", d is not None) for x, d in zip(a.kwonlyargs, a.kw_defaults)]
    found += [(x.arg, kind, False) for x, kind in ((a.vararg, "varargs"), (a.kwarg, "kwargs")) if x]
    return found


def required(every: list[tuple[str, str, bool]]) -> list[str]:
    """The names of params() that take a position and have no default."""
    return [name for name, kind, default in every if not default and kind in ("positional_only", "positional")]
