"""Chat formatting: a compiler for a sandboxed template language.

A template is parsed into a syntax tree, constants are folded, and every node becomes a Python closure; rendering is a
stream of (text, under the generation mark), so a conversation of any length takes little memory. Templates can read the values
they are given and call the filters below, and nothing else: names and items that begin with an underscore don't exist, and
there are no calls, attributes of Python objects, imports or loops without a list.

    {{ expression }}   {% for x in xs %} ... {% endfor %}   {% if a %} ... {% elif b %} ... {% else %} ... {% endif %}
    {% set x = expression %}   {% generation %} ... {% endgeneration %}   {# comment #}   a minus sign inside a tag strips white space

Expressions: strings, numbers, true, false, none, lists, names, a.b, a['b'], a[0], filters with |, + - * / // % ~, comparisons, in, not in, and, or,
not, x if c else y, and "is (not) defined / none / string". In a for: loop.index, loop.index0, loop.first, loop.last.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ship, stash

#: Strings that mean something to some chat format; inside a text each is broken up by the escape sign.
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "\\"
DEFAULT = (
    "{% for m in messages %}<|turn|>{{ m.role | escape_line }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}<|end|>\n{% endfor %}"
)
PART_CHARS = 1 << 20
_CONTROL = re.compile("|".join([re.escape(ESCAPE), *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS)]))
_ESCAPED = re.compile(rf"{re.escape(ESCAPE)}(.)", re.S)


class TemplateError(ValueError):
    pass


def escape(text: str) -> str:
    """Breaks every control string after its first character and doubles the escape sign; unescape() undoes it for any text."""
    return _CONTROL.sub(lambda m: ESCAPE * 2 if m[0] == ESCAPE else m[0] + ESCAPE, text)


def escape_line(text: str) -> str:
    """escape(), with the escape sign before every line end as well, so that the first line end without one ends the text."""
    return escape(text).replace("\n", ESCAPE + "\n")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


FILTERS: dict[str, Callable] = {"escape": lambda x: escape(str(x)), "escape_line": lambda x: escape_line(str(x)), "trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(), "title": lambda x: str(x).title(), "length": len, "string": str, "first": lambda x: next(iter(x), None), "default": lambda x: "" if x is None else x}

# --- Syntax tree: tuples whose first entry names the node -------------------------------------------------------------------

_TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?).*?(-?)#\}", re.S)
_LEX = re.compile(r"""\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|//|[-+*/%~<>|.,()\[\]=]))""", re.S)
_CONSTANTS = {"true": True, "True": True, "false": False, "False": False, "none": None, "None": None}
_WORDS = {"and", "or", "not", "in", "is", "if", "else"}
_SIGNS = {"n": "\n", "t": "\t", "r": "\r"}


class _Reader:
    def __init__(self, source: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(source) and source[at:].strip():
            m = _LEX.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:at + 20]!r}")
            self.tokens.append((m.lastgroup or "", m[m.lastgroup or 0]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> bool:
        found = self.peek(*values)
        self.at += found
        return found

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name" or self.tokens[self.at][1] in _WORDS:
            raise TemplateError("a name is missing")
        self.at += 1
        return _allowed(self.tokens[self.at - 1][1])

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} isn't expected")

    def whole(self) -> tuple:
        node = self.choice()
        self.end()
        return node

    def choice(self) -> tuple:
        node = self.either()
        if self.take("if"):
            test = self.either()
            node = ("if", test, node, self.choice() if self.take("else") else ("const", ""))
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        node = self.sum()
        while True:
            if self.take("is"):
                no = self.take("not")
                node = ("test", self.name() if not self.peek("none") else self.tokens[self.at][1], node)
                if node[1] == "none":
                    self.at += self.peek("none")
                node = ("not", node) if no else node
            elif self.peek("not") and self.tokens[self.at + 1 : self.at + 2] == [("name", "in")]:
                self.at += 2
                node = ("not", ("op", "in", node, self.sum()))
            elif self.peek("==", "!=", "<", ">", "<=", ">=", "in"):
                self.at += 1
                node = ("op", self.tokens[self.at - 1][1], node, self.sum())
            else:
                return node

    def sum(self) -> tuple:
        node = self.product()
        while self.peek("+", "-", "~"):
            self.at += 1
            node = ("op", self.tokens[self.at - 1][1], node, self.product())
        return node

    def product(self) -> tuple:
        node = self.filtered()
        while self.peek("*", "/", "//", "%"):
            self.at += 1
            node = ("op", self.tokens[self.at - 1][1], node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = ("op", "-", ("const", 0), self.filtered()) if self.take("-") else self.item()
        while self.take("|"):
            if (name := self.name()) not in FILTERS:
                raise TemplateError(f"there is no filter {name!r}")
            node = ("filter", name, node)
        return node

    def item(self) -> tuple:
        node = self.atom()
        while True:
            if self.take("."):
                node = ("get", node, ("const", self.name()))
            elif self.take("["):
                node = ("get", node, self.choice())
                self.need("]")
            else:
                return node

    def atom(self) -> tuple:
        if self.take("("):
            node = self.choice()
            self.need(")")
            return node
        if self.take("["):
            items = []
            while not self.take("]"):
                items.append(self.choice())
                if not self.peek("]"):
                    self.need(",")
            return ("list", *items)
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, value = self.tokens[self.at]
        if kind == "name" and value in _CONSTANTS:
            self.at += 1
            return ("const", _CONSTANTS[value])
        if kind == "name":
            return ("name", self.name())
        self.at += 1
        if kind == "num":
            return ("const", float(value) if "." in value else int(value))
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _SIGNS.get(m[1], m[1]), value[1:-1], flags=re.S))
        raise TemplateError(f"{value!r} isn't expected")


def _allowed(name: str) -> str:
    if name.startswith("_"):
        raise TemplateError(f"{name!r} isn't open to templates")
    return name


def parse(template: str) -> tuple:
    """The syntax tree: ("block", node, ...)."""
    stack: list[tuple[list, list]] = [([], [])]  # (what opened it, nodes so far)
    last, strip = 0, False

    def text(s: str, cut: bool) -> None:
        s = s.lstrip() if strip else s
        s = s.rstrip() if cut else s
        if s:
            stack[-1][1].append(("text", s))

    def close(*kinds: str) -> tuple[list, tuple]:
        head, nodes = stack.pop()
        if not stack or not head or head[0] not in kinds:
            raise TemplateError(f"the end of {' or '.join(kinds)} opens nothing")
        return head, ("block", *nodes)

    for m in _TAG.finditer(template):
        text(template[last : m.start()], bool(m[1] or m[4] or m[7]))
        last, strip = m.end(), bool(m[3] or m[6] or m[8])
        if m[2] is not None:
            stack[-1][1].append(("out", _Reader(m[2]).whole()))
        elif m[5] is not None:
            r = _Reader(m[5])
            word = r.tokens[0][1] if r.tokens else ""
            r.at = 1
            if word == "for":
                name = r.name()
                r.need("in")
                stack.append((["for", name, r.choice()], []))
            elif word == "if":
                stack.append((["if", r.choice()], []))
            elif word in ("elif", "else") and stack[-1][0][:1] == ["if"]:
                head, body = close("if")
                more = r.choice() if word == "elif" else ("const", True)
                stack.append((["if", *head[1:], body, more], []))
            elif word == "endif":
                head, body = close("if")
                stack[-1][1].append(("cases", *head[1:], body))
            elif word == "endfor":
                head, body = close("for")
                stack[-1][1].append(("for", head[1], head[2], body))
            elif word == "generation":
                stack.append((["generation"], []))
            elif word == "endgeneration":
                body = close("generation")[1]
                stack[-1][1].append(("generation", body))
            elif word == "set":
                name = r.name()
                r.need("=")
                stack[-1][1].append(("set", name, r.choice()))
            else:
                raise TemplateError(f"there is no tag {word!r}")
            r.end()
    text(template[last:], False)
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0][0]} has no end")
    return ("block", *stack[0][1])


# --- Constant folding -------------------------------------------------------------------------------------------------------

_OPS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b, "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: _times(a, b), "/": lambda a, b: a / b, "//": lambda a, b: a // b, "%": lambda a, b: _remainder(a, b), "~": lambda a, b: _show(a) + _show(b),
}
_TESTS: dict[str, Callable] = {"defined": lambda x: x is not None, "none": lambda x: x is None, "string": lambda x: isinstance(x, str)}
_PURE = {"op", "filter", "test", "not", "and", "or", "if", "get", "list"}


def _times(a, b):
    if isinstance(a, (str, list)) or isinstance(b, (str, list)):
        raise TemplateError("only numbers multiply")
    return a * b


def _remainder(a, b):
    if isinstance(a, str):
        raise TemplateError("only numbers have remainders")
    return a % b


def _show(x) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


def fold(node: tuple) -> tuple:
    """The tree without what is known before rendering: constant expressions, cases that never or always hold, texts side by side."""
    kind = node[0]
    if kind in ("const", "text", "name"):
        return node
    node = (kind, *[fold(x) if isinstance(x, tuple) else x for x in node[1:]])
    if kind in _PURE and all(x[0] == "const" for x in node[1:] if isinstance(x, tuple)):
        try:
            return ("const", _expression(node)({}))
        except (TypeError, ArithmeticError) as e:
            raise TemplateError(str(e)) from e
    if kind == "out" and node[1][0] == "const":
        return ("text", _show(node[1][1]))
    if kind == "cases":
        cases = []
        for test, body in zip(node[1::2], node[2::2]):
            if test[0] != "const":
                cases += (test, body)
            elif test[1]:
                if not cases:
                    return body
                return ("cases", *cases, test, body)
        return ("cases", *cases) if cases else ("block",)
    if kind == "block":
        flat: list[tuple] = []
        for x in chain.from_iterable(x[1:] if x[0] == "block" else (x,) for x in node[1:]):
            if x[0] == "text" and flat and flat[-1][0] == "text":
                flat[-1] = ("text", flat[-1][1] + x[1])
            elif x != ("text", ""):
                flat.append(x)
        return ("block", *flat)
    return node


# --- Closures ---------------------------------------------------------------------------------------------------------------

Piece = tuple[str, bool]


def _expression(node: tuple) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        value = node[1]
        return lambda env: value
    if kind == "name":
        name = node[1]
        return lambda env: env.get(name)
    if kind == "get":
        of, key = _expression(node[1]), _expression(node[2])

        def get(env: dict) -> object:
            x, k = of(env), key(env)
            if isinstance(k, str):
                _allowed(k)
                return x.get(k) if isinstance(x, dict) else None
            return x[k] if isinstance(x, (list, str)) and isinstance(k, int) and -len(x) <= k < len(x) else None

        return get
    if kind == "list":
        items = [_expression(x) for x in node[1:]]
        return lambda env: [x(env) for x in items]
    if kind == "op":
        do, a, b = _OPS[node[1]], _expression(node[2]), _expression(node[3])
        return lambda env: do(a(env), b(env))
    if kind in ("filter", "test"):
        table = FILTERS if kind == "filter" else _TESTS
        if node[1] not in table:
            raise TemplateError(f"there is no {kind} {node[1]!r}")
        do, a = table[node[1]], _expression(node[2])
        return lambda env: do(a(env))
    if kind == "not":
        a = _expression(node[1])
        return lambda env: not a(env)
    a, b = _expression(node[1]), _expression(node[2])
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    c = _expression(node[3])
    return lambda env: b(env) if a(env) else c(env)


def _closure(node: tuple, mark: bool = False) -> Callable[[dict], Iterator[Piece]]:
    kind = node[0]
    if kind == "text":
        piece = (node[1], mark)
        return lambda env: iter((piece,))
    if kind == "out":
        of = _expression(node[1])
        return lambda env: iter(((_show(of(env)), mark),))
    if kind == "set":
        name, of = node[1], _expression(node[2])

        def assign(env: dict) -> Iterator[Piece]:
            env[name] = of(env)
            return iter(())

        return assign
    if kind == "generation":
        return _closure(node[1], True)
    if kind == "cases":
        cases = [(_expression(t), _closure(b, mark)) for t, b in zip(node[1::2], node[2::2])]

        def choose(env: dict) -> Iterator[Piece]:
            for test, body in cases:
                if test(env):
                    yield from body(env)
                    return

        return choose
    if kind == "for":
        name, of, body = node[1], _expression(node[2]), _closure(node[3], mark)

        def loop(env: dict) -> Iterator[Piece]:
            items = iter(of(env) or ())
            own, k, item = dict(env), 0, next(items, _closure)
            while item is not _closure:  # a place that no list holds
                after = next(items, _closure)
                own[name] = item
                own["loop"] = {"index": k + 1, "index0": k, "first": k == 0, "last": after is _closure}
                yield from body(own)
                item, k = after, k + 1

        return loop
    bodies = [_closure(x, mark) for x in node[1:]]

    def block(env: dict) -> Iterator[Piece]:
        for body in bodies:
            yield from body(env)

    return block


class Template:
    """render() gives the pieces of a conversation; messages may be any iterable of {"role": ..., "text": ...} and is read once."""

    def __init__(self, source: str = DEFAULT) -> None:
        self.tree = fold(parse(source))
        self.run = _closure(self.tree)

    def render(self, messages: Iterable[dict], **values: object) -> Iterator[Piece]:
        return self.run({"messages": messages, **values})


# --- Over a table -----------------------------------------------------------------------------------------------------------


def _groups(batches: Iterator[pa.RecordBatch], key: str, columns: tuple[str, ...]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Runs of one key over sorted batches, each a stream that must be read before the next."""
    rows = (row for b in batches for row in zip(b.column(key).to_pylist(), *(b.column(c).to_pylist() for c in columns)))
    held = next(rows, None)
    while held is not None:
        here, box = held[0], [held]

        def run() -> Iterator[tuple]:
            row = box[0]
            while row is not None and row[0] == here:
                yield row[1:]
                row = next(rows, None)
            box[0] = row

        stream = run()
        yield here, stream
        for _ in stream:
            pass
        held = box[0]


_PART = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("text", pa.string()), ("spans", pa.list_(pa.int64()))])
_PART_DDL = "conv_id long, part long, text string, spans array<long>"


def _format(source: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    template, rows, size = Template(source), [], 0
    for conv, turns in _groups(batches, "conv_id", ("role", "text")):
        text, spans, at, part = [], [], 0, 0
        for piece, mark in template.render({"role": role or "", "text": t or ""} for role, t in turns):
            if mark and piece:
                if spans and spans[-1] == at:
                    spans[-1] = at + len(piece)
                else:
                    spans += (at, at + len(piece))
            text.append(piece)
            at += len(piece)
            if at >= PART_CHARS:
                rows.append((conv, part, "".join(text), spans))
                size, text, spans, at, part = size + at, [], [], 0, part + 1
                if size >= PART_CHARS:
                    yield _parts(rows)
                    rows, size = [], 0
        rows.append((conv, part, "".join(text), spans))
        size += at
        if size >= PART_CHARS:
            yield _parts(rows)
            rows, size = [], 0
    yield _parts(rows)


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_PART)], schema=_PART)


def format_conversations(conversations: DataFrame, template: str = DEFAULT, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, part, text, spans): each conversation's formatted text in parts of about PART_CHARS, with the [start, end, ...] of each part under the generation mark.

    Turns are in the order of turn, role and text, nulls first; null roles and texts are empty; repeated rows are turns of their own; a null conv_id is a
    conversation. One conversation is a stream in one task, whatever its length; an empty table gives none.
    """
    ship(conversations.sparkSession)
    Template(template)  # an error in it shows here
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(lambda b: _format(template, b), _PART_DDL)


_TURN, _END = "<|turn|>", "<|end|>\n"
#: What escape_line() made, up to the line end that it didn't.
_ROLE = re.compile(rf"((?:[^{re.escape(ESCAPE)}\n]|{re.escape(ESCAPE)}.)*)\n", re.S)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads what DEFAULT wrote. Marks can't occur inside escaped texts, so they cut the turns; what a part leaves open goes on with the next."""
    rows = []
    for conv, parts in _groups(batches, "conv_id", ("text", "spans")):
        turns = loss = size = 0
        all_, under = hashlib.sha256(), hashlib.sha256()
        rest = open_ = ""
        for text, spans in parts:
            size += len(text)
            for a, b in zip(spans[::2], spans[1::2]):
                piece = open_ + text[a:b]
                # An escape sign whose partner is in the next part waits for it.
                odd = b == len(text) and (len(piece) - len(piece.rstrip(ESCAPE))) % 2
                plain = unescape(piece[: len(piece) - odd])
                open_ = piece[len(piece) - odd :]
                loss += len(plain)
                under.update(plain.encode("utf-8", "surrogatepass"))
            rest += text
            done = rest.split(_END)
            rest = done.pop()
            for turn in done:
                head = _ROLE.match(turn, len(_TURN))
                all_.update(f"{unescape(head[1])}\n{unescape(turn[head.end() :])}\n".encode("utf-8", "surrogatepass"))
                turns += 1
        rows.append((conv, turns, all_.hexdigest(), loss, under.hexdigest(), size))
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of conversations in the DEFAULT format, from their text and marks alone."""
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def round_trip(conversations: DataFrame, **columns: str) -> DataFrame:
    """Writes the formatted conversations into the shared folder and reads them back."""
    return read_back(stash(format_conversations(conversations, **columns), "chat"))
