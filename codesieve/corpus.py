"""A corpus of modules made from the orders table, with the issues that each must have.

Order k becomes the module m<k>.py: case k % CASES, below k % 7 blank lines. {k} stands for the order's key and {j} for k - 3.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (module, [(code, message, line that ends the message or None, line, column)])
CASES: list[tuple[str, list[tuple[str, str, int | None, int, int]]]] = [
    ("x = = {k}\n", [("E0001", "SyntaxError: invalid syntax", None, 1, 5)]),
    (
        "class A{k}:\n    def __init__(self):\n        yield 1\nclass B{k}:\n    def __init__(self):\n        return None\n",
        [("E0100", "__init__ method is a generator", None, 2, 5), ("E0101", "Explicit return in __init__", None, 5, 5)],
    ),
    (
        "def f{k}(): pass\ndef f{k}(): pass\nclass C{k}:\n    def m(self): pass\n    def m(self): pass\nclass D{k}: pass\nclass D{k}: pass\n",
        [("E0102", "function already defined line ", 2, 1, 1), ("E0102", "method already defined line ", 4, 5, 5), ("E0102", "D{k}", None, 6, 1)],
    ),
    (
        "if True:\n    break\nfor i in range({k}):\n    def g():\n        break\nelse:\n    break\ncontinue\n",
        [("E0103", "'break' not properly in loop", None, 2, 5), ("E0103", "'continue' not properly in loop", None, 8, 1)],
    ),
    ("return {k}\nyield {k}\nx = yield {k}\n", [("E0104", "Return outside function", None, 1, 1), ("E0105", "Yield outside function", None, 2, 1), ("E0105", "Yield outside function", None, 3, 5)]),
    ("def f{k}(a, b, a, *, b): pass\n", [("E0108", "Duplicate argument name a in function definition", None, 1, 1), ("E0108", "Duplicate argument name b in function definition", None, 1, 1)]),
    (
        'd = {1: 0, "1": 1, True: 2,\n     "true": 3, 1.0: 4, None: 5}  # {k}\n',
        [("E0109", "Duplicate key 1 in dictionary", None, 1, 12), ("E0109", "Duplicate key true in dictionary", None, 2, 6), ("E0109", "Duplicate key 1 in dictionary", None, 2, 17)],
    ),
    ("a, *b, *c = [{k}]\n*z = [{k}]\n", [("E0112", "More than one starred expression in assignment", None, 1, 1), ("E0113", "Starred assignment target must be in a list or tuple", None, 2, 1)]),
    (
        "x{k} = 1\ndef outer{k}():\n    def inner():\n        global x{k}\n        nonlocal x{k}\nnonlocal y{k}\ndef g{k}():\n    print(x{k})\n    global x{k}\n",
        [("E0115", "Name 'x{k}' is nonlocal and global", None, 3, 5), ("E0117", "nonlocal name y{k} found without binding", None, 6, 1), ("E0118", "Name x{k} is used prior to global declaration", None, 8, 11)],
    ),
    (
        "class A{k}:\n    def a(): pass\n    def b(this): pass\n    @staticmethod\n    def c(): pass\n    @classmethod\n    def d(cls): pass\n    @classmethod\n    def e(self): pass\n",
        [("E0211", "Method 'a' has no argument", None, 2, 5), ("E0213", "Method 'b' should have \"self\" as first argument", None, 3, 5), ("E0213", "Method 'e' should have \"self\" as first argument", None, 9, 5)],
    ),
    (
        "def f{k}(c):\n    if c:\n        x = 1\n    else:\n        print(x)\n    print(x)\n    return undefined_{k}\n",
        [("E0601", "Using variable 'x' before assignment", None, 5, 15), ("E0606", "Possibly using variable 'x' before assignment", None, 6, 11), ("E0602", "Undefined variable 'undefined_{k}'", None, 7, 12)],
    ),
    (
        "def f{k}(g):\n    try:\n        y = g()\n    except ValueError:\n        z = 1\n    print(y)\n    print(z)\n",
        [("E0606", "Possibly using variable 'y' before assignment", None, 6, 11), ("E0601", "Using variable 'z' before assignment", None, 7, 11)],
    ),
    (
        "raise\nasync def f{k}():\n    await f{k}()\ndef g{k}():\n    await f{k}()\n    raise NotImplemented\n",
        [("E0704", "The raise statement is not inside an except clause", None, 1, 1), ("E1142", "'await' outside async function", None, 5, 5), ("E0711", "NotImplemented raised - should raise NotImplementedError", None, 6, 11)],
    ),
    (
        'import logging\ndef f{k}(a, b, c=1): pass\nf{k}(1)\nf{k}(1, b=2)\nf{k}(*[1])\nlogging.info("%s", 1, 2)\nlogging.info("%s {0} %%", 1, 2)\n',
        [("E1120", "No value for argument 'b' in function call", None, 3, 1), ("E1120", "No value for argument 'b' in function call", None, 5, 1), ("E1205", "Too many arguments for logging format string", None, 6, 1)],
    ),
    ("import os\n\n\ndef f{k}(a, *args, b=None):\n    total = 0\n    for n in args:\n        total = total + n\n    return os.path.join(str(a), str(b), str(total))\n\n\nf{k}(1)\n", []),
    ("if False:\n    return {k}\n    break\nelse:\n    continue\n", [("E0103", "'continue' not properly in loop", None, 5, 5)]),
    ("from m{j} import f{j} as h\nh(1)\n", [("E1120", "No value for argument 'b' in function call", None, 2, 1)]),
    (
        "if {k} % 2:\n    x = 1\nprint(x, y{k})\nclass A{k}:\n    if {k}:\n        z = 1\n    z\n",
        [("E0606", "Possibly using variable 'x' before assignment", None, 3, 7), ("E0602", "Undefined variable 'y{k}'", None, 3, 10), ("E0606", "Possibly using variable 'z' before assignment", None, 7, 5)],
    ),
    (
        "def f{k}(c, d):\n    if c:\n        x = 1\n    elif d:\n        y = 2\n    else:\n        return\n    print(x, y)\n    for i in c:\n        if i:\n            v = 1\n        else:\n            if d: continue\n            else: break\n        print(v, w)\n",
        [("E0602", "Undefined variable 'w'", None, 15, 18)],
    ),
    (
        "def f{k}(g):\n    try:\n        a = g()\n    except ValueError:\n        if g: return\n        else: raise\n    else:\n        b = {k}\n    finally:\n        c = 3\n    print(c)\n    print(a)\n    print(b)\n",
        [("E0606", "Possibly using variable 'a' before assignment", None, 12, 11), ("E0601", "Using variable 'b' before assignment", None, 13, 11)],
    ),
    (
        "with open('{k}') as h, open('y') as (c, d), open('z') as q.r: pass\ndef f{k}():\n    print(h, c, d)\n    global s\ndef g{k}(): print(s)\nclass A{k}:\n    v = 1\n    @x.staticmethod()\n    def m(): print(v)\n    @p.q.classmethod\n    def n(cls): pass\n    @x.other\n    def o(): pass\nprint(v)\n",
        [("E0211", "Method 'o' has no argument", None, 13, 5)],
    ),
    (
        "class A{k}:\n    def m(self):\n        def helper(self): pass\n    def n(self):\n        def helper(self): pass\ntry:\n    pass\nexcept ValueError:\n    def f{k}():\n        raise\nraise\n",
        [("E0102", "method already defined line ", 3, 5, 9), ("E0704", "The raise statement is not inside an except clause", None, 11, 1)],
    ),
    ("é = 'ü'; print(é, ñ{k})\ndef ß(ö): print('ä', ö, ï)\n", [("E0602", "Undefined variable 'ñ{k}'", None, 1, 19), ("E0602", "Undefined variable 'ï'", None, 2, 25)]),
]
#: The case whose issue is there only if order k - 3 is, since it imports that module.
IMPORTING = 16


def modules(orders: DataFrame) -> DataFrame:
    """(file, source): a module for each order."""
    k = F.col("o_orderkey")
    # Keys are cheap to move and modules dear to parse: a small table is spread over all cores before it becomes text, in more parts than cores, so that a slow core doesn't hold up a large one.
    orders = orders.select("o_orderkey").repartition(4 * orders.sparkSession.sparkContext.defaultParallelism, "o_orderkey")
    text = F.element_at(F.array(*[F.lit(m) for m, _ in CASES]), (k % len(CASES) + 1).cast("int"))
    text = F.replace(F.replace(text, F.lit("{k}"), k.cast("string")), F.lit("{j}"), (k - 3).cast("string"))
    return orders.select(F.concat(F.lit("m"), k.cast("string"), F.lit(".py")).alias("file"), F.concat(F.repeat(F.lit("\n"), (k % 7).cast("int")), text).alias("source"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def expected_sql(more: str = "") -> str:
    """SQL of the issues (code, message, file, line, column, severity, symbol, more) that the corpus has, over the table orders; c.place numbers those of a module as they are met."""
    from .functions.catalog import RULES

    rows = []
    for n, (_, issues) in enumerate(CASES):
        rows += [f"({n}, {place}, '{c}', {_quoted(m)}, {'NULL' if at is None else at}, {line}, {column}, '{RULES[c][0]}')" for place, (c, m, at, line, column) in enumerate(issues)]
    return (
        "SELECT c.code AS code, replace(c.message, '{k}', CAST(o.o_orderkey AS VARCHAR)) || coalesce(CAST(c.tail + o.o_orderkey % 7 AS VARCHAR), '') AS message, "
        "'m' || CAST(o.o_orderkey AS VARCHAR) || '.py' AS file, CAST(c.line + o.o_orderkey % 7 AS INTEGER) AS line, CAST(c.col AS INTEGER) AS \"column\", 'error' AS severity, c.symbol AS symbol" + more + " "
        f"FROM orders o JOIN (VALUES {', '.join(rows)}) c(n, place, code, message, tail, line, col, symbol) ON c.n = o.o_orderkey % {len(CASES)} "
        f"WHERE c.n <> {IMPORTING} OR EXISTS (SELECT 1 FROM orders p WHERE p.o_orderkey = o.o_orderkey - 3)"
    )
