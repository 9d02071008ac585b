"""Rules, severities and the names that are always defined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: code, * if live, symbol: template
_TABLE = """
E0001 * syntax-error: SyntaxError: {}
E0100 * init-is-generator: __init__ method is a generator
E0101 * return-in-init: Explicit return in __init__
E0102 * function-redefined: {}
E0103 * not-in-loop: {} not properly in loop
E0104 * return-outside-function: Return outside function
E0105 * yield-outside-function: Yield outside function
E0106 - return-arg-in-generator: Return with argument inside generator
E0107 - nonexistent-operator: Use of the non-existent {} operator
E0108 * duplicate-argument-name: Duplicate argument name {} in function definition
E0109 * duplicate-key: Duplicate key {} in dictionary
E0110 - abstract-class-instantiated: Abstract class {} instantiated
E0111 - bad-reversed-sequence: The first reversed() argument is not a sequence
E0112 * too-many-star-expressions: More than one starred expression in assignment
E0113 * invalid-star-assignment-target: Starred assignment target must be in a list or tuple
E0114 - star-needs-assignment-target: Can use starred expression only in assignment target
E0115 * nonlocal-and-global: Name '{}' is nonlocal and global
E0116 - continue-not-in-loop: 'continue' not properly in loop
E0117 * nonlocal-without-binding: nonlocal name {} found without binding
E0118 * used-prior-global-declaration: Name {} is used prior to global declaration
E0119 - misplaced-format-function: format function is not called on str
E0202 - method-hidden: An attribute affected in {} line {} hide this method
E0203 - access-member-before-definition: Access to member '{}' before its definition line {}
E0211 * no-method-argument: Method '{}' has no argument
E0213 * no-self-argument: Method '{}' should have "self" as first argument
E0236 - invalid-slots-object: Invalid object '{}' in __slots__,+ must contain only non empty strings
E0237 - assigning-non-slot: Assigning to attribute '{}' not defined in class slots
E0238 - invalid-slots: Invalid __slots__ object
E0239 - inherit-non-class: Inheriting '{}', which is not a class.
E0241 - duplicate-bases: Duplicate bases for class '{}'
E0301 - non-iterator-returned: __iter__ returns non-iterator
E0302 - unexpected-special-method-signature: The special method '{}' expects+ {} param(s), {} was given
E0303 - invalid-length-returned: __len__ does not return non-negative integer
E0601 * used-before-assignment: Using variable '{}' before assignment
E0602 * undefined-variable: Undefined variable '{}'
E0606 * possibly-used-before-assignment: Possibly using variable '{}' before assignment
E0704 * misplaced-bare-raise: The raise statement is not inside an except clause
E0711 * notimplemented-raised: NotImplemented raised - should raise NotImplementedError
E1120 * no-value-for-parameter: No value for argument '{}' in function call
E1142 * await-outside-async: 'await' outside async function
E1205 * logging-too-many-args: Too many arguments for logging format string
"""


def _rules() -> dict[str, tuple[str, str, bool]]:
    rules = {}
    for line in _TABLE.strip().splitlines():
        head, _, template = line.partition(": ")
        code, live, symbol = head.split()
        rules[code] = (symbol, template.replace("+", ""), live == "*")  # a plus only breaks a long line up
    return rules


#: code -> (symbol, template, whether anything emits it)
RULES = _rules()
LIVE = tuple(c for c, r in RULES.items() if r[2])
SEVERITIES = ("error", "warning", "convention", "refactor", "info")
_LETTERS = {"E": "error", "W": "warning", "C": "convention", "R": "refactor", "I": "info"}

#: Frozen, so that results don't depend on the interpreter.
BUILTINS = tuple(
    """
    ArithmeticError AssertionError AttributeError BaseException BrokenPipeError BufferError ConnectionAbortedError ConnectionError ConnectionRefusedError
    ConnectionResetError DeprecationWarning EOFError Ellipsis EnvironmentError Exception False FileExistsError FileNotFoundError FloatingPointError
    FutureWarning GeneratorExit IOError ImportError IndentationError IndexError InterruptedError IsADirectoryError KeyError KeyboardInterrupt LookupError
    MemoryError NameError None NotADirectoryError NotImplemented NotImplementedError OSError OverflowError PendingDeprecationWarning PermissionError
    ProcessLookupError ReferenceError RuntimeError StandardError StopAsyncIteration StopIteration SyntaxError SystemError SystemExit TabError TimeoutError
    True TypeError UnicodeDecodeError UnicodeEncodeError UnicodeError UserWarning ValueError Warning ZeroDivisionError __build_class__ __cached__ __debug__
    __doc__ __file__ __import__ __loader__ __name__ __package__ __spec__ abs all any ascii bin bool bytearray bytes callable chr classmethod compile complex
    copyright credits delattr dict dir divmod enumerate eval exec exit file filter float format frozenset getattr globals hasattr hash help hex id input
    int isinstance issubclass iter len license list locals map max memoryview min next object oct open ord pow print property quit range repr reversed
    round set setattr slice sorted staticmethod str sum super tuple type vars zip
    """.split()
)


def rules_table(spark: SparkSession) -> DataFrame:
    """(code, symbol, template, severity, live): a row for each declared rule."""
    return spark.createDataFrame([(c, s, t, _LETTERS.get(c[0], "error"), live) for c, (s, t, live) in RULES.items()], "code string, symbol string, template string, severity string, live boolean")


def severity_of(code: str) -> str:
    return _LETTERS.get(code[:1], "error")


def severity(code: Column) -> Column:
    """The severity of a code by its first letter; error for any other."""
    first, result = F.substring(code, 1, 1), F.lit("error")
    for letter, name in _LETTERS.items():
        result = F.when(first == letter, name).otherwise(result)
    return result


def severity_rank(name: Column) -> Column:
    """Place of a severity in reports."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), name), F.lit(0)).cast("int")


def symbol(code: Column) -> Column:
    return F.element_at(F.expr("map(" + ", ".join(f"'{c}', '{r[0]}'" for c, r in RULES.items()) + ")"), code)


def message(code: str, *args: Column) -> Column:
    """The template's text; the first argument fills every {}, later ones only {1}, {2}, ..."""
    parts = RULES[code][1].split("{}")
    if len(args) == 1 and "{0}" not in RULES[code][1]:
        return F.concat(*[x for k, part in enumerate(parts) for x in ([args[0]] if k else []) + ([F.lit(part)] if part else [])])
    text: Column = F.lit(RULES[code][1])
    for k, a in enumerate(args):
        text = F.replace(F.replace(text, F.lit(f"{{{k}}}"), a), F.lit("{}"), a)
    return text
