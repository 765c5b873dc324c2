"""Selectors and the 21 condition operators, as null-free boolean Columns.

SQL null cannot tell a missing value from a null one, so a selector yields a view that
carries both facts, and every operator answers true or false.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOTS = ("principal", "action", "resource", "context", "findings", "classifications", "env")
#: Roots whose attributes are also reachable without naming ``attributes``.
SPREAD_ROOTS = ("principal", "resource")
# Fixed values, in force unless ``limits`` says otherwise: the longest regular expression a policy
# may hold, and what a trace shows of a list and of a string.
MAX_PATTERN = 512
TRACE_ITEMS = 12
TRACE_CHARS = 200
_LIMITS: ContextVar[tuple[int | None, int | None, int | None]] = ContextVar("limits", default=(MAX_PATTERN, TRACE_ITEMS, TRACE_CHARS))


@contextmanager
def limits(pattern: int | None = None, trace_items: int | None = None, trace_chars: int | None = None) -> Iterator[None]:
    """Other limits for the plans built inside; None sets none."""
    token = _LIMITS.set((pattern, trace_items, trace_chars))
    try:
        yield
    finally:
        _LIMITS.reset(token)


_NUMBER_KINDS = r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"


class PolicyError(ValueError):
    """A policy document cannot be used."""


class View:
    """What a selector resolved to. Lists and scalars share the element arrays.

    Parts: ``present``, ``is_null``, ``is_list``, ``count``, ``strings``, ``numbers``,
    ``booleans`` and ``shown`` (as a trace prints it). A part is built when first asked for,
    since a condition needs one or two of them.
    """

    PARTS = ("present", "is_null", "is_list", "count", "strings", "numbers", "booleans", "shown")

    def __init__(self, **parts: Callable[[], Column]) -> None:
        self._parts = parts

    def __getattr__(self, name: str) -> Column:
        if name not in View.PARTS:
            raise AttributeError(name)
        built = self._parts[name]()
        setattr(self, name, built)
        return built

    def but(self, **parts: Callable[[], Column]) -> View:
        return View(**{**self._parts, **parts})


def _none(ddl: str) -> Column:
    return F.array().cast(f"array<{ddl}>")


def _known(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def _no_strings() -> Column:
    return _none("string")


def _no_numbers() -> Column:
    return _none("double")


def _no_booleans() -> Column:
    return _none("boolean")


def _false() -> Column:
    return F.lit(False)


def absent() -> View:
    return View(
        present=_false,
        is_null=_false,
        is_list=_false,
        count=lambda: F.lit(0),
        strings=_no_strings,
        numbers=_no_numbers,
        booleans=_no_booleans,
        shown=lambda: F.lit("None"),
    )


def quoted(text: Column) -> Column:
    """A string as it appears in a trace: cut to size, in quotes."""
    most = _LIMITS.get()[2]
    cut = text if most is None else F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)
    return F.coalesce(F.concat(F.lit("'"), cut, F.lit("'")), F.lit("None"))


def summarised(items: Column, size: Column) -> Column:
    """A list as it appears in a trace: so many items, and how many were left out."""
    most = _LIMITS.get()[1]
    if most is None:
        return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    head = F.slice(items, 1, most)
    more = F.concat(F.lit("'... +"), (size - most).cast("string"), F.lit(" more'"))
    shown = F.when(size > most, F.array_append(head, more)).otherwise(head)
    return F.concat(F.lit("["), F.array_join(shown, ", "), F.lit("]"))


# --------------------------------------------------------------------------- views


def view_of_string(value: Column, present: Column) -> View:
    return View(
        present=lambda: present,
        is_null=lambda: present & value.isNull(),
        is_list=_false,
        count=lambda: present.cast("int"),
        strings=lambda: F.when(value.isNotNull() & present, F.array(value)).otherwise(_none("string")),
        numbers=_no_numbers,
        booleans=_no_booleans,
        shown=lambda: F.when(present, quoted(value)).otherwise(F.lit("None")),
    )


def view_of_strings(value: Column, present: Column) -> View:
    there = present & value.isNotNull()
    return View(
        present=lambda: there,
        is_null=_false,
        is_list=lambda: there,
        count=lambda: F.when(there, F.size(value)).otherwise(F.lit(0)),
        strings=lambda: F.when(there, F.filter(value, lambda v: v.isNotNull())).otherwise(_none("string")),
        numbers=_no_numbers,
        booleans=_no_booleans,
        shown=lambda: F.when(there, summarised(F.transform(value, quoted), F.size(value))).otherwise(F.lit("None")),
    )


def view_of_number(value: Column, present: Column) -> View:
    return view_of_string(value.cast("string"), present).but(
        strings=_no_strings,
        numbers=lambda: F.when(value.isNotNull() & present, F.array(value.cast("double"))).otherwise(_none("double")),
        shown=lambda: F.coalesce(value.cast("string"), F.lit("None")),
    )


def view_of_boolean(value: Column, present: Column) -> View:
    return view_of_string(value.cast("string"), present).but(
        strings=_no_strings,
        booleans=lambda: F.when(value.isNotNull() & present, F.array(value)).otherwise(_none("boolean")),
        shown=lambda: F.when(value, F.lit("True")).when(~value, F.lit("False")).otherwise(F.lit("None")),
    )


def view_of_variant(value: Column) -> View:
    """SQL null is missing; a JSON null is present and null."""

    def is_list() -> Column:
        return _known(F.startswith(F.schema_of_variant(value), F.lit("ARRAY")))

    def items() -> Column:
        listed = F.try_variant_get(value, "$", "array<variant>")
        return F.when(value.isNull(), _none("variant")).when(is_list(), listed).otherwise(F.array(value))

    def of_kind(pattern: str, ddl: str) -> Callable[[], Column]:
        def build() -> Column:
            listed = F.try_variant_get(value, "$", "array<variant>")
            wanted = F.filter(listed, lambda v: F.schema_of_variant(v).rlike(pattern))
            many = F.transform(wanted, lambda v: F.try_variant_get(v, "$", ddl))
            # A scalar, by far the most frequent, needs no list to be walked.
            one = F.when(F.schema_of_variant(value).rlike(pattern), F.array(F.try_variant_get(value, "$", ddl))).otherwise(_none(ddl))
            return F.when(value.isNull(), _none(ddl)).when(is_list(), many).otherwise(one)

        return build

    def one_shown(v: Column) -> Column:
        k = F.schema_of_variant(v)
        return (
            F.when(k == "STRING", quoted(F.try_variant_get(v, "$", "string")))
            .when(k == "BOOLEAN", F.initcap(F.try_variant_get(v, "$", "string")))
            .when(k == "VOID", F.lit("None"))
            .when(k.rlike(_NUMBER_KINDS), F.try_variant_get(v, "$", "string"))
            .when(F.startswith(k, F.lit("ARRAY")), F.lit("'<list>'"))
            .otherwise(F.lit("'<dict>'"))
        )

    def shown() -> Column:
        listed = F.transform(items(), one_shown)
        whole = F.when(is_list(), summarised(listed, F.size(items()))).otherwise(F.get(listed, F.lit(0)))
        return F.when(value.isNull(), F.lit("None")).otherwise(whole)

    return View(
        present=lambda: value.isNotNull(),
        is_null=lambda: _known(F.schema_of_variant(value) == "VOID"),
        is_list=is_list,
        count=lambda: F.size(items()),
        strings=of_kind("^STRING$", "string"),
        numbers=of_kind(_NUMBER_KINDS, "double"),
        booleans=of_kind("^BOOLEAN$", "boolean"),
        shown=shown,
    )


def either(test: Column, yes: View, no: View) -> View:
    def pick(name: str) -> Callable[[], Column]:
        return lambda: F.when(test, getattr(yes, name)).otherwise(getattr(no, name))

    return View(**{name: pick(name) for name in View.PARTS})


# --------------------------------------------------------------------------- selectors


def _variant_at(value: Column, segments: list[str]) -> Column:
    """Walk a VARIANT by object keys and list positions, negative ones from the end."""
    for segment in segments:
        quoted_key = segment.replace("'", "\\'")
        member = F.try_variant_get(value, f"$['{quoted_key}']", "variant")
        if segment.lstrip("-").isdigit():
            at = int(segment)
            items = F.try_variant_get(value, "$", "array<variant>")
            item = F.try_element_at(items, F.lit(at + 1 if at >= 0 else at))
            value = F.coalesce(member, item)
        else:
            value = member
    return value


def _view(value: Column, dtype: T.DataType, segments: list[str], present: Column) -> View:
    if not segments:
        if isinstance(dtype, T.VariantType):
            return view_of_variant(F.when(present, value))
        if isinstance(dtype, T.StringType):
            return view_of_string(value, present)
        if isinstance(dtype, T.BooleanType):
            return view_of_boolean(value, present)
        if isinstance(dtype, T.NumericType):
            return view_of_number(value, present)
        if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StringType):
            return view_of_strings(value, present)
        return view_of_string(F.lit("<dict>"), present & value.isNotNull()).but(strings=_no_strings)
    head, rest = segments[0], segments[1:]
    if isinstance(dtype, T.VariantType):
        return view_of_variant(F.when(present, _variant_at(value, segments)))
    if isinstance(dtype, T.MapType):
        if isinstance(dtype.valueType, T.VariantType):  # a null one is missing, like that of a key which is not there
            return _view(F.try_element_at(value, F.lit(head)), dtype.valueType, rest, present)
        has = present & _known(F.map_contains_key(value, F.lit(head)))
        return _view(F.try_element_at(value, F.lit(head)), dtype.valueType, rest, has)
    if isinstance(dtype, T.StructType):
        if head not in dtype.fieldNames():
            return absent()
        return _view(value.getField(head), dtype[head].dataType, rest, present & value.isNotNull())
    if isinstance(dtype, T.ArrayType) and head.lstrip("-").isdigit():
        at = int(head)
        inside = present & _known(F.size(value) > (at if at >= 0 else -at - 1))
        item = F.try_element_at(value, F.lit(at + 1 if at >= 0 else at))
        return _view(item, dtype.elementType, rest, inside)
    return absent()


def select(schema: T.StructType, selector: str) -> View:
    """Resolve a dotted selector against the columns of a request table.

    An attribute called like a built-in member of ``principal`` or ``resource`` hides it.
    """
    segments = selector.split(".")
    root = segments[0]
    if root not in schema.fieldNames():
        return absent()
    dtype = schema[root].dataType
    plain = _view(F.col(root), dtype, segments[1:], F.lit(True))
    spread = root in SPREAD_ROOTS and isinstance(dtype, T.StructType) and "attributes" in dtype.fieldNames()
    if not spread or len(segments) < 2:
        return plain
    extra_type = dtype["attributes"].dataType
    extra = F.col(root).getField("attributes")
    if isinstance(extra_type, T.MapType):
        hides = _known(F.map_contains_key(extra, F.lit(segments[1])))
    elif isinstance(extra_type, T.VariantType):
        hides = _known(_variant_at(extra, segments[1:2]).isNotNull())
    elif isinstance(extra_type, T.StructType) and segments[1] in extra_type.fieldNames():
        hides = F.lit(True)
    else:
        return plain
    if isinstance(dtype, T.StructType) and segments[1] not in dtype.fieldNames():
        return _view(extra, extra_type, segments[1:], F.lit(True))
    return either(hides, _view(extra, extra_type, segments[1:], F.lit(True)), plain)


def bound(view: View, selector: str, seen: dict[tuple[str, str], tuple[str, Column]]) -> View:
    """The same view over columns of their own, which ``seen`` collects for the caller to add.

    However many tests read a part of a selector, it is then resolved once per row.
    """

    def part(name: str) -> Callable[[], Column]:
        def build() -> Column:
            if (selector, name) not in seen:
                seen[selector, name] = (f"_seen_{len(seen)}", getattr(view, name))
            return F.col(seen[selector, name][0])

        return build

    return View(**{name: part(name) for name in View.PARTS})


# --------------------------------------------------------------------------- globs


def glob_regex(glob: str) -> str:
    """A case-sensitive shell pattern as an anchored regex; ``*`` crosses separators."""
    out, at = [], 0
    while at < len(glob):
        char = glob[at]
        closing = glob.find("]", at + 2 + (glob[at + 1 : at + 2] == "!")) if char == "[" else -1
        if char == "*":
            out.append(".*")
        elif char == "?":
            out.append(".")
        elif closing > 0:
            members = glob[at + 1 : closing].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "\\&&")
            members = "^" + members[1:] if members.startswith("!") else members.replace("^", "\\^", 1) if members.startswith("^") else members
            out.append(f"[{members}]")
            at = closing
        else:
            out.append("\\" + char if char in r"\.^$+(){}|[]" else char)
        at += 1
    return "(?s)^" + "".join(out) + "\\z"


def glob_regex_column(glob: Column) -> Column:
    """The same translation for a column of patterns."""
    text = F.regexp_replace(glob, r"([\\.^$+(){}|])", r"\\$1")
    text = F.regexp_replace(text, r"\[(?![^\]]+\])", r"\\[")
    text = F.regexp_replace(text, r"\[!", "[^")
    text = F.replace(F.replace(text, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit("."))
    return F.concat(F.lit("(?s)^"), text, F.lit("\\z"))


# --------------------------------------------------------------------------- operators


def _listed(operand: Any) -> list[Any]:
    return list(operand) if isinstance(operand, (list, tuple, set, frozenset)) else [operand]


def _is_number(operand: Any) -> bool:
    return isinstance(operand, (int, float)) and not isinstance(operand, bool)


def _number(operand: Any, name: str) -> float:
    if not _is_number(operand):
        raise PolicyError(f"operator {name!r} needs a number, got {type(operand).__name__}")
    return float(operand)


def _flag(operand: Any, name: str) -> bool:
    if not isinstance(operand, bool):
        raise PolicyError(f"operator {name!r} needs a boolean operand")
    return operand


def _one_is(view: View, operand: Any, family: bool) -> Column:
    """Some element equals the operand; with ``family`` a dotted ancestor matches too."""
    if isinstance(operand, str):
        beneath = operand + "."
        return F.exists(
            view.strings,
            lambda v: (v == operand) | F.startswith(v, F.lit(beneath)) if family else v == operand,
        )
    if isinstance(operand, bool):
        return F.array_contains(view.booleans, operand)
    if _is_number(operand):
        return F.array_contains(view.numbers, float(operand))
    if operand is None:
        return view.is_null
    return F.lit(False)


def _eq(view: View, operand: Any) -> Column:
    if isinstance(operand, (list, tuple)):
        same = F.lit(False)
        if all(isinstance(x, str) for x in operand):
            wanted = F.array(*[F.lit(x) for x in operand]) if operand else _none("string")
            same = (view.strings == wanted) & (view.count == len(operand))
        return _known(view.present & view.is_list & same)
    return _known(view.present & ~view.is_list & _one_is(view, operand, family=False))


def _in(view: View, operand: Any) -> Column:
    test = F.lit(False)
    for item in _listed(operand):
        test = test | _one_is(view, item, family=True)
    return _known(test)


def _all_of(view: View, operand: Any) -> Column:
    test = view.count > 0
    for item in _listed(operand):
        test = test & _one_is(view, item, family=True)
    return _known(test)


def _texts(operand: Any) -> list[str]:
    return [x for x in _listed(operand) if isinstance(x, str)]


def _some_string(view: View, tests: list[Callable[[Column], Column]]) -> Column:
    def hit(value: Column) -> Column:
        test = F.lit(False)
        for each in tests:
            test = test | each(value)
        return test

    return _known(F.exists(view.strings, hit)) if tests else F.lit(False)


def _glob(view: View, operand: Any) -> Column:
    patterns = [glob_regex(p) for p in _texts(operand)]
    return _some_string(view, [lambda v, p=p: v.rlike(p) for p in patterns])


def check_pattern(operand: Any) -> None:
    if not isinstance(operand, str):
        raise PolicyError("operator 'regex' needs a string pattern")
    longest = _LIMITS.get()[0]
    if longest is not None and len(operand) > longest:
        raise PolicyError(f"operator 'regex' pattern exceeds {longest} characters")


def _regex(view: View, operand: Any) -> Column:
    check_pattern(operand)
    return _some_string(view, [lambda v: v.rlike(operand)])


def _compare(name: str, test: Callable[[Column, float], Column]) -> Callable[[View, Any], Column]:
    def build(view: View, operand: Any) -> Column:
        bound = _number(operand, name)
        return _known(F.exists(view.numbers, lambda v: test(v, bound)))

    return build


OPERATORS: dict[str, Callable[[View, Any], Column]] = {
    "eq": _eq,
    "neq": lambda v, c: ~_eq(v, c),
    "in": _in,
    "not_in": lambda v, c: ~_in(v, c),
    "any_of": _in,
    "all_of": _all_of,
    "none_of": lambda v, c: ~_in(v, c),
    "glob": _glob,
    "not_glob": lambda v, c: ~_glob(v, c),
    "regex": _regex,
    "exists": lambda v, c: (v.present & ~v.is_null) == F.lit(_flag(c, "exists")),
    "contains": lambda v, c: _some_string(v, [lambda x, n=n: F.contains(x, F.lit(n)) for n in _texts(c)]),
    "startswith": lambda v, c: _some_string(v, [lambda x, n=n: F.startswith(x, F.lit(n)) for n in _texts(c)]),
    "endswith": lambda v, c: _some_string(v, [lambda x, n=n: F.endswith(x, F.lit(n)) for n in _texts(c)]),
    "gt": _compare("gt", lambda a, b: a > b),
    "gte": _compare("gte", lambda a, b: a >= b),
    "lt": _compare("lt", lambda a, b: a < b),
    "lte": _compare("lte", lambda a, b: a <= b),
    "count_gte": lambda v, c: v.count >= _number(c, "count_gte"),
    "count_lte": lambda v, c: v.count <= _number(c, "count_lte"),
    "empty": lambda v, c: (v.count == 0) == F.lit(_flag(c, "empty")),
}


def condition(view: View, operator: str, operand: Any) -> Column:
    if operator not in OPERATORS:
        raise PolicyError(f"unknown operator {operator!r}; known operators: {', '.join(sorted(OPERATORS))}")
    return OPERATORS[operator](view, operand)


def where(df: DataFrame, selector: str, operator: str, operand: Any) -> Column:
    """One condition over a request table, as a boolean Column."""
    return condition(select(df.schema, selector), operator, operand)
