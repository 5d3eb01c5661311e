"""The ``value`` type: JSON kept as canonical text, so equality, grouping and joins are on strings.

Canonical text has no white space, keys in order of their UTF-8 length and then bytes, and
numbers in the shortest form that ECMAScript prints. A SQL NULL is no value; the text
``null`` is the null value. What Spark's own functions cannot do on such text is done here,
an Arrow batch at a time.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from functools import partial
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_INT = 2**53 - 1


def js_number(x: float | int) -> str:
    """A number as ECMAScript prints it."""
    if isinstance(x, int):
        if abs(x) <= MAX_INT:
            return str(x)
        x = float(x)
    if x == 0:
        return "0"
    sign = "-" if x < 0 else ""
    digits, _, exp = repr(abs(x)).partition("e")
    whole, _, part = digits.partition(".")
    part = "" if part == "0" else part
    shift = int(exp or 0) + len(whole)
    text = (whole + part).lstrip("0")
    shift -= len(whole + part) - len(text)
    text = text.rstrip("0")
    n = len(text)
    if n <= shift <= 21:
        return sign + text + "0" * (shift - n)
    if 0 < shift <= 21:
        return sign + text[:shift] + "." + text[shift:]
    if -6 < shift <= 0:
        return sign + "0." + "0" * -shift + text
    e = shift - 1
    return sign + text[0] + ("." + text[1:] if n > 1 else "") + "e" + ("+" if e >= 0 else "-") + str(abs(e))


def dump(x: Any) -> str:
    """Canonical text of parsed JSON."""
    if x is None:
        return "null"
    if x is True:
        return "true"
    if x is False:
        return "false"
    if isinstance(x, int | float):
        return js_number(x)
    if isinstance(x, str):
        return json.dumps(x, ensure_ascii=False)
    if isinstance(x, list):
        return "[" + ",".join(map(dump, x)) + "]"
    keys = sorted(x, key=lambda k: (len(k.encode("utf-8", "surrogatepass")), k.encode("utf-8", "surrogatepass")))
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{dump(x[k])}" for k in keys) + "}"


class _Bad(ValueError):
    pass


def _constant(_: str):
    raise _Bad


def _int(text: str) -> int | float:
    n = int(text)
    if abs(n) <= MAX_INT:
        return n
    return _float(text)


def _float(text: str) -> float:
    x = float(text)
    if not math.isfinite(x):
        raise _Bad
    return int(x) if x.is_integer() and abs(x) <= MAX_INT else x


def load(text: str) -> Any:
    """Parsed JSON; raises ValueError on anything malformed or not finite."""
    return json.loads(text, parse_constant=_constant, parse_int=_int, parse_float=_float)


def canonical(text: str | None) -> str | None:
    try:
        return None if text is None else dump(load(text))
    except (ValueError, RecursionError):
        return None


def _series(kind: str, f: Callable, *columns: pd.Series) -> pd.Series:
    """``f`` of each row, null where a column is; equal rows of the batch are computed once."""
    known: dict = {}
    out = []
    for row in zip(*(c.tolist() for c in columns), strict=True):
        if row not in known:
            known[row] = None if any(x is None or x is pd.NA or x != x for x in row) else f(*row)
        out.append(known[row])
    return pd.Series(out, dtype="Int64" if kind == "long" else "float64" if kind == "double" else "object")


def _udf(kind: str, f: Callable):
    """A pandas UDF of one, two or three columns that is null where any of them is."""

    def one(a: pd.Series) -> pd.Series:
        return _series(kind, f, a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return _series(kind, f, a, b)

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return _series(kind, f, a, b, c)

    def call(*args: Column) -> Column:
        return F.pandas_udf((one, two, three)[len(args) - 1], kind)(*args)

    return call


# What the functions do with parsed JSON; ``_NONE`` is no value.
_NONE = object()


def _entry(x: Any, key) -> Any:
    if isinstance(x, dict) and isinstance(key, str):
        return x.get(key, _NONE)
    if isinstance(x, list) and not isinstance(key, str):
        k = int(key)
        return x[k] if 0 <= k < len(x) else _NONE
    return _NONE


def _integer(x: Any) -> Any:
    return _NONE if isinstance(x, bool) or not isinstance(x, int | float) or x != int(x) or abs(x) > MAX_INT else int(x)


def _real(x: Any) -> Any:
    return _NONE if isinstance(x, bool) or not isinstance(x, int | float) else float(x)


def _string(x: Any) -> Any:
    return x if isinstance(x, str) else _NONE


_FINAL = {"integer": ("long", _integer), "float": ("double", _real), "string": ("string", _string), "value": ("string", dump)}


def _walk(keys: tuple, final: str, parses: bool, text: str) -> Any:
    try:
        x = load(text)
    except (ValueError, RecursionError):
        if parses:
            return None
        raise
    for key in keys:
        x = _entry(x, key)
        if x is _NONE:
            return None
    x = _FINAL[final][1](x)
    return None if x is _NONE else x


def path(keys: tuple, final: str, parses: bool) -> Callable[[Column], Column]:
    """The entry under literal keys of a JSON text, as ``final``, in one step; ``parses`` takes any text."""
    return _udf(_FINAL[final][0], partial(_walk, keys, final, parses))


def _at(text: str, key) -> str | None:
    x = _entry(load(text), key)
    return None if x is _NONE else dump(x)


def _cut(text: str, start, end) -> str | None:
    x = load(text)
    if not isinstance(x, list):
        return None
    start, end = max(0, int(start)), int(end)
    return dump(x[start:end] if end > start and end > 0 else [])


def _size(text: str) -> int | None:
    x = load(text)
    return len(x) if isinstance(x, list | dict | str) else None


def _keys(text: str) -> str | None:
    x = load(text)
    return dump(sorted(x)) if isinstance(x, dict) else None


def _values(text: str) -> str | None:
    x = load(text)
    return dump([x[k] for k in sorted(x)]) if isinstance(x, dict) else None


def _entries(text: str) -> list:
    x = load(text)
    return [{"k": k, "v": dump(v)} for k, v in x.items()] if isinstance(x, dict) else []


def _elements(text: str) -> list:
    x = load(text)
    return [{"k": k, "v": dump(v)} for k, v in enumerate(x)] if isinstance(x, list) else []


def _row(names: tuple, text: str) -> list | None:
    try:
        x = load(text)
    except (ValueError, RecursionError):
        return None
    if isinstance(x, list):
        return [dump(y) for y in x] if len(x) == len(names) else [None] * len(names)
    return [dump(x[n]) if isinstance(x, dict) and n in x else None for n in names]


def row(names: list[str]) -> Callable[[Column], Column]:
    """Cells of a JSON text: a record's by name, an array's by place if it has as many; null if malformed."""
    return _udf("array<string>", partial(_row, tuple(names)))


parse = _udf("string", canonical)
at = _udf("string", _at)
cut = _udf("string", _cut)
size = _udf("long", _size)
has_key = _udf("boolean", lambda t, k: isinstance(x := load(t), dict) and k in x)
keys = _udf("string", _keys)
values = _udf("string", _values)
entries = _udf("array<struct<k:string,v:string>>", _entries)
elements = _udf("array<struct<k:long,v:string>>", _elements)
as_integer, as_float, as_string = (path((), kind, False) for kind in ("integer", "float", "string"))
float_text = _udf("string", lambda x: js_number(float(x)))


def quote(text: Column) -> Column:
    """A string as JSON: what ``dump`` gives, by built-in functions."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    odd = plain
    for k in range(32):
        odd = F.replace(odd, F.lit(chr(k)), F.lit(json.dumps(chr(k))[1:-1]))
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x1f]"), odd).otherwise(plain), F.lit('"'))


def as_boolean(text: Column) -> Column:
    return F.when(text == "true", True).when(text == "false", False)


def type_of(text: Column) -> Column:
    first = F.substring(text, 1, 1)
    known = {"{": "object", "[": "array", '"': "string", "t": "boolean", "f": "boolean", "n": "null"}
    out = F.when(text.isNull(), F.lit(None).cast("string"))
    for k, name in known.items():
        out = out.when(first == k, name)
    return out.otherwise("number")


def lift(col: Column, kind: str) -> Column:
    """Canonical text of a primitive column; SQL NULL stays."""
    if kind == "value":
        return col
    if kind == "integer":
        return col.cast("string")
    if kind == "boolean":
        return F.when(col, "true").when(~col, "false")
    if kind == "float":
        return float_text(col)
    if kind == "null":
        return F.lit("null")
    return quote(col)


def array_of(parts: list[Column]) -> Column:
    """Canonical array of canonical parts; NULL if one is."""
    inner: list[Column] = []
    for k, part in enumerate(parts):
        inner += ([F.lit(",")] if k else []) + [part]
    return F.concat(F.lit("["), *inner, F.lit("]"))


def object_of(entries: dict[str, Column]) -> Column:
    """Canonical object; the last of equal keys counts."""
    order = sorted(entries, key=lambda k: (len(k.encode()), k.encode()))
    inner: list[Column] = []
    for k, key in enumerate(order):
        inner += [F.lit(("," if k else "") + json.dumps(key, ensure_ascii=False) + ":"), entries[key]]
    return F.concat(F.lit("{"), *inner, F.lit("}"))
