"""Types of expressions, and their columns.

An expression becomes a ``Typed``: a type, whether it may have no value (``partial``), and a
function from variable columns to a Column. In that column SQL NULL means *no value* if the
expression is partial, and the null value otherwise; an expression of a primitive type is
never both, because operations that compute reject operands that may be null. A ``value``
column holds canonical JSON text, its null being the text ``null``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomlog.functions import values as V
from fathomlog.syntax import MAX_INT, Arr, Bin, Call, Cond, Cut, Index, Lit, Obj, ProgramError, TypeRef, Un, Var


class Unknown(Exception):
    """A type that inference has not found yet."""


@dataclass(frozen=True)
class Type:
    base: str
    nullable: bool = False
    shape: Any = None  # of a value: a TypeRef with a record, an array or a scalar

    def __str__(self) -> str:
        return self.base + "?" * (self.nullable and self.base != "null")


@dataclass(frozen=True)
class Typed:
    type: Type
    partial: bool
    make: Callable[[dict[str, Column]], Column]


def declared(ref: TypeRef) -> Type:
    if isinstance(ref.base, dict):
        return Type("value", ref.nullable, ref)
    return Type(ref.base, ref.nullable or ref.base == "null")


def join(a: Type | None, b: Type | None) -> Type | None:
    """Least type of both, for the rules of one predicate."""
    if a is None or b is None:
        return a or b
    null = a.nullable or b.nullable
    if a.base == "null" or b.base == "null":
        return replace(b if a.base == "null" else a, nullable=True)
    if a.base == b.base:
        return Type(a.base, null, a.shape if a.shape == b.shape else None)
    if {a.base, b.base} == {"integer", "float"}:
        return Type("float", null)
    return Type("value", null)


def meet(a: Type, b: Type, name: str) -> Type:
    """Type of a variable that stands in two places of one rule."""
    null = a.nullable and b.nullable
    if a.base == b.base:
        return Type(a.base, null, a.shape or b.shape)
    pair = {a.base, b.base}
    if "null" in pair:
        return replace(a if b.base == "null" else b, nullable=True)
    if pair == {"integer", "float"}:
        return Type("integer", null)
    if "value" in pair:
        return replace(a if b.base == "value" else b, nullable=null)
    raise ProgramError(f"{name} is both {a.base} and {b.base}")


def spark_type(base: str) -> str:
    return {"string": "string", "integer": "long", "float": "double", "boolean": "boolean", "value": "string", "null": "string"}[base]


def convert(col: Column, source: Type, base: str) -> Column:
    """A column of one type as another that it widens to."""
    if source.base == base:
        return col
    if source.base == "null":
        return F.lit("null") if base == "value" else F.lit(None).cast(spark_type(base))
    if base == "value":
        text = V.lift(col, source.base)
        return F.coalesce(text, F.lit("null")) if source.nullable else text
    return col.cast(spark_type(base))


def same(a: Typed, b: Typed, cols: dict) -> Column:
    """Null-aware equality of two expressions that have a value."""
    x, y = a.make(cols), b.make(cols)
    ta, tb = a.type, b.type
    if "value" in (ta.base, tb.base) and ta.base != tb.base:
        x, y = convert(x, ta, "value"), convert(y, tb, "value")
        return x.eqNullSafe(y)
    if "null" in (ta.base, tb.base):
        other, t = (y, tb) if ta.base == "null" else (x, ta)
        return F.lit(True) if t.base == "null" else other.isNull()
    if ta.base != tb.base:
        if {ta.base, tb.base} != {"integer", "float"}:
            raise ProgramError(f"= compares {ta.base} and {tb.base}")
        x, y = x.cast("double"), y.cast("double")
    return x.eqNullSafe(y) if ta.nullable and tb.nullable else F.coalesce(x == y, F.lit(False)) if ta.nullable or tb.nullable else x == y


def _finite(x: Column) -> Column:
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def _in_domain(x: Column) -> Column:
    return F.when(x.between(-MAX_INT, MAX_INT), x)


def _int32(x: Column) -> Column:
    return (F.pmod(x + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)).cast("int")


def _text(t: Typed) -> Callable[[dict], Column]:
    base = t.type.base
    if base == "string":
        return t.make
    if base == "float":
        return lambda c: V.float_text(t.make(c))
    if base == "integer":
        return lambda c: t.make(c).cast("string")
    raise ProgramError(f"+ cannot append {base} to a string")


class Typer:
    """Types expressions under the types of variables."""

    def __init__(self, env: dict[str, Type | None], partials: frozenset[str] = frozenset()):
        self.env = env
        self.partials = partials

    def of(self, e) -> Typed:
        t = getattr(self, "_" + type(e).__name__.lower())(e)
        return self._fused(e, t) if isinstance(e, Call | Index) else t

    def _fused(self, e, t: Typed) -> Typed:
        """Literal subscripts of a JSON text, and what is taken out of them, as one step."""
        final, keys, parses = "value", [], False
        if isinstance(e, Call) and e.name in ("as_integer", "as_float", "as_string"):
            final, e = e.name.removeprefix("as_"), e.args[0]
        while isinstance(e, Index) and isinstance(e.at, Lit) and self.of(e.of).type.base == "value":
            keys.append(e.at.value)
            e = e.of
        if not keys:
            return t
        if isinstance(e, Call) and e.name == "parse_json":
            parses, e = True, e.args[0]
        if len(keys) + (final != "value") + parses < 2:
            return t
        text = self.operand(e, "string") if parses else self._lifted(e)
        get = V.path(tuple(reversed(keys)), final, parses)
        return replace(t, make=lambda c: get(text.make(c)))

    def slow(self, e) -> bool:
        """Whether a Python function computes some of an expression."""
        if isinstance(e, Call) and (e.name in ("parse_json", "keys", "values", "has_key") or e.name.startswith(("as_", "to_string")) or e.name == "length" and self.of(e.args[0]).type.base == "value"):
            return True
        if isinstance(e, Index | Cut) and self.of(e.of).type.base == "value":
            return True
        if isinstance(e, tuple):
            return any(self.slow(x) for x in e)
        return hasattr(e, "__dataclass_fields__") and any(self.slow(getattr(e, f)) for f in e.__dataclass_fields__)

    # -- leaves
    def _var(self, e: Var) -> Typed:
        t = self.env.get(e.name)
        if t is None:
            raise Unknown(e.name)
        return Typed(t, e.name in self.partials, lambda c: c[e.name])

    def _lit(self, e: Lit) -> Typed:
        kind = spark_type(e.type)
        return Typed(Type(e.type, e.type == "null"), False, lambda c: F.lit(e.value).cast(kind))

    def _star(self, e) -> Typed:
        raise ProgramError("* stands only in count(*)")

    def _agg(self, e) -> Typed:
        raise ProgramError(f"{e.func} stands outside a head")

    # -- operands
    def operand(self, e, *bases: str) -> Typed:
        """An operand of one of these types: not null, and taken out of a value that proves it."""
        t = self.of(e)
        if t.type.base == "value" and "value" not in bases:
            s = t.type.shape
            if isinstance(s, TypeRef) and isinstance(s.base, str) and s.base in bases and not s.nullable:
                return self.of(Call(f"as_{s.base}", (e,)))
        if t.type.base not in bases:
            raise ProgramError(f"{t.type} where {' or '.join(bases)} is needed")
        if t.type.nullable and t.type.base != "value":
            raise ProgramError(f"an operand may be null: {t.type}; test it with <> null first")
        return t

    def condition(self, e) -> Typed:
        """An operand that is a truth value; at null it has none."""
        t = self.of(e)
        if t.type.base == "null":
            return Typed(Type("boolean"), True, lambda c: F.lit(None).cast("boolean"))
        if t.type.base != "boolean":
            t = self.operand(e, "boolean")
        return Typed(Type("boolean"), t.partial or t.type.nullable, t.make)

    # -- operators
    def _un(self, e: Un) -> Typed:
        if e.op == "!":
            t = self.condition(e.arg)
            return Typed(t.type, t.partial, lambda c: ~t.make(c))
        t = self.operand(e.arg, "integer", "float")
        return Typed(t.type, t.partial, lambda c: -t.make(c))

    def _bin(self, e: Bin) -> Typed:
        op = e.op
        if op in ("&&", "||"):
            a, b = self.condition(e.left), self.condition(e.right)
            return Typed(Type("boolean"), a.partial or b.partial, (lambda c: a.make(c) & b.make(c)) if op == "&&" else (lambda c: a.make(c) | b.make(c)))
        if op in ("=", "<>"):
            return self._equality(op, self.of(e.left), self.of(e.right))
        if op in ("<", "<=", ">", ">="):
            return self._ordering(op, self.of(e.left), self.of(e.right))
        if op == "+":
            a, b = self._plus_side(e.left), self._plus_side(e.right)
            if "string" in (a.type.base, b.type.base):
                x, y = _text(a), _text(b)
                return Typed(Type("string"), a.partial or b.partial, lambda c: F.concat(x(c), y(c)))
        if op in ("&", "|", "^", "<<", ">>", ">>>"):
            return self._bits(op, self.operand(e.left, "integer"), self.operand(e.right, "integer"))
        return self._arithmetic(op, self.operand(e.left, "integer", "float"), self.operand(e.right, "integer", "float"))

    def _plus_side(self, e) -> Typed:
        return self.operand(e, "string", "integer", "float")

    @staticmethod
    def _equality(op: str, a: Typed, b: Typed) -> Typed:
        partial = a.partial or b.partial

        def make(c):
            # A side with no value is null in its own column only if it is partial.
            plain = [replace(x, type=replace(x.type, nullable=False)) if x.partial else x for x in (a, b)]
            out = same(*plain, c)
            out = out if op == "=" else ~out
            for x in (a, b):
                if x.partial:
                    out = F.when(x.make(c).isNotNull(), out)
            return out

        return Typed(Type("boolean"), partial, make)

    @staticmethod
    def _ordering(op: str, a: Typed, b: Typed) -> Typed:
        kinds = {a.type.base, b.type.base} - {"null"}
        if not (kinds <= {"integer", "float"} or kinds == {"string"}):
            raise ProgramError(f"{op} compares {a.type.base} and {b.type.base}")

        def make(c):
            x, y = a.make(c), b.make(c)
            return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

        return Typed(Type("boolean"), a.partial or b.partial or a.type.nullable or b.type.nullable, make)

    @staticmethod
    def _bits(op: str, a: Typed, b: Typed) -> Typed:
        def make(c):
            x, y = _int32(a.make(c)), _int32(b.make(c))
            if op in "&|^":
                out = {"&": x.bitwiseAND, "|": x.bitwiseOR, "^": x.bitwiseXOR}[op](y)
                return out.cast("long")
            name = {"<<": "shiftleft", ">>": "shiftright", ">>>": "shiftrightunsigned"}[op]
            out = F.call_function(name, x, y.bitwiseAND(F.lit(31))).cast("long")
            return F.pmod(out, F.lit(2**32)) if op == ">>>" else out

        return Typed(Type("integer"), a.partial or b.partial, make)

    @staticmethod
    def _arithmetic(op: str, a: Typed, b: Typed) -> Typed:
        whole = a.type.base == b.type.base == "integer" and op != "**"

        def make(c):
            x, y = a.make(c), b.make(c)
            if not whole:
                x, y = x.cast("double"), y.cast("double")
            if op == "+":
                out = F.try_add(x, y) if whole else x + y
            elif op == "-":
                out = F.try_subtract(x, y) if whole else x - y
            elif op == "*":
                out = F.try_multiply(x, y) if whole else x * y
            elif op == "/":
                out = F.call_function("div", x, F.nullif(y, F.lit(0))) if whole else F.try_divide(x, y)
            elif op == "%":
                out = F.try_mod(x, y)
            else:
                out = F.pow(x, y)
            return _in_domain(out) if whole else _finite(out)

        return Typed(Type("integer" if whole else "float"), True, make)

    def _cond(self, e: Cond) -> Typed:
        test, a, b = self.condition(e.test), self.of(e.then), self.of(e.other)
        t = join(a.type, b.type)
        if t.nullable and t.base != "value":
            raise ProgramError("a branch of ? : may be null")

        def make(c):
            p = test.make(c)
            return F.when(p, convert(a.make(c), a.type, t.base)).when(~p, convert(b.make(c), b.type, t.base))

        return Typed(t, test.partial or a.partial or b.partial, make)

    # -- strings and values
    def _index(self, e: Index) -> Typed:
        t = self.of(e.of)
        if t.type.base == "string":
            i = self.operand(e.at, "integer")
            if isinstance(e.at, Un) and e.at.op == "-" and isinstance(e.at.arg, Lit):
                raise ProgramError("a subscript is negative")
            t = self.operand(e.of, "string")
            return Typed(Type("string"), t.partial or i.partial, lambda c: F.when(i.make(c).isNotNull() & t.make(c).isNotNull(), F.when(i.make(c) >= 0, F.substring(t.make(c), (i.make(c) + 1).cast("int"), F.lit(1))).otherwise("")))
        t = self.operand(e.of, "value")
        k = self.operand(e.at, "integer", "string")
        shape = None
        s = t.type.shape
        if isinstance(s, TypeRef) and isinstance(s.base, dict) and not s.nullable:
            if "array" in s.base and k.type.base == "integer":
                shape = s.base["array"]
            elif "record" in s.base and isinstance(e.at, Lit):
                shape = next((f for n, _, f in s.base["record"] if n == e.at.value), None)
        return Typed(Type("value", True if shape is None else shape.nullable, shape), True, lambda c: V.at(t.make(c), k.make(c)))

    def _cut(self, e: Cut) -> Typed:
        t = self.of(e.of)
        start = self.operand(e.start, "integer") if e.start is not None else Typed(Type("integer"), False, lambda c: F.lit(0).cast("long"))
        if t.type.base == "string":
            t = self.operand(e.of, "string")
            end = self.operand(e.end, "integer") if e.end is not None else Typed(Type("integer"), t.partial, lambda c: F.length(t.make(c)).cast("long"))

            def make(c):
                s, a, b = t.make(c), start.make(c), end.make(c)
                part = F.substring(s, F.least(a + 1, F.lit(2**31 - 2)).cast("int"), F.least(b - a, F.lit(2**31 - 2)).cast("int"))
                return F.when(s.isNotNull() & a.isNotNull() & b.isNotNull(), F.when((a < 0) | (b <= a), "").otherwise(part))

            return Typed(Type("string"), t.partial or start.partial or end.partial, make)
        t = self.operand(e.of, "value")
        end = self.operand(e.end, "integer") if e.end is not None else Typed(Type("integer"), False, lambda c: F.lit(MAX_INT).cast("long"))
        return Typed(Type("value", False, t.type.shape), True, lambda c: V.cut(t.make(c), start.make(c), end.make(c)))

    def _lifted(self, e) -> Typed:
        t = self.of(e)
        partial = replace(t.type, nullable=False) if t.partial else t.type
        return replace(t, make=lambda c: convert(t.make(c), partial, "value"))

    def _shape(self, t: Type) -> TypeRef | None:
        return t.shape if t.base == "value" else TypeRef(t.base, t.nullable)

    def _arr(self, e: Arr) -> Typed:
        parts = [self._lifted(x) for x in e.items]
        shapes = {repr(self._shape(p.type)): self._shape(p.type) for p in parts}
        only = next(iter(shapes.values())) if len(shapes) == 1 else None
        shape = TypeRef({"array": only}) if only is not None else None
        return Typed(Type("value", False, shape), any(p.partial for p in parts), lambda c: V.array_of([p.make(c) for p in parts]))

    def _obj(self, e: Obj) -> Typed:
        parts = {k: self._lifted(x) for k, x in e.entries}
        shapes = {k: self._shape(p.type) for k, p in parts.items()}
        shape = TypeRef({"record": tuple((k, False, s if s is not None else TypeRef("value", True)) for k, s in sorted(shapes.items()))})
        return Typed(Type("value", False, shape), any(p.partial for p in parts.values()), lambda c: V.object_of({k: p.make(c) for k, p in parts.items()}))

    # -- functions
    def _call(self, e: Call) -> Typed:
        from .desugar import BUILTINS

        if e.name not in BUILTINS:
            raise ProgramError(f"unknown function {e.name}")
        least, most = BUILTINS[e.name]
        if not least <= len(e.args) <= most:
            raise ProgramError(f"{e.name} takes {least} to {most} arguments")
        return getattr(self, "f_" + e.name)(*e.args)

    def _fn(self, args: list[Typed], base: str, partial: bool, f, shape=None) -> Typed:
        return Typed(Type(base, False, shape), partial or any(a.partial for a in args), lambda c: f(*(a.make(c) for a in args)))

    def f_upper(self, s):
        return self._fn([self.operand(s, "string")], "string", False, lambda x: F.translate(x, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))

    def f_lower(self, s):
        return self._fn([self.operand(s, "string")], "string", False, lambda x: F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))

    def f_trim(self, s):
        return self._fn([self.operand(s, "string")], "string", False, F.trim)

    def f_replace(self, s, old, new):
        return self._fn([self.operand(x, "string") for x in (s, old, new)], "string", False, F.replace)

    def f_length(self, s):
        t = self.of(s)
        if t.type.base == "string":
            return self._fn([self.operand(s, "string")], "integer", False, lambda x: F.length(x).cast("long"))
        return self._fn([self.operand(s, "value")], "integer", True, V.size)

    def f_abs(self, x):
        t = self.operand(x, "integer", "float")
        return self._fn([t], t.type.base, False, F.abs)

    def f_round(self, x, digits=None):
        t = self.operand(x, "integer", "float")
        if digits is None:
            return self._fn([t], "integer", True, lambda a: _whole(F.round(a)))
        n = self.operand(digits, "integer")
        whole = t.type.base == "integer"

        def make(a, k):
            scale = F.pow(F.lit(10.0), k.cast("double"))
            out = F.round(a.cast("double") * scale) / scale
            if whole:
                return F.when(k >= 0, a).otherwise(_whole(out))
            return F.when((k > 15) | ~(F.abs(a * scale) < F.lit(float("inf"))), a).otherwise(_finite(out))

        return self._fn([t, n], t.type.base, True, make)

    def f_floor(self, x):
        return self._fn([self.operand(x, "integer", "float")], "integer", True, lambda a: _whole(F.floor(a)))

    def f_ceil(self, x):
        return self._fn([self.operand(x, "integer", "float")], "integer", True, lambda a: _whole(F.ceil(a)))

    def f_sqrt(self, x):
        return self._fn([self.operand(x, "integer", "float")], "float", True, lambda a: F.when(a >= 0, F.sqrt(a)))

    def f_ln(self, x):
        return self._fn([self.operand(x, "integer", "float")], "float", True, lambda a: F.when(a > 0, F.log(a)))

    def f_exp(self, x):
        return self._fn([self.operand(x, "integer", "float")], "float", True, lambda a: _finite(F.exp(a)))

    def _as(self, v, base, f):
        return self._fn([replace(self._lifted(v), type=Type("value"))], base, True, f)

    def f_as_string(self, v):
        return self._as(v, "string", V.as_string)

    def f_as_integer(self, v):
        return self._as(v, "integer", V.as_integer)

    def f_as_float(self, v):
        return self._as(v, "float", V.as_float)

    def f_as_boolean(self, v):
        return self._as(v, "boolean", V.as_boolean)

    def f_type_of(self, v):
        t = self._lifted(v)
        return self._fn([t], "string", False, V.type_of)

    def f_defined(self, x):
        t = self.of(x)
        if not t.partial:
            return Typed(Type("boolean"), False, lambda c: F.lit(True))
        return Typed(Type("boolean"), True, lambda c: F.when(t.make(c).isNotNull(), True))

    def f_has_key(self, v, k):
        return self._fn([self._lifted(v), self.operand(k, "string")], "boolean", False, V.has_key)

    def f_keys(self, v):
        return self._fn([self._lifted(v)], "value", True, V.keys, TypeRef({"array": TypeRef("string")}))

    def f_values(self, v):
        return self._fn([self._lifted(v)], "value", True, V.values)

    def f_to_json(self, v):
        return self._fn([self._lifted(v)], "string", False, lambda x: x)

    def f_to_string(self, x):
        t = self.operand(x, "integer", "float", "boolean")
        if t.type.base == "float":
            return self._fn([t], "string", False, V.float_text)
        return self._fn([t], "string", False, lambda a: a.cast("string"))

    def f_to_integer(self, s):
        ok = r"^(0|-?[1-9][0-9]*)$"
        return self._fn([self.operand(s, "string")], "integer", True, lambda a: _in_domain(F.when(a.rlike(ok), a.try_cast("long"))))

    def f_to_float(self, s):
        ok = r"^((0|-?[1-9][0-9]*)(\.[0-9]+)?|-0\.[0-9]+)$"
        return self._fn([self.operand(s, "string")], "float", True, lambda a: _finite(F.when(a.rlike(ok), a.try_cast("double"))))

    def f_to_boolean(self, s):
        return self._fn([self.operand(s, "string")], "boolean", True, lambda a: F.when(a == "true", True).when(a == "false", False))

    def f_parse_json(self, s):
        return self._fn([self.operand(s, "string")], "value", True, V.parse)


def _whole(x: Column) -> Column:
    """A double or long that is whole, as a long in the language's domain."""
    return F.when(x.between(-MAX_INT, MAX_INT), x).try_cast("long")
