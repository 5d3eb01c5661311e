"""One rule body as a DataFrame: joins, anti-joins, filters, bindings, aggregates, projection.

Elements run as soon as their variables are bound, whatever their order in the text, so
filters stand below later joins and Catalyst pushes them into scans. Atoms are joined
connected first; a cross join is left only where the text has no connection. Joins that
bind nothing new are semi-joins. Equality is null-aware, and plain where null is ruled out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomlog.functions import values as V
from fathomlog.plans.desugar import ITERATORS
from fathomlog.plans.inference import body_env, head_env
from fathomlog.plans.typing import Type, Typed, Typer, Unknown, convert, same, spark_type
from fathomlog.syntax import Agg, Atom, Bin, Eq, Filter, Lit, ProgramError, Range, Rule, Var, variables

from .running import meeting, met, running, shape

MARK = "m"
#: Numbers that a range puts into one array at most.
RANGE = 4096


@dataclass
class Relation:
    """Columns c0, c1, ... (or one mark for no columns); ``unique`` if rows are known distinct."""

    df: DataFrame
    types: list[Type]
    unique: bool = False

    def distinct(self) -> Relation:
        return self if self.unique else Relation(self.df.distinct(), self.types, True)


def columns(n: int) -> list[str]:
    return [f"c{k}" for k in range(n)] or [MARK]


def empty(spark: SparkSession, types: list[Type]) -> DataFrame:
    fields = ", ".join(f"{c} {spark_type(t.base)}" for c, t in zip(columns(len(types)), types, strict=False)) if types else f"{MARK} boolean"
    return spark.createDataFrame([], fields)


class Body:
    """Builds the bindings of a body. ``relation(atom, index)`` gives what an atom reads."""

    def __init__(self, spark: SparkSession, body: tuple, sig: dict[str, list[Type]], relation, needed: set[str], bag: bool, first: int | None = None):
        self.spark, self.body, self.sig, self.relation = spark, body, sig, relation
        self.env = body_env(body, sig)
        self.typer = Typer(self.env)
        self.needed, self.bag, self.first = needed, bag, first
        self.df: DataFrame | None = None
        self.bound: dict[str, str] = {}
        self.types: dict[str, Type] = {}
        self.serial = 0
        #: Whether rows of the bindings may repeat although all variables are kept.
        self.repeats = False

    # -- state
    def _name(self) -> str:
        self.serial += 1
        return f"v{self.serial}"

    def _cols(self) -> dict[str, Column]:
        return {v: F.col(c) for v, c in self.bound.items()}

    def _start(self) -> DataFrame:
        if self.df is None:
            self.df = self.spark.range(1, numPartitions=1).select(F.lit(True).alias("v0"))
        return self.df

    def _typed(self, e) -> Typed:
        try:
            return Typer({**self.env, **self.types}).of(e)
        except Unknown as x:
            raise ProgramError(f"the type of {x} is not known") from None

    def _ready(self, *parts) -> bool:
        return all(v in self.bound for v in variables(list(parts)))

    # -- main
    def build(self) -> DataFrame:
        atoms = [(k, e) for k, e in enumerate(self.body) if isinstance(e, Atom) and not e.negated and not self._iterates(e)]
        rest = [e for e in self.body if not (isinstance(e, Atom) and not e.negated and not self._iterates(e))]
        rest = self._fire(rest)
        while atoms or rest:
            before = len(atoms), len(rest)
            if atoms:
                k = self._next(atoms)
                index, atom = atoms.pop(k)
                self._join(index, atom, atoms, rest)
            rest = self._fire(rest)
            if (len(atoms), len(rest)) == before:
                loose = sorted({v for e in rest for v in variables(e) if v not in self.bound and not v.startswith("$anon")})
                raise ProgramError(f"no positive atom binds {', '.join(loose) or 'a variable'}")
        return self._start()

    def _iterates(self, e) -> bool:
        return e.pred in ITERATORS and e.pred not in self.sig

    def _next(self, atoms: list) -> int:
        """The delta first, then atoms that are connected, most constants and filters first."""
        if self.df is None and self.first is not None:
            return next((k for k, (i, _) in enumerate(atoms) if i == self.first), 0)

        def rank(item):
            k, (_, a) = item
            shared = sum(v in self.bound for v in set(variables(a.args)))
            constants = sum(isinstance(x, Lit) for x in a.args)
            return (-(shared > 0), -constants, -shared, k)

        return min(enumerate(atoms), key=rank)[0]

    def _fire(self, rest: list) -> list:
        """Run all elements that are ready; returns those that are not."""
        again = True
        while again:
            again = False
            left = []
            for e in rest:
                if self._element(e):
                    again = True
                else:
                    left.append(e)
            rest = left
        return rest

    def _element(self, e) -> bool:
        if isinstance(e, Eq):
            return self._eq(e)
        if isinstance(e, Filter):
            if not self._ready(e.expr):
                return False
            t = self._typed(e.expr)
            if t.type.base != "boolean":
                raise ProgramError(f"a condition is {t.type}, not boolean")
            test = t.make(self._cols())
            self.df = self._start().where(~F.coalesce(test, F.lit(False)) if e.negated else test)
            return True
        if isinstance(e, Range):
            return self._range(e)
        if self._iterates(e):
            return self._iterate(e)
        if e.negated:
            return self._anti(e)
        return False

    def _bind(self, var: str, col: Column, t: Type) -> None:
        name = self._name()
        self.df = self._start().withColumn(name, col)
        self.bound[var] = name
        self.types[var] = t
        self._narrow(var)

    def _narrow(self, var: str) -> None:
        """A variable that some element of the body keeps from being null is not null from here on."""
        t, known = self.types[var], self.env.get(var)
        if t.nullable and t.base not in ("value", "null") and known is not None and not known.nullable:
            self.df = self.df.where(F.col(self.bound[var]).isNotNull())
            self.types[var] = Type(t.base, False, t.shape)

    def _eq(self, e: Eq) -> bool:
        if self._ready(e.left, e.right):
            a, b = self._typed(e.left), self._typed(e.right)
            test = Typer._equality("=", a, b).make(self._cols())
            self.df = self._start().where(test)
            return True
        for x, y in ((e.left, e.right), (e.right, e.left)):
            if isinstance(x, Var) and x.name not in self.bound and x.name not in variables(y) and self._ready(y) and not self._in_atom(x.name):
                t = self._typed(y)
                col = t.make(self._cols())
                if t.partial and Typer({**self.env, **self.types}).slow(y):
                    self._bind(x.name, _valued(col), t.type)
                    return True
                self._bind(x.name, col, t.type)
                if t.partial:
                    self.df = self.df.where(F.col(self.bound[x.name]).isNotNull())
                return True
        return False

    def _in_atom(self, name: str) -> bool:
        """Whether a positive atom binds the variable anyway; an equality is then a filter."""
        return any(isinstance(e, Atom) and not e.negated and not self._iterates(e) and Var(name) in e.args for e in self.body)

    def _range(self, e: Range) -> bool:
        if not self._ready(e.low, e.high):
            return False
        if isinstance(e.expr, Var) and e.expr.name not in self.bound:
            if self._in_atom(e.expr.name) or any(isinstance(x, Eq) and Var(e.expr.name) in (x.left, x.right) and self._would_bind(x, e.expr.name) for x in self.body):
                return False
            typer = Typer({**self.env, **self.types})
            low, high = typer.operand(e.low, "integer").make(self._cols()), typer.operand(e.high, "integer").make(self._cols())
            self.df = self._start().where(low <= high)
            if not (isinstance(e.low, Lit) and isinstance(e.high, Lit) and e.high.value - e.low.value < RANGE):
                # Two short arrays in place of one that a wide range would fill memory with.
                name = self._name()
                self.df = self.df.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((high - low) / RANGE))))
                low = low + F.col(name) * RANGE
                high = F.least(high, low + (RANGE - 1))
            self._bind(e.expr.name, F.explode(F.sequence(low, high)), Type("integer"))
            return True
        if not self._ready(e.expr):
            return False
        x, low, high = (self._typed(p).make(self._cols()) for p in (e.expr, e.low, e.high))
        self.df = self._start().where((x >= low) & (x <= high))
        return True

    @staticmethod
    def _would_bind(e: Eq, name: str) -> bool:
        other = e.right if e.left == Var(name) else e.left
        return name not in variables(other)

    def _iterate(self, e: Atom) -> bool:
        subject, key, value = e.args
        if not self._ready(subject):
            return False
        for a in (key, value):
            if not isinstance(a, Var) and not self._ready(a):
                return False
        t = self._typed(subject)
        text = convert(t.make(self._cols()), t.type, "value")
        parts = V.entries(text) if e.pred == "object_entry" else V.elements(text)
        item = self._name()
        self.df = self._start().withColumn(item, F.explode(parts))
        kinds = (Type("string") if e.pred == "object_entry" else Type("integer"), Type("value", True))
        for a, f, kind in zip((key, value), ("k", "v"), kinds, strict=True):
            col = F.col(f"{item}.{f}")
            if isinstance(a, Var) and a.name not in self.bound:
                self._bind(a.name, col, kind)
            else:
                own = Typed(kind, False, lambda c, col=col: col)
                self.df = self.df.where(same(self._typed(a), own, self._cols()))
        return True

    # -- atoms
    def _join(self, index: int, atom: Atom, atoms: list, rest: list) -> None:
        rel = self.relation(atom, index)
        if self.bag:
            rel = rel.distinct()
        df, types = rel.df, rel.types
        mine: dict[str, str] = {}
        keep: list[Column] = []
        tests: list[tuple[Typed, Typed]] = []
        self.serial += 1
        tag = f"a{self.serial}_"
        later = set(self.needed) | {v for _, a in atoms for v in variables(a.args)} | {v for e in rest for v in variables(e)}
        for k, (a, t) in enumerate(zip(atom.args, types, strict=True)):
            col = F.col(f"c{k}")
            if isinstance(a, Lit):
                df = df.where(same(Typed(t, False, lambda c, col=col: col), self._typed(a), {}))
                continue
            if isinstance(a, Var) and a.name in mine:
                first = int(mine[a.name].removeprefix(tag))
                one = Typed(types[first], False, lambda c, first=first: F.col(f"c{first}"))
                df = df.where(same(one, Typed(t, False, lambda c, col=col: col), {}))
                continue
            name = f"{tag}{k}"
            own = Typed(t, False, lambda c, name=name: F.col(name))
            if isinstance(a, Var):
                mine[a.name] = name
                if a.name in self.bound:
                    tests.append((self._typed(a), own))
                elif a.name not in later and not self.bag:
                    continue  # nothing reads it: the scan need not either
            else:
                tests.append((a, own))
            keep.append(col.alias(name))
        if not keep:
            keep = [F.lit(True).alias(f"{tag}m")]
        df = df.select(*keep)
        fresh = {v: n for v, n in mine.items() if v not in self.bound and (v in later or self.bag)}
        deferred = [(a, own) for a, own in tests if not isinstance(a, Typed)]
        now = [(a, own) for a, own in tests if isinstance(a, Typed)]
        ready = [(self._typed(a), own) for a, own in deferred if self._ready(a)]
        wait = [(a, own) for a, own in deferred if not self._ready(a)]
        cols = self._cols()
        conditions = [same(x, own, cols) if not x.partial else F.when(x.make(cols).isNotNull(), same(x, own, cols)) for x, own in now + ready]
        if self.df is None:
            self.df = df
        elif not fresh and not wait and not self.bag:
            on = conditions or [F.lit(True)]
            self.df = self.df.join(df, _and(on), "left_semi")
        elif conditions:
            self.df = self.df.join(df, _and(conditions), "inner")
        else:
            self.df = self.df.crossJoin(df)
        for v, n in fresh.items():
            self.bound[v] = n
            self.types[v] = types[int(n.removeprefix(tag))]
            self._narrow(v)
        # Types narrow where a variable meets a narrower column.
        for a in mine:
            if a in self.bound and a not in fresh:
                t = types[int(mine[a].removeprefix(tag))]
                if self.types[a].nullable and not t.nullable:
                    self.types[a] = Type(self.types[a].base, False, self.types[a].shape)
        for a, own in wait:  # a computed argument: compared once its variables are bound
            name = f"$h{self.serial}_{len(self.bound)}"
            self.bound[name] = _name_of(own)
            self.types[name] = own.type
            self.env[name] = own.type
            rest.append(Filter(Bin("=", Var(name), a)))

    def _anti(self, e: Atom) -> bool:
        named = [a for a in e.args if not (isinstance(a, Var) and a.name.startswith("$anon"))]
        if not self._ready(named):
            return False
        rel = self.relation(e, None)
        if rel is None:  # the maximal relation at the top: the negation fails
            self.df = self._start().where(F.lit(False))
            return True
        self.serial += 1
        tag = f"n{self.serial}_"
        keep, conditions, cols = [], [], self._cols()
        for k, (a, t) in enumerate(zip(e.args, rel.types, strict=True)):
            if isinstance(a, Var) and a.name.startswith("$anon"):
                continue
            name = f"{tag}{k}"
            keep.append(F.col(f"c{k}").alias(name))
            own = Typed(t, False, lambda c, name=name: F.col(name))
            x = self._typed(a)
            test = same(x, own, cols)
            conditions.append(test if not x.partial else x.make(cols).isNotNull() & test)
        other = rel.df.select(*keep) if keep else rel.df.select(F.lit(True).alias(f"{tag}m")).limit(1)
        self.df = self._start().join(other, _and(conditions or [F.lit(True)]), "left_anti")
        return True


def _valued(col: Column) -> Column:
    """A generator of the column where it has a value: so Python computes it once, not to filter and again to show."""
    return F.explode(F.filter(F.array(col), lambda v: v.isNotNull()))


def _name_of(t: Typed) -> str:
    """Column name behind a bare column maker."""
    return t.make.__defaults__[0]


def _and(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _aggregate(a: Agg, arg: Typed | None, cols: dict[str, Column]) -> Column:
    if a.func == "count":
        if arg is None or not arg.partial:
            return F.count(F.lit(1))
        return F.count(arg.make(cols))
    x = arg.make(cols)
    if a.func == "sum":
        if arg.type.base == "float":
            total = F.sum(x)
            return F.coalesce(F.when(F.abs(total) < F.lit(float("inf")), total), F.when(F.count(x) == 0, F.lit(0.0)))
        # Positive and negative parts are bounded apart, so the order of summing is no matter.
        wide = x.cast("decimal(38,0)")
        up, down = F.coalesce(F.sum(F.when(wide > 0, wide)), F.lit(0)), F.coalesce(F.sum(F.when(wide < 0, wide)), F.lit(0))
        limit = F.lit(2**53 - 1)
        return F.when((up <= limit) & (down >= -limit), (up + down).cast("long"))
    if a.func == "avg":
        mean = F.avg(x.cast("double"))
        return F.when(F.abs(mean) < F.lit(float("inf")), mean)
    if a.func == "min":
        return F.min(x)
    if a.func == "max":
        return F.max(x)
    base = arg.type.base
    if a.func == "concat":
        order = x if base != "value" else F.when(x != "null", x)
        items = F.sort_array(F.collect_list(order))
        if base == "float":
            items = F.sort_array(F.collect_list(F.when(x.isNotNull(), F.struct(x.alias("k"), V.float_text(x).alias("t")))))
            return F.array_join(F.transform(items, lambda y: y["t"]), ",")
        return F.array_join(F.transform(items, lambda y: y.cast("string")), ",")
    text = convert(x, arg.type, "value")
    key = x if base not in ("value", "null", "boolean") else text
    null = x.isNull() if base != "value" else x == "null"
    # Entries without a value are left out; null entries come first.
    entry = F.struct((~null).alias("n"), key.alias("k"), text.alias("t"))
    items = F.sort_array(F.collect_list(F.when(x.isNotNull(), entry) if arg.partial else entry))
    return F.concat(F.lit("["), F.array_join(F.transform(items, lambda y: y["t"]), ","), F.lit("]"))


def rule_rows(spark: SparkSession, rule: Rule, sig: dict[str, list[Type]], relation, first: int | None = None) -> tuple[DataFrame, bool]:
    """Rows c0, c1, ... of one rule in the types of its predicate, and whether they are distinct."""
    exprs = [t.expr for t in rule.terms]
    bag = any(isinstance(a, Agg) for a in _aggs(exprs))
    found = shape(rule, _aggs(exprs), sig) if bag and first is None else None
    if found is not None and all(t.expr.name in set(variables(found.rows.args)) for t in rule.terms if isinstance(t.expr, Var)):
        return _summed_rows(rule, sig, lambda aggs, names: running(spark, found, aggs, names, relation)), True
    atoms = meeting(rule, _aggs(exprs), sig) if bag and first is None else None
    if atoms is not None:
        return _summed_rows(rule, sig, lambda aggs, names: met(atoms, aggs, names, sig, relation)), True
    body = Body(spark, rule.body, sig, relation, set(variables(exprs)), bag, first)
    df = body.build()
    cols = body._cols()
    typer = Typer({**body.env, **body.types})
    loose = [v for v in variables(exprs) if v not in body.bound]
    if loose:
        raise ProgramError(f"{rule.pred}: no positive atom binds {', '.join(loose)}")
    target = sig[rule.pred]
    try:
        exprs, head, aggs = head_env(exprs, typer)
        if aggs:
            df, cols = _grouped(df, exprs, aggs, typer, head, cols)
        out, guards = [], []
        for k, (e, want) in enumerate(zip(exprs, target, strict=True)):
            t = head.of(e)
            source = Type(t.type.base, False, t.type.shape) if t.partial else t.type
            col = t.make(cols)
            if t.partial and not aggs and head.slow(e):
                df = df.withColumn(f"h{k}_", _valued(col))
                col = F.col(f"h{k}_")
            elif t.partial:
                guards.append(f"c{k}")
            out.append(convert(col, source, want.base).alias(f"c{k}"))
    except Unknown as x:
        raise ProgramError(f"{rule.pred}: the type of {x} is not known") from None
    df = df.select(*out) if out else df.select(F.lit(True).alias(MARK))
    for g in guards:
        df = df.where(F.col(g).isNotNull())
    return df, bool(aggs)  # every group key is in the head


def _summed_rows(rule: Rule, sig: dict[str, list[Type]], groups) -> DataFrame:
    """Rows of a rule whose groups ``groups(aggregates, variables of the head)`` gives, as ``rule_rows`` does."""
    exprs, head, aggs = head_env([t.expr for t in rule.terms], Typer(body_env(rule.body, sig)))
    names = [v for v in variables(exprs) if not v.startswith("$agg")]
    df = groups(aggs, names)
    cols = {v: F.col(f"g{k}") for k, v in enumerate(names)} | {f"$agg{k}": F.col(f"agg{k}") for k in range(len(aggs))}
    typed = [head.of(e) for e in exprs]
    return df.select(*(convert(t.make(cols), Type(t.type.base, False, t.type.shape) if t.partial else t.type, want.base).alias(f"c{k}") for k, (t, want) in enumerate(zip(typed, sig[rule.pred], strict=True))))


def _aggs(exprs: list) -> list[Agg]:
    from fathomlog.syntax import aggregates

    return aggregates(tuple(exprs))


def _constant(e) -> bool:
    return not variables(e)


def _grouped(df: DataFrame, exprs: list, aggs: list[Agg], typer: Typer, head: Typer, cols: dict[str, Column]):
    """Groups by head arguments without aggregates that are not constant; aggregates become columns."""
    keys = [e for e in exprs if not any(v.startswith("$agg") for v in variables(e)) and not _constant(e)]
    names = {}
    for k, e in enumerate(keys):
        t = typer.of(e)
        col = t.make(cols)
        if t.partial:
            df = df.where(col.isNotNull())
        names[k] = col.alias(f"g{k}")
    args = [None if a.arg is None else typer.operand(a.arg, "integer", "float") if a.func in ("sum", "avg") else typer.of(a.arg) for a in aggs]
    found = [_aggregate(a, t, cols).alias(f"agg{k}") for k, (a, t) in enumerate(zip(aggs, args, strict=True))]
    df = df.groupBy(*names.values()).agg(*found) if names else df.agg(*found)
    out = {f"$agg{k}": F.col(f"agg{k}") for k in range(len(aggs))}
    # Variables of the head are the group's: plain keys by name, others as whole expressions.
    for k, e in enumerate(keys):
        if isinstance(e, Var):
            out[e.name] = F.col(f"g{k}")
    for k, e in enumerate(exprs):
        if e in keys and not isinstance(e, Var):
            t = typer.of(e)
            head.env[f"$g{k}"] = Type(t.type.base, False if t.partial else t.type.nullable, t.type.shape)
            out[f"$g{k}"] = F.col(f"g{keys.index(e)}")
            exprs[k] = Var(f"$g{k}")
    for e in exprs:
        for v in variables(e):
            if v not in out:
                raise ProgramError(f"{v} has no one value in a group")
    return df, out
