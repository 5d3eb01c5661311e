"""Counts, least and largest over all rows up to a row, which rules write as a join by an ordering.

    upto(C, T, count(*)) :- turn(C, T), turn(C, U), U <= T.

    same(N, count(*)) :- a(X, N), b(Y, N).

Such a join has a row for each pair. In the second form both atoms are first grouped by what
the head and the other atom need of them, and the sizes of groups are multiplied. In the first
both are read once, sorted by the compared columns within the variables that they share, and
summed up on the way: a window. Without a shared variable the rows are sorted over range
partitions, each of which begins with what the ones before it sum up to, so no task gets all
rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomlog.plans.desugar import ITERATORS
from fathomlog.storage import Store
from fathomlog.syntax import Agg, Atom, Bin, Filter, Lit, Rule, Var, variables

MIRROR = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}


@dataclass(frozen=True)
class Shape:
    """``rows`` counts, for each of its rows, the rows of ``others`` whose ``value`` is on the side of ``at`` that ``op`` says."""

    rows: Atom
    others: Atom
    at: str
    op: str
    value: str
    shared: tuple[str, ...]


def shape(rule: Rule, aggs: list[Agg], sig: dict) -> Shape | None:
    """How a rule may be summed up, if it may."""
    atoms = [e for e in rule.body if isinstance(e, Atom)]
    tests = [e for e in rule.body if not isinstance(e, Atom)]
    if len(atoms) != 2 or len(tests) != 1 or any(a.negated or a.pred in ITERATORS and a.pred not in sig for a in atoms):
        return None
    test = tests[0]
    if not (isinstance(test, Filter) and not test.negated and isinstance(test.expr, Bin) and test.expr.op in MIRROR and isinstance(test.expr.left, Var) and isinstance(test.expr.right, Var)):
        return None
    for a in atoms:
        names = [x.name for x in a.args if isinstance(x, Var)]
        if len(names) < len(a.args) or len(set(names)) < len(names):
            return None
    for rows, others in (atoms, atoms[::-1]):
        mine, theirs = ([x.name for x in a.args] for a in (rows, others))
        shared = tuple(v for v in mine if v in theirs)
        for value, op, at in ((test.expr.left.name, test.expr.op, test.expr.right.name), (test.expr.right.name, MIRROR[test.expr.op], test.expr.left.name)):
            if at not in mine or value not in theirs or at in shared or value in shared:
                continue
            kinds = {sig[a.pred][[x.name for x in a.args].index(v)].base for a, v in ((rows, at), (others, value))}
            plain = [t.expr for t in rule.terms if not any(isinstance(x, Agg) for x in _parts(t.expr))]
            fits = all(isinstance(e, Lit) or isinstance(e, Var) and e.name in mine for e in plain) and all(isinstance(t.expr, Agg) for t in rule.terms if t.expr not in plain)
            fits = fits and all(a.func == "count" and a.arg is None or a.func in ("min", "max") and isinstance(a.arg, Var) and a.arg.name in theirs and a.arg.name not in shared for a in aggs)
            if fits and len(kinds) == 1 and kinds <= {"integer", "float", "string"}:
                return Shape(rows, others, at, op, value, shared)
    return None


def _parts(e):
    yield e
    if hasattr(e, "__dataclass_fields__"):
        for f in e.__dataclass_fields__:
            yield from _parts(getattr(e, f))


def meeting(rule: Rule, aggs: list[Agg], sig: dict) -> tuple[Atom, Atom] | None:
    """The two atoms of a rule that only counts how often their rows meet, if they can be grouped first."""
    if len(rule.body) != 2 or not all(isinstance(a, Atom) and not a.negated and (a.pred in sig or a.pred not in ITERATORS) for a in rule.body):
        return None
    if not aggs or any(a.func != "count" or a.arg is not None for a in aggs) or not all(isinstance(t.expr, Agg | Lit | Var) for t in rule.terms):
        return None
    names = [[x.name for x in a.args if isinstance(x, Var)] for a in rule.body]
    if any(len(n) < len(a.args) or len(set(n)) < len(n) for n, a in zip(names, rule.body, strict=True)):
        return None
    head = set(variables([t.expr for t in rule.terms]))
    shared = [v for v in names[0] if v in names[1]]
    kinds = [{sig[a.pred][n.index(v)].base for a, n in zip(rule.body, names, strict=True)} for v in shared]
    # Grouping pays where both atoms have columns that nothing needs.
    spare = all(set(n) - head - set(shared) for n in names)
    return tuple(rule.body) if shared and spare and all(len(k) == 1 for k in kinds) else None


def met(atoms: tuple[Atom, Atom], aggs: list[Agg], head: list[str], sig: dict, relation) -> DataFrame:
    """Columns g0, g1, ... of the head's variables and agg0, agg1, ..., one row for each group."""
    sides = []
    for k, a in enumerate(atoms):
        place = {x.name: f"c{j}" for j, x in enumerate(a.args)}
        needed = [v for v in place if v in head or v in {x.name for x in atoms[1 - k].args}]
        grouped = relation(a, None).distinct().df.groupBy(*(F.col(place[v]).alias(f"s{k}_{v}") for v in needed)).agg(F.count(F.lit(1)).alias(f"m{k}"))
        sides.append((grouped, needed, {v: sig[a.pred][list(place).index(v)] for v in needed}))
    (one, mine, types), (two, theirs, others) = sides
    test = F.lit(True)
    for v in mine:
        if v in theirs:
            x, y = F.col(f"s0_{v}"), F.col(f"s1_{v}")
            test = test & (x.eqNullSafe(y) if types[v].nullable and others[v].nullable and types[v].base != "value" else x == y)
    joined = one.join(two, test)
    groups = [F.col(f"s0_{v}" if v in mine else f"s1_{v}").alias(f"g{k}") for k, v in enumerate(head)]
    return joined.groupBy(*groups).agg(*(F.sum(F.col("m0") * F.col("m1")).alias(f"agg{k}") for k in range(len(aggs)))) if groups else joined.agg(*(F.coalesce(F.sum(F.col("m0") * F.col("m1")), F.lit(0)).alias(f"agg{k}") for k in range(len(aggs))))


def running(spark: SparkSession, s: Shape, aggs: list[Agg], head: list[str], relation) -> DataFrame:
    """Columns g0, g1, ... of the head's variables and agg0, agg1, ..., one row for each group."""
    one, two = (relation(a, None).distinct().df for a in (s.rows, s.others))
    place = {x.name: f"c{k}" for k, x in enumerate(s.rows.args)}
    there = {x.name: f"c{k}" for k, x in enumerate(s.others.args)}
    keys = [f"k{k}" for k in range(len(s.shared))]
    groups = [f"g{k}" for k in range(len(head))]
    found = [F.count(F.lit(1)) if a.func == "count" else getattr(F, a.func)(there[a.arg.name]) for a in aggs]
    names = [f"s{k}" for k in range(len(aggs))]
    others = two.where(F.col(there[s.value]).isNotNull()).groupBy(*(F.col(there[v]).alias(k) for v, k in zip(s.shared, keys, strict=True)), F.col(there[s.value]).alias("v"))
    others = others.agg(*(f.alias(n) for f, n in zip(found, names, strict=True)), F.count(F.lit(1)).alias("n"))
    rows = one.where(F.col(place[s.at]).isNotNull()).select(*(F.col(place[v]).alias(k) for v, k in zip(s.shared, keys, strict=True)), F.col(place[s.at]).alias("v"), *(F.col(place[v]).alias(g) for v, g in zip(head, groups, strict=True)))
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("m"))
    # At equal values the others come first if they count.
    first = s.op in ("<=", ">=")
    kinds = dict(rows.dtypes) | dict(others.dtypes)
    empty = lambda names: [F.lit(None).cast(kinds[n]).alias(n) for n in names]
    every = others.select(*keys, "v", F.lit(0 if first else 1).alias("tag"), *names, "n", *empty([*groups, "m"]))
    every = every.unionByName(rows.select(*keys, "v", F.lit(1 if first else 0).alias("tag"), *empty([*names, "n"]), *groups, "m"))
    order = [F.col("v") if s.op in ("<", "<=") else F.desc("v"), F.col("tag")]
    sums = {n: F.sum if a.func == "count" else getattr(F, a.func) for n, a in zip(names, aggs, strict=True)} | {"n": F.sum}
    if keys:
        window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        every = every.withColumns({n: f(n).over(window) for n, f in sums.items()})
    else:
        dealt = every.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("part", F.spark_partition_id())
        dealt = Store(spark).keep(dealt)
        totals = dealt.groupBy("part").agg(*(f(n).alias(f"t_{n}") for n, f in sums.items()))
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range partition
        totals = totals.select("part", *(f(f"t_{n}").over(before).alias(f"t_{n}") for n, f in sums.items()))
        window = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        every = dealt.withColumns({n: f(n).over(window) for n, f in sums.items()}).join(F.broadcast(totals), "part")
        both = {"min": F.least, "max": F.greatest}
        adds = {n: "sum" if a.func == "count" else a.func for n, a in zip(names, aggs, strict=True)} | {"n": "sum"}
        every = every.withColumns({n: F.coalesce(F.col(n) + F.col(f"t_{n}"), n, f"t_{n}") if kind == "sum" else both[kind](n, f"t_{n}") for n, kind in adds.items()})
    every = every.where((F.col("m") > 0) & (F.col("n") > 0))
    last = [F.sum(F.col(n) * F.col("m")) if a.func == "count" else getattr(F, a.func)(n) for n, a in zip(names, aggs, strict=True)]
    return every.groupBy(*groups).agg(*(f.alias(f"agg{k}") for k, f in enumerate(last)))
