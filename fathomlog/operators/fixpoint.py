"""Strata in dependency order: lazy plans, semi-naive and alternating fixed points."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomlog.plans.desugar import ITERATORS, Core
from fathomlog.plans.typing import Type
from fathomlog.storage import Store
from fathomlog.syntax import Atom, Eq, ProgramError, Range, Rule, Var, aggregates, variables

from .rules import Relation, columns, empty, rule_rows


def strata(core: Core) -> list[list[str]]:
    """Strongly connected components of the derived predicates, dependencies first (Tarjan)."""
    uses = {p: {a.pred for r in rules for a in r.body if isinstance(a, Atom) and a.pred in core.rules} for p, rules in core.rules.items()}
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    out: list[list[str]] = []
    for root in uses:
        if root in index:
            continue
        work = [(root, iter(sorted(uses[root])))]
        index[root] = low[root] = len(index)
        stack.append(root)
        while work:
            node, todo = work[-1]
            step = next(todo, None)
            if step is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    part = []
                    while True:
                        x = stack.pop()
                        part.append(x)
                        if x == node:
                            break
                    out.append(sorted(part))
            elif step not in index:
                index[step] = low[step] = len(index)
                stack.append(step)
                work.append((step, iter(sorted(uses[step]))))
            elif step in stack:
                low[node] = min(low[node], index[step])
    return out


def is_recursive(core: Core, part: list[str]) -> bool:
    return len(part) > 1 or any(isinstance(a, Atom) and a.pred == part[0] for r in core.rules[part[0]] for a in r.body)


def check_strata(core: Core) -> None:
    """Aggregates are not recursive; negation inside a stratum crosses polarity, positive use keeps it."""
    polarity: dict[str, bool] = {}
    for p, rules in core.rules.items():
        if len({r.maximal for r in rules}) > 1:
            raise ProgramError(f"{p} is written both with and without ^")
        polarity[p] = rules[0].maximal
    for name, i in core.inputs.items():
        polarity[name] = i.maximal
    for part in strata(core):
        for p in part:
            for r in core.rules[p]:
                for a in r.body:
                    if not isinstance(a, Atom) or a.pred not in polarity:
                        continue
                    if a.maximal != polarity[a.pred]:
                        raise ProgramError(f"{a.pred} must be written {'with' if polarity[a.pred] else 'without'} ^")
                    if a.pred not in part:
                        continue
                    if any(aggregates(t.expr) for t in r.terms):
                        raise ProgramError(f"{p}: an aggregate cannot be recursive")
                    if a.negated == (polarity[a.pred] == polarity[p]):
                        raise ProgramError(f"{p} depends on {'the negation of ' if a.negated else ''}{a.pred} in its own stratum with {'the same' if a.negated else 'another'} polarity")


def check_safety(core: Core) -> None:
    """Every variable is bound by a positive atom, or from bound ones by an equality, range or iteration."""
    bodies = [(r.pred, r.body, variables([t.expr for t in r.terms])) for rules in core.rules.values() for r in rules]
    bodies += [("a constraint", c.body, []) for c in core.constraints]
    bodies += [("the query", core.query.body, [])] if core.query else []
    for name, body, head in bodies:
        bound: set[str] = set()
        grown = True
        while grown:
            before = len(bound)
            for e in body:
                if isinstance(e, Atom) and not e.negated:
                    iterates = e.pred in ITERATORS and core.arity(e.pred) is None
                    if not iterates:
                        bound |= {a.name for a in e.args if isinstance(a, Var)}
                    elif set(variables(e.args[0])) <= bound:
                        bound |= {a.name for a in e.args[1:] if isinstance(a, Var)}
                elif isinstance(e, Eq):
                    for x, y in ((e.left, e.right), (e.right, e.left)):
                        if isinstance(x, Var) and x.name not in variables(y) and set(variables(y)) <= bound:
                            bound.add(x.name)
                elif isinstance(e, Range) and isinstance(e.expr, Var) and set(variables([e.low, e.high])) <= bound:
                    bound.add(e.expr.name)
            grown = len(bound) > before
        loose = [v for v in [*head, *(v for e in body for v in variables(e))] if v not in bound and not v.startswith("$anon")]
        if loose:
            raise ProgramError(f"{name}: no positive atom binds {', '.join(dict.fromkeys(loose))}")


class Engine:
    """Relations of all predicates of a program."""

    def __init__(self, spark: SparkSession, core: Core, sig: dict[str, list[Type]], inputs: dict[str, Relation], max_iterations: int | None = None, trace: Callable[[dict], None] | None = None):
        self.spark, self.core, self.sig = spark, core, sig
        self.relations: dict[str, Relation] = dict(inputs)
        self.max_iterations, self.trace = max_iterations, trace
        self.store = Store(spark)
        self.capped: list[str] = []

    def _tell(self, kind: str, **about) -> None:
        """stratum: one begins; rule: rows that one derived in a round, repeats among them; round: new rows."""
        if self.trace:
            self.trace({"kind": kind, **about})

    def read(self, atom: Atom, index: int | None) -> Relation | None:
        return self.relations[atom.pred]

    def run(self, wanted: set[str] | None = None) -> None:
        """Evaluate the strata that ``wanted`` needs; all by default."""
        check_safety(self.core)
        check_strata(self.core)
        needed = None if wanted is None else self._closure(wanted)
        bodies = [(p, r.body) for p, rules in self.core.rules.items() for r in rules if needed is None or p in needed]
        bodies += [(None, c.body) for c in self.core.constraints] + ([(None, self.core.query.body)] if self.core.query else [])
        reads = Counter(a.pred for _, body in bodies for a in body if isinstance(a, Atom))
        for part in strata(self.core):
            if needed is not None and not needed & set(part):
                continue
            self._tell("stratum", stratum=part, recursive=is_recursive(self.core, part))
            if not is_recursive(self.core, part):
                found = self._union(part[0], self.core.rules[part[0]], self.read)
                if reads.get(part[0], 0) > 1 and self._shuffles(part[0]):
                    found = Relation(self.store.keep(found.df), found.types, found.unique)
                self.relations[part[0]] = found
            elif len({self.core.rules[p][0].maximal for p in part}) == 1:
                self._semi_naive(part, self.read)
            else:
                self._alternate(part)

    def _shuffles(self, pred: str) -> bool:
        """Whether a view costs enough to be kept rather than computed by each of its readers."""
        rules = self.core.rules[pred]
        return len(self._merged_facts(rules)) > 1 or any(any(aggregates(t.expr) for t in r.terms) or sum(isinstance(a, Atom) for a in r.body) > 1 for r in rules)

    def _closure(self, wanted: set[str]) -> set[str]:
        out, todo = set(), list(wanted)
        while todo:
            p = todo.pop()
            if p in out or p not in self.core.rules:
                continue
            out.add(p)
            todo += [a.pred for r in self.core.rules[p] for a in r.body if isinstance(a, Atom)]
        return out

    def _rows(self, rule: Rule, read, first: int | None = None) -> tuple[DataFrame, bool]:
        return rule_rows(self.spark, rule, self.sig, read, first)

    def _union(self, pred: str, rules: list[Rule], read) -> Relation:
        parts = [self._rows(r, read) for r in self._merged_facts(rules)]
        facts = self._facts(pred, rules)
        if facts is not None:
            parts.append((facts, True))
        df = parts[0][0]
        for more, _ in parts[1:]:
            df = df.unionByName(more)
        single = len(parts) == 1 and parts[0][1]
        return Relation(df if single else df.distinct(), self.sig[pred], True)

    def _literal(self, r: Rule) -> bool:
        from fathomlog.syntax import Lit

        return not r.body and bool(r.terms) and all(isinstance(t.expr, Lit) and t.expr.type == s.base for t, s in zip(r.terms, self.sig[r.pred], strict=True))

    def _merged_facts(self, rules: list[Rule]) -> list[Rule]:
        return [r for r in rules if not self._literal(r)]

    def _facts(self, pred: str, rules: list[Rule]) -> DataFrame | None:
        """All constant facts of a predicate as one local relation."""
        rows = list(dict.fromkeys(tuple(t.expr.value for t in r.terms) for r in rules if self._literal(r)))
        if not rows:
            return None
        return self.spark.createDataFrame(rows, empty(self.spark, self.sig[pred]).schema)

    def _new(self, rows: DataFrame, seen: DataFrame | None, types: list[Type]) -> DataFrame:
        rows = rows.distinct()
        if seen is not None:
            other = seen.toDF(*(f"s{c}" for c in seen.columns))
            test = F.lit(True)
            for c, t in zip(columns(len(types)), types or [Type("boolean")], strict=True):
                test = test & (F.col(c).eqNullSafe(F.col(f"s{c}")) if t.nullable and t.base != "value" else F.col(c) == F.col(f"s{c}"))
            rows = rows.join(other, test, "left_anti")
        return rows

    def _semi_naive(self, part: list[str], outside) -> None:
        """Each round fires a rule once for every recursive atom, that atom reading the last delta."""
        whole: dict[str, list[DataFrame]] = {}
        delta: dict[str, DataFrame] = {}
        rows_of: dict[str, int] = {}
        inside = set(part)

        def table(dfs: list[DataFrame]) -> DataFrame:
            out = dfs[0]
            for more in dfs[1:]:
                out = out.unionByName(more)
            return out

        for p in part:
            base = [r for r in self.core.rules[p] if not any(isinstance(a, Atom) and not a.negated and a.pred in inside for a in r.body)]
            rows = self._union(p, base, outside).df if base else empty(self.spark, self.sig[p])
            delta[p], rows_of[p] = self.store.counted(rows)
            whole[p] = [delta[p]]
        step = 0
        while True:
            live = {p for p in part if rows_of[p]}
            self._tell("round", stratum=part, round=step, new=dict(rows_of))
            if not live:
                break
            if self.max_iterations is not None and step >= self.max_iterations:
                self.capped += part
                break
            step += 1
            fresh: dict[str, tuple[DataFrame, int]] = {}
            for p in part:
                made = []
                for number, r in enumerate(self.core.rules[p]):
                    spots = [k for k, a in enumerate(r.body) if isinstance(a, Atom) and not a.negated and a.pred in live]
                    for k in spots:

                        def read(atom, index, k=k):
                            if atom.pred in inside and not atom.negated:
                                return Relation(delta[atom.pred] if index == k else table(whole[atom.pred]), self.sig[atom.pred], True)
                            return outside(atom, index)

                        made.append(self._rows(r, read, k)[0])
                        if self.trace:
                            self._tell("rule", stratum=part, round=step, predicate=p, rule=number, derived=made[-1].count())
                if made:
                    rows = table(made)
                    fresh[p] = self.store.counted(self._new(rows, table(whole[p]), self.sig[p]))
                else:
                    fresh[p] = empty(self.spark, self.sig[p]), 0
            for p in part:
                delta[p], rows_of[p] = fresh[p]
                if rows_of[p]:
                    whole[p].append(delta[p])
                if len(whole[p]) > 8:  # few, larger tables plan and scan faster
                    whole[p] = [self.store.keep(table(whole[p]))]
        for p in part:
            self.relations[p] = Relation(table(whole[p]), self.sig[p], True)

    def _alternate(self, part: list[str]) -> None:
        """Least and greatest sides in turn, until the greatest no longer changes.

        The greatest starts as everything, which is never built: negating it gives nothing.
        """
        low = [p for p in part if not self.core.rules[p][0].maximal]
        high = [p for p in part if self.core.rules[p][0].maximal]
        upper: dict[str, Relation] | None = None
        for step in count() if self.max_iterations is None else range(self.max_iterations + 1):

            def from_low(atom, index, upper=upper):
                if atom.pred in high:
                    return None if upper is None else upper[atom.pred]
                return self.relations[atom.pred]

            self._group(low, from_low)
            self._group(high, self.read)
            now = {p: self.relations[p] for p in high}
            if upper is not None and all(self._equal(now[p], upper[p]) for p in high):
                return
            upper = now
            self._tell("alternation", stratum=part, alternation=step)
        self.capped += part

    def _group(self, preds: list[str], outside) -> None:
        sub = Core(rules={p: self.core.rules[p] for p in preds})
        for inner in strata(sub):
            if is_recursive(sub, inner):
                self._semi_naive(inner, outside)
            else:
                p = inner[0]
                found = self._union(p, self.core.rules[p], outside)
                self.relations[p] = Relation(self.store.keep(found.df), found.types, True)

    def _equal(self, a: Relation, b: Relation) -> bool:
        return a.df.count() == b.df.count() and self._new(a.df, b.df, a.types).isEmpty()
