"""Programs on Spark: bind inputs, run a text, get a DataFrame for each output."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.fixpoint import Engine
from .operators.rules import Body, Relation, empty
from .plans.advice import advise
from .plans.desugar import Core, Desugar, desugar, elaborate
from .plans.inference import infer
from .plans.obligations import obligations
from .plans.typing import Typer
from .shipping import ship
from .sources.loaders import exists, from_frame, load
from .syntax import Agg, Constraint, Input, Program, ProgramError, Query, Rule, Var, parse, variables

PROBE = "__probe"


class ConstraintError(Exception):
    """Data that violates a program's own constraints."""

    def __init__(self, violations: list[str]):
        super().__init__("; ".join(violations))
        self.violations = violations


@dataclass
class Bound:
    source: DataFrame | str
    format: str | None = None
    unique: bool = False


@dataclass
class Result:
    """Outputs by label (``default`` is the query), in source order."""

    outputs: dict[str, DataFrame] = field(default_factory=dict)
    #: Predicates whose recursion was cut off by the iteration limit.
    capped: list[str] = field(default_factory=list)

    def __getitem__(self, label: str) -> DataFrame:
        return self.outputs[label]


def head_names(rule: Rule, shown: int) -> list[str]:
    """Names of an output's columns: a variable's own, an aggregate's function, else its place."""
    out: list[str] = []
    for k, t in enumerate(rule.terms[:shown]):
        name = t.expr.name if isinstance(t.expr, Var) else t.expr.func if isinstance(t.expr, Agg) else f"col{k + 1}"
        while name in out:
            name += "_"
        out.append(name)
    return out


class Session:
    """Runs programs. ``directory`` holds files ``<predicate>.<extension>`` for unbound inputs.

    ``max_iterations`` limits the rounds of a recursion (none by default); what was derived up to there is kept
    and the predicates are named in ``Result.capped``. ``trace`` gets a dict for each stratum, round and rule.
    ``csv_header`` says whether the first row of CSV files names the columns.
    """

    def __init__(self, spark: SparkSession, directory: str | None = None, max_iterations: int | None = None, trace: Callable[[dict], None] | None = None, resolve: Callable[[str], str] | None = None, csv_header: bool = True):
        self.spark, self.directory, self.csv_header = spark, directory, csv_header
        self.max_iterations, self.trace = max_iterations, trace
        self.resolve = resolve or self._read_module
        self.bound: dict[str, Bound] = {}
        ship(spark)
        spark.conf.set("spark.sql.caseSensitive", "true")

    def bind(self, name: str, source: DataFrame | str, format: str | None = None, unique: bool = False) -> Session:
        """Give an input its rows. ``unique`` promises distinct rows over the declared columns,
        which saves the shuffle that makes them a set before aggregates."""
        self.bound[name] = Bound(source, format, unique)
        return self

    def _read_module(self, path: str) -> str:
        with open(os.path.join(self.directory or ".", path), encoding="utf-8") as f:
            return f.read()

    def _input(self, decl: Input) -> Relation:
        types = self._sig[decl.name]
        b = self.bound.get(decl.name)
        if b is None and decl.binding is not None:
            b = Bound(os.path.join(self.directory or "", decl.binding.source) if "://" not in decl.binding.source and not decl.binding.source.startswith("gh:") else decl.binding.source, decl.binding.format)
        if b is None and self.directory:
            for ext in ("csv", "jsonl", "json", "parquet", "mmd"):
                path = os.path.join(self.directory, f"{decl.name}.{ext}")
                if exists(self.spark, path):
                    b = Bound(path)
                    break
        if b is None:  # an input that nothing supplies is empty
            return Relation(empty(self.spark, types), types, True)
        df = from_frame(b.source, decl) if isinstance(b.source, DataFrame) else load(self.spark, b.source, decl, b.format, self.csv_header)
        return Relation(df, types, b.unique)

    def compile(self, source: str | Program) -> Core:
        core = desugar(parse(source) if isinstance(source, str) else source, self.resolve)
        self._sig = infer(core)
        return core

    def run(self, source: str | Program, check: bool = True) -> Result:
        """Check constraints, then give the outputs as lazy DataFrames (recursion is evaluated)."""
        core = self.compile(source)
        return self._run(core, check)

    def _run(self, core: Core, check: bool = True, outputs: list[str] | None = None) -> Result:
        engine = Engine(self.spark, core, self._sig, {n: self._input(i) for n, i in core.inputs.items()}, self.max_iterations, self.trace)
        wanted = set(core.outputs if outputs is None else outputs)
        bodies = [c.body for c in core.constraints] + ([core.query.body] if core.query else [])
        wanted |= {a.pred for body in bodies for a in body if hasattr(a, "pred")}
        engine.run(wanted)
        self.engine = engine
        if check:
            bad = [c.text or "constraint" for c in core.constraints if not self.violations(core, c).isEmpty()]
            if bad:
                raise ConstraintError(bad)
        result = Result(capped=engine.capped)
        for name in core.outputs if outputs is None else outputs:
            rel = engine.relations[name]
            label = name + "^" if core.rules[name][0].maximal else name
            names = head_names(core.rules[name][0], core.shown[name])
            df = rel.df.select(*(F.col(f"c{k}").alias(n) for k, n in enumerate(names))) if names else rel.df.select(F.lit(True).alias(PROBE))
            result.outputs[label] = df.distinct() if name in core.proofs else df
        if core.query:
            result.outputs["default"] = self.answers(core, core.query)
        return result

    def violations(self, core: Core, c: Constraint) -> DataFrame:
        return self._bindings(core, c.body)

    def answers(self, core: Core, q: Query) -> DataFrame:
        return self._bindings(core, q.body)

    def _bindings(self, core: Core, body: tuple) -> DataFrame:
        names = [v for v in variables(body) if not v.startswith("$") and v != "_"]
        builder = Body(self.spark, body, self._sig, self.engine.read, set(names), False)
        df = builder.build()
        missing = [v for v in names if v not in builder.bound]
        if missing:
            raise ProgramError(f"no positive atom binds {', '.join(missing)}")
        Typer({**builder.env, **builder.types})
        if not names:
            return df.select(F.lit(True).alias(PROBE)).limit(1)
        return df.select(*(F.col(builder.bound[v]).alias(v) for v in names)).distinct()

    def advice(self, source: str, warn_undefined: bool = False) -> list[str]:
        """Warnings: recursion that may not end, unused inputs, checks that never run, rows lost to nulls."""
        core = self.compile(source)
        return advise(core, self._sig, warn_undefined)

    def obligations(self, source: str) -> dict[str, str]:
        """SMT-LIB texts whose ``unsat`` proves constraints for any data."""
        core = self.compile(source)
        return obligations(core, self._sig)

    def holds(self, source: str) -> bool:
        """Whether the query of a program has an answer."""
        return not self.run(source)["default"].isEmpty()

    def explain(self, source: str, pred: str, mode: str = "formatted") -> None:
        core = self.compile(source)
        self._run(core, False, [pred])
        self.engine.relations[pred].df.explain(mode)


class Incremental:
    """A program that grows by chunks: each is analysed with all before it, or changes nothing."""

    def __init__(self, session: Session):
        self.session = session
        self.statements: list = []

    def reset(self) -> None:
        self.statements = []

    def add(self, chunk: str) -> Result:
        """Outputs and query of this chunk. Its constraints are checked now; queries are not kept."""
        new = parse(chunk).statements
        old = {s.pred for s in self.statements if isinstance(s, Rule)} | {s.name for s in self.statements if isinstance(s, Input)}
        for s in new:
            name = s.pred if isinstance(s, Rule) else s.name if isinstance(s, Input) else None
            if name in old:
                raise ProgramError(f"{name} is defined already")
        fresh = [s.pred for s in new if isinstance(s, Rule) and s.marker == "output"]
        kept = [s for s in self.statements if not isinstance(s, Constraint)]
        program = Program([*kept, *new])
        core = Desugar(elaborate(program, self.session.resolve)).run()
        self.session._sig = infer(core)
        result = self.session._run(core, True, list(dict.fromkeys(fresh)))
        self.statements += [s for s in new if not isinstance(s, Query)]
        return result

    def schema(self) -> dict[str, list[str]]:
        core = Desugar(elaborate(Program(self.statements), self.session.resolve)).run()
        return {p: [str(t) for t in types[: core.shown[p]]] for p, types in infer(core).items()}
