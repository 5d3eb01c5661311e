"""Command line: python -m fathomlog.cli [options] program.dl; without a program, a prompt."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .formats import FORMATS
from .plans.obligations import verify
from .session import ConstraintError, Incremental, Session
from .syntax import ProgramError


def prompt(session: Session, show) -> None:
    """Statements as they are typed; :show, :schema, :reset and :quit."""
    growing, held = Incremental(session), ""
    for line in sys.stdin:
        word = line.strip()
        if word == ":quit":
            return
        if word == ":reset":
            growing.reset()
        elif word == ":schema":
            for p, types in growing.schema().items():
                print(f"{p}({', '.join(types)})")
        elif word == ":show":
            print("\n".join(map(str, growing.statements)))
        else:
            held += line
            if not held.rstrip().endswith("."):
                continue
            try:
                for df in growing.add(held).outputs.values():
                    print(show(df))
            except (ProgramError, ConstraintError) as e:
                print(f"error: {e}", file=sys.stderr)
            held = ""


def main(argv: list[str] | None = None) -> int:
    args = argparse.ArgumentParser(prog="fathomlog", description=__doc__)
    args.add_argument("program", nargs="?")
    args.add_argument("--input", action="append", default=[], metavar="NAME=PATH")
    args.add_argument("--format", choices=FORMATS, default="table")
    args.add_argument("--output", help="only this output")
    args.add_argument("--max-iterations", type=int, help="no limit by default")
    args.add_argument("--explain", metavar="PREDICATE")
    args.add_argument("--dry-run", action="store_true", help="analyse only, and print warnings")
    args.add_argument("--obligations", action="store_true", help="print SMT-LIB texts of the constraints")
    args.add_argument("--verify", action="store_true", help="have a solver prove the refinements")
    args.add_argument("--solver", default="z3 -in", help="reads SMT-LIB from its standard input")
    args.add_argument("--strict-contracts", action="store_true", help="warnings of contracts are errors")
    args.add_argument("--trace", action="store_true")
    args.add_argument("--warn-undefined", action="store_true", help="also warn of expressions that may have no value")
    args.add_argument("--no-csv-header", action="store_true", help="CSV files begin with data")
    given = args.parse_args(argv)
    spark = SparkSession.builder.appName("fathomlog").getOrCreate()
    folder = os.path.dirname(os.path.abspath(given.program)) if given.program else os.getcwd()
    session = Session(spark, folder, given.max_iterations, (lambda e: print(e, file=sys.stderr)) if given.trace else None, csv_header=not given.no_csv_header)
    for pair in given.input:
        name, _, path = pair.partition("=")
        if not path or name in session.bound:
            print(f"error: --input {pair}: " + ("twice" if path else "NAME=PATH is needed"), file=sys.stderr)
            return 1
        session.bind(name, path)
    show = FORMATS[given.format]
    if not given.program:
        prompt(session, show)
        return 0
    with open(given.program, encoding="utf-8") as f:
        source = f.read()
    try:
        if given.explain:
            session.explain(source, given.explain)
            return 0
        for line in session.advice(source, given.warn_undefined):
            print(f"warning: {line}", file=sys.stderr)
            if given.strict_contracts and line.startswith(("inert-contract", "constant-refinement")):
                return 1
        if given.verify:
            told = verify(session.obligations(source), given.solver)
            print("\n".join(f"{name}: {what}" for name, what in told.items()))
            return int(any(what != "proved" for what in told.values()))
        if given.obligations:
            print("\n".join(f"; {name}\n{text}" for name, text in session.obligations(source).items()))
        if given.dry_run or given.obligations:
            return 0
        result = session.run(source)
    except (ProgramError, ConstraintError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    for label, df in result.outputs.items():
        if given.output in (None, label):
            if len(result.outputs) > 1:
                print(f"# {label}")
            print(show(df))
    for p in result.capped:
        print(f"warning: {p} was cut off after {given.max_iterations} rounds", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
