"""Rows of an output as text: table, CSV, JSON lines, Mermaid and plain graphs; proofs as terms."""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame

from .functions.values import dump, js_number


def proof(text: str) -> str:
    """Canonical text of a value, proofs in it as ``Ctor(a, b)``."""

    def show(x: Any) -> str:
        if isinstance(x, dict) and set(x) == {"$proof", "args"} and isinstance(x["args"], list):
            return f"{x['$proof'].split('::')[-1]}({', '.join(map(show, x['args']))})"
        if isinstance(x, list):
            return "[" + ", ".join(map(show, x)) + "]"
        return dump(x)

    return show(json.loads(text))


def cell(x: Any) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, float):
        return js_number(x)
    text = str(x)
    return proof(text) if '"$proof"' in text and text[:1] in "{[" else text


def rows_of(df: DataFrame) -> Iterable[tuple]:
    """Rows in a fixed order, a partition at a time."""
    return (tuple(r) for r in df.orderBy(*df.columns).toLocalIterator())


def table(df: DataFrame) -> str:
    if df.columns == ["__probe"]:
        return "no" if df.isEmpty() else "yes"
    body = [[cell(x) for x in r] for r in rows_of(df)]
    widths = [max(map(len, c)) for c in zip(df.columns, *body, strict=True)]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, widths, strict=True)).rstrip() for r in [df.columns, *body])


def csv(df: DataFrame) -> str:
    def quoted(text: str) -> str:
        return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\r\n') else text

    return "\n".join(",".join(quoted("" if x is None else cell(x)) for x in r) for r in [tuple(df.columns), *rows_of(df)])


def jsonl(df: DataFrame) -> str:
    return "\n".join(json.dumps(dict(zip(df.columns, r, strict=True)), ensure_ascii=False) for r in rows_of(df))


def jsonl_flat(df: DataFrame) -> str:
    """Rows as arrays, without names."""
    return "\n".join(json.dumps(list(r), ensure_ascii=False) for r in rows_of(df))


def mermaid(df: DataFrame) -> str:
    """Edges of two or three columns as a flowchart."""
    if len(df.columns) not in (2, 3):
        raise ValueError("a diagram needs two or three columns")
    lines = ["graph TD"]
    for r in rows_of(df):
        label = f"|{cell(r[2])}|" if len(r) == 3 and r[2] not in (None, "") else ""
        lines.append(f"  {cell(r[0])} -->{label} {cell(r[1])}")
    return "\n".join(lines)


def graph(df: DataFrame) -> str:
    """Each source with its targets, one line each."""
    out: dict[str, list[str]] = {}
    for r in rows_of(df):
        out.setdefault(cell(r[0]), []).append(cell(r[1]) + (f" ({cell(r[2])})" if len(r) > 2 else ""))
    return "\n".join(f"{a} -> {', '.join(b)}" for a, b in out.items())


FORMATS = {"table": table, "csv": csv, "jsonl": jsonl, "jsonl-flat": jsonl_flat, "mermaid": mermaid, "ascii-graph": graph}
