"""Notebook magic: ``%load_ext fathomlog.magic``, then ``%%fathomlog [name]`` above a chunk.

Chunks add to one program; the last output is bound to ``name`` (default ``_rows``) as pandas.
"""

from __future__ import annotations

from .formats import table
from .session import Incremental, Session


class Cells:
    """The growing program of one notebook."""

    def __init__(self, session: Session):
        self.program = Incremental(session)

    def run(self, line: str, cell: str, namespace: dict) -> str:
        if line.strip() == "reset":
            self.program.reset()
        outputs = self.program.add(cell).outputs
        shown = []
        for df in outputs.values():
            namespace[line.strip() or "_rows"] = df.toPandas()
            shown.append(table(df))
        return "\n".join(shown)


def load_ipython_extension(ipython) -> None:
    from pyspark.sql import SparkSession

    cells = Cells(Session(SparkSession.builder.getOrCreate()))

    def fathomlog(line: str, cell: str) -> None:
        print(cells.run(line, cell, ipython.user_ns))

    ipython.register_magic_function(fathomlog, "cell")
