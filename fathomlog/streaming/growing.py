"""A program kept up to date over a stream: each micro-batch is appended to an input and the outputs rerun.

The language has no time, windows or state of its own. What a stream adds are rows of an
input relation; as relations are sets and rules may negate and aggregate, outputs are those of
the whole input so far. Batches are kept as Parquet below the shared folder, so a restart of
the query goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from fathomlog.session import Result, Session


def follow(session: Session, program: str, name: str, stream: DataFrame, folder: str, sink: Callable[[Result, int], None], **trigger) -> StreamingQuery:
    """Start a query that feeds ``stream`` to the input ``name`` and gives each result to ``sink``.

    ``folder`` holds the rows so far and the checkpoint; a batch that is replayed replaces its
    own rows. ``trigger`` is what ``DataStreamWriter.trigger`` takes.
    """
    spark = session.spark

    def batch(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/epoch={epoch}")
        whole = spark.read.parquet(f"{folder}/rows").drop("epoch")
        sink(session.bind(name, whole).run(program), epoch)

    return stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).foreachBatch(batch).start()
