"""Connected components of a graph given by links, without collecting it anywhere.

Large-star and small-star steps (each a grouped minimum and a join) alternate until nothing
changes; each pass is written to the shared folder. Before the first, every task contracts
its own links to a forest, so that copies of links and most of the chains never move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

#: Links that a task contracts at a time.
CHUNK = 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of the nodes in links a-b, but for those smallest nodes."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        # Hook the roots of both ends, then halve all paths until they are flat.
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            flat = new[new]
            if (flat == new).all():
                break
            new = flat
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    rows = 0
    for batch in batches:
        held.append(np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]))
        rows += batch.num_rows
        if rows >= CHUNK:
            held = [np.stack(forest(*np.concatenate(held, axis=1)))]
            rows = 0
            if held[0].shape[1] > CHUNK // 2:
                yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], ["a", "b"])
                held = []
    if held:
        u, v = forest(*np.concatenate(held, axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["a", "b"])


def components(links: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b: longs) but the smallest of each component.

    component is the smallest node that can be reached. Links may repeat, run either way, or
    lead from a node to itself; no links give no rows.
    """
    edges = ws.write(links.select("a", "b").where("a <> b").mapInArrow(_contract, "a long, b long"), f"{name}-0")
    step = 0
    while True:
        step += 1
        # Large star: every larger neighbour moves to the smallest of the node and its neighbours.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: the node and its smaller neighbours move to the smallest of these.
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        new = ws.write(moved.unionByName(small.select("a", F.col("m").alias("b"))).distinct().withColumn("h", F.xxhash64("a", "b")), f"{name}-{step}")
        now = new.agg(F.count(F.lit(1)), F.sum(F.col("h").cast("decimal(38,0)"))).first()
        was = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        ws.drop(f"{name}-{step - 1}")
        edges = new.select("a", "b")
        if tuple(now) == tuple(was):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
