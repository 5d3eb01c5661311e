"""Embedding near-dedup: an epsilon grid order join of unit vectors.

Cosine at least t is a distance of at most eps = sqrt(2 - 2 t) between unit vectors. Vectors
are projected on their leading principal axes and sorted by the grid cells (of width eps) of
the first of these. The sequence is cut into blocks; pairs of blocks whose bounding boxes are
more than eps apart are skipped, and each other pair is one task. It joins intervals of both
sequences recursively: pairs of intervals too far apart are skipped, pairs that lie wholly
within eps are linked without looking at their members, and what is left is halved down to
small ones that one matrix product compares. Boxes bound the projections, which never are
farther apart than the vectors; cosines are those of the vectors themselves.

A block is sent once to each block that is near enough. There are as many blocks as give the
cluster enough pairs, so that the rows sent are proportional to the table as long as blocks
fit ``BLOCK_BYTES``; beyond, their number grows with the table, and what is sent with the
number of near blocks. Only a bounded table of boxes is seen by the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, forest
from .workspace import Workspace, partitions

THRESHOLD = 0.9
#: Leading axes with grid cells, and those that boxes bound; rows of an interval that is not halved.
AXES, BOUNDED, LEAF = 4, 16, 256
#: Vectors sent as one row; bytes of the vectors of a block, and pairs of blocks for each core, at least.
CHUNK, BLOCK_BYTES, PAIRS_PER_CORE = 512, 16 << 20, 3
#: Boxes at the driver, and range partitions, at most.
SUPER = 2048
#: Added to what is compared with eps, above any rounding.
SLACK = 1e-7


def unit_rows(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are usable, their unit vectors): of ``size`` components, finite and not zero."""
    flat = column.flatten()
    lengths = np.array(column.value_lengths().fill_null(0).to_pylist() if column.null_count else column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become nan
    starts = np.cumsum(lengths) - lengths
    ok = lengths == size
    at = np.flatnonzero(ok)
    if not len(at):
        return ok, np.zeros((0, size))
    rows = values[starts[at][:, None] + np.arange(size)]
    with np.errstate(over="ignore", invalid="ignore"):
        top = np.abs(rows).max(axis=1)
        good = np.isfinite(top) & (top > 0)
        rows, top = rows[good], top[good]
        far = (top > 1e150) | (top < 1e-150)  # squares overflow or vanish
        rows[far] /= top[far, None]
    ok[at[~good]] = False
    return ok, rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1) if raw else np.zeros((0, 0))


def _units(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, rows = unit_rows(batch.column(1), size)
            ids = batch.column(0).filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([ids, pa.array([r.tobytes() for r in rows], pa.binary())], ["id", "unit"])

    return run


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        x = _matrix(batch.column(0))
        if len(x):
            x = np.column_stack([np.ones(len(x)), x])
            total = x.T @ x if total is None else total + x.T @ x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "v"])


def _cells(axes: np.ndarray, eps: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.floor(_matrix(batch.column(2)).reshape(-1, len(axes)) @ axes[:, :AXES] / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(cells[:, min(k, cells.shape[1] - 1)]) for k in range(AXES))], ["id", "copies", "unit", *(f"c{k}" for k in range(AXES))])

    return run


def _chunks(axes: np.ndarray):
    """Chunks of a partition's sequence: (part, at, n, ids, copies, units, low, high)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            for first in range(0, batch.num_rows, CHUNK):
                some = batch.slice(first, CHUNK)
                y = _matrix(some.column(3))
                z = y @ axes
                parts = [*(some.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2)), y, z.min(axis=0), z.max(axis=0)]
                yield pa.RecordBatch.from_arrays([some.column(0).slice(0, 1), pa.array([at], pa.int64()), pa.array([some.num_rows], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], ["part", "at", "n", "ids", "copies", "units", "low", "high"])
                at += some.num_rows

    return run


def box_distance(low1, high1, low2, high2) -> np.ndarray:
    """Least distance of two boxes (or rows of boxes)."""
    gap = np.maximum(0, np.maximum(low1 - high2, low2 - high1))
    return np.sqrt((gap * gap).sum(axis=-1))


def join_boxes(low: np.ndarray, high: np.ndarray, eps: float) -> list[tuple[int, int]]:
    """Pairs i <= j of boxes at most eps apart, by recursion over intervals of their sequence."""
    out: list[tuple[int, int]] = []

    def go(a, b, c, d):
        if box_distance(low[a:b].min(axis=0), high[a:b].max(axis=0), low[c:d].min(axis=0), high[c:d].max(axis=0)) > eps:
            return
        if b - a == 1 and d - c == 1:
            out.append((a, c))
        elif (a, b) == (c, d):
            m = (a + b) // 2
            go(a, m, a, m)
            go(a, m, m, b)
            go(m, b, m, b)
        elif b - a >= d - c:
            m = (a + b) // 2
            go(a, m, c, d)
            go(m, b, c, d)
        else:
            m = (c + d) // 2
            go(a, b, c, m)
            go(a, b, m, d)

    if len(low):
        go(0, len(low), 0, len(low))
    return out


class _Tree:
    """Boxes of the projections and balls of the vectors, of a row range and its halves."""

    def __init__(self, y: np.ndarray, z: np.ndarray, a: int, b: int):
        self.a, self.b = a, b
        self.low, self.high = z[a:b].min(axis=0), z[a:b].max(axis=0)
        self.centre = y[a:b].mean(axis=0)
        self.radius = float(np.sqrt(((y[a:b] - self.centre) ** 2).sum(axis=1).max()))
        self.halves = [_Tree(y, z, a, m), _Tree(y, z, m, b)] if b - a > LEAF and (m := (a + b) // 2) else []


def join_blocks(y: np.ndarray, z: np.ndarray | None, w: np.ndarray, v: np.ndarray | None, threshold: float, axes: np.ndarray | None = None):
    """Links of two blocks (of one with itself if ``z`` is None): counts for both, a forest of row pairs.

    ``w`` and ``v`` weigh the rows: how many copies each stands for. Rows of z follow those of y.
    ``axes`` (orthonormal columns) give the projections that boxes bound.
    """
    eps = float(np.sqrt(2 - 2 * threshold))
    axes = np.eye(y.shape[1]) if axes is None else axes
    same = z is None
    n = len(y)
    z, v = (y, w) if same else (z, v)
    base = 0 if same else n
    counts = [np.zeros(n, np.int64), np.zeros(len(z), np.int64)]
    label = np.arange(base + len(z))
    edges: list[tuple[np.ndarray, np.ndarray]] = []

    def link(i, j):
        nonlocal label
        x1, x2 = label[i], label[j + base]
        new = x1 != x2
        if new.any():
            u, root = forest(x1[new], x2[new])
            edges.append((u, root))
            move = np.arange(len(label))
            move[u] = root
            label = move[label]

    def go(p, q):
        if box_distance(p.low, p.high, q.low, q.high) > eps + SLACK:
            return
        near = float(np.sqrt(((p.centre - q.centre) ** 2).sum())) + p.radius + q.radius < eps - SLACK
        if near or not (p.halves or q.halves):
            if near:
                i, j = np.arange(p.a, p.b), np.arange(q.a, q.b)
                rows, cols = v[q.a : q.b].sum(), w[p.a : p.b].sum()
                counts[0][p.a : p.b] += rows - (v[q.a : q.b] if p is q else 0)
                if p is not q:
                    counts[1][q.a : q.b] += cols
                link(i, np.full(len(i), q.a))
                link(np.full(len(j), p.a), j)
                return
            hit = y[p.a : p.b] @ z[q.a : q.b].T >= threshold
            if not hit.any():
                return
            if p is q:
                np.fill_diagonal(hit, False)
            counts[0][p.a : p.b] += hit @ v[q.a : q.b]
            if p is not q:
                counts[1][q.a : q.b] += w[p.a : p.b] @ hit
            i, j = np.nonzero(hit)
            if len(i):
                link(i + p.a, j + q.a)
            return
        if p is q:
            first, second = p.halves
            for pair in ((first, first), (first, second), (second, second)):
                go(*pair)
        elif p.halves and (not q.halves or p.b - p.a >= q.b - q.a):
            for half in p.halves:
                go(half, q)
        else:
            for half in q.halves:
                go(p, half)

    top = _Tree(y, y @ axes, 0, n)
    go(top, top if same else _Tree(z, z @ axes, 0, len(z)))
    if same:
        counts = [counts[0] + counts[1], np.zeros(0, np.int64)]
    a, b = (np.concatenate(x) for x in zip(*edges, strict=True)) if edges else (np.zeros(0, np.int64),) * 2
    return *counts, a, b


def _joined(threshold: float, axes: np.ndarray):
    """From chunks (b1, b2, role, ids, copies, units) sorted by pair of blocks and role."""

    def joined(chunks):
        sides = []
        for role in (0, 1):
            own = [c[1:] for c in chunks if c[0] == role]
            sides.append([np.concatenate(x) for x in zip(*own, strict=True)] if own else None)
        (i1, w1, y), other = sides[0], sides[1]
        i2, w2, z = other or (np.zeros(0, np.int64), None, None)
        n1, n2, a, b = join_blocks(y, z, w1, w2, threshold, axes)
        ids, n = np.concatenate([i1, i2]), np.concatenate([n1, n2])
        some = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[some], ids[a]])), pa.array(np.concatenate([n[some], ids[b]])), pa.array(np.concatenate([np.zeros(len(some), bool), np.ones(len(a), bool)]))], ["x", "y", "edge"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            pair = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for k in range(batch.num_rows):
                if pair[k] != key and held:
                    yield joined(held)
                    held = []
                key = pair[k]
                ids, copies, units = (np.frombuffer(batch.column(c)[k].as_py(), t) for c, t in ((3, np.int64), (4, np.int64), (5, np.float64)))
                held.append((batch.column(2)[k].as_py(), ids, copies, units.reshape(len(ids), -1)))
        if held:
            yield joined(held)

    return run


def embedding_dedup(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``vectors``: id_col, n_links, component_id, kept.

    n_links counts other rows at cosine >= threshold, copies included; component_id is the
    smallest id reachable by links; kept says that it is the row's own. Vectors that are
    null, empty, zero, or hold null or non-finite components link with nothing, and so do
    those of another length than most usable ones (the shorter of equally frequent lengths
    counts). Rows that repeat an id are counted each, and each has the component of
    its own vector. Rows without an id link with nothing. Other columns are ignored; no
    rows give none.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "ego")
    source = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = source.where("id is not null and size(v) > 0").where(~odd & F.exists("v", lambda x: x != 0))
    lengths = usable.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("rows"))
    most = lengths.orderBy(F.desc("rows"), "size").first()
    if most is None:
        out = source.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
        return _told(out, vectors.schema[id_col].dataType, id_col)
    size = most[0]
    units = ws.write(usable.where(F.size("v") == size).mapInArrow(_units(size), "id long, unit binary"), "units")
    # Equal vectors are one member with a weight, under a number of its own.
    classes = units.groupBy("unit").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    members = ws.write(classes.withColumn("id", F.monotonically_increasing_id()), "members")
    sums = {r[0]: r[1] for r in members.select("unit").mapInArrow(_moments, "at long, v double").groupBy("at").agg(F.sum("v")).collect()}
    m = np.array([sums[k] for k in range((size + 1) ** 2)]).reshape(size + 1, size + 1)
    rows, mean = int(m[0, 0]), m[0, 1:] / m[0, 0]
    axes = np.linalg.eigh(m[1:, 1:] / m[0, 0] - np.outer(mean, mean))[1][:, ::-1][:, :BOUNDED].copy()
    eps = float(np.sqrt(2 - 2 * threshold))
    cells = [f"c{k}" for k in range(AXES)]
    blocks = max(math.isqrt(2 * PAIRS_PER_CORE * spark.sparkContext.defaultParallelism) + 1, -(-rows * size * 8 // block_bytes))
    block_rows = max(CHUNK if block_bytes == BLOCK_BYTES else 1, -(-rows // blocks))
    placed = members.select("id", "copies", "unit").mapInArrow(_cells(axes, eps), "id long, copies long, unit binary, " + ", ".join(f"{c} int" for c in cells))
    ordered = placed.repartitionByRange(min(SUPER, max(partitions(spark), blocks)), *cells, "id").sortWithinPartitions(*cells, "id")
    ordered = ordered.select(F.spark_partition_id().alias("part"), "id", "copies", "unit")
    spans = ws.write(ordered.mapInArrow(_chunks(axes), "part int, at long, n long, ids binary, copies binary, units binary, low binary, high binary"), "chunks")
    # Where each partition begins in the whole sequence says which block a chunk is of.
    begins, total = [], 0
    for part, n in sorted(tuple(r) for r in spans.groupBy("part").agg(F.sum("n")).collect()):
        begins.append((part, total))
        total += n
    begins = F.broadcast(spark.createDataFrame(begins, "part int, begin long"))
    spans = spans.join(begins, "part").withColumn("block", F.floor((F.col("begin") + F.col("at")) / block_rows))
    boxes = spans.groupBy("block").agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high"))
    boxes = ws.write(boxes.mapInArrow(_hull, "block long, low binary, high binary").withColumn("super", F.floor(F.col("block") / -(-(total // block_rows + 1) // SUPER))), "boxes")
    tops = boxes.select(F.col("super").alias("block"), "low", "high").groupBy("block").agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high")).mapInArrow(_hull, "block long, low binary, high binary").collect()
    tops.sort()
    low, high = (np.array([np.frombuffer(t[k]) for t in tops]) for k in (1, 2))
    pairs = spark.createDataFrame([(tops[i][0], tops[j][0]) for i, j in join_boxes(low, high, eps + SLACK)], "p1 long, p2 long")
    one, two = boxes.toDF("b1", "low1", "high1", "p1"), boxes.toDF("b2", "low2", "high2", "p2")
    close = pairs.join(one, "p1").join(two, "p2").where("b1 <= b2").select("b1", "b2", "low1", "high1", "low2", "high2").mapInArrow(_near_boxes(eps + SLACK), "b1 long, b2 long")
    close = ws.write(close, "pairs")
    first = close.select("b1", "b2", F.lit(0).alias("role"), F.col("b1").alias("block"))
    second = close.where("b1 < b2").select("b1", "b2", F.lit(1).alias("role"), F.col("b2").alias("block"))
    sent = spans.select("block", "ids", "copies", "units").join(first.unionByName(second), "block").select("b1", "b2", "role", "ids", "copies", "units")
    task = sent.repartition(partitions(spark), "b1", "b2").sortWithinPartitions("b1", "b2", "role")
    found = ws.write(task.mapInArrow(_joined(threshold, axes), "x long, y long, edge boolean"), "found")
    ws.drop("chunks")
    counts = found.where("not edge").groupBy("x").agg(F.sum("y").alias("links"))
    comp = components(found.where("edge").select(F.col("x").alias("a"), F.col("y").alias("b")), ws, "comp")
    label = members.join(counts.withColumnRenamed("x", "id"), "id", "left").join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    smallest = label.groupBy("component").agg(F.min("rep").alias("component_id"))
    label = label.join(smallest, "component").select("unit", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = units.join(label, "unit").select("id", "n_links", "component_id")
    rest = source.where(F.col("id").isNull()).select("id").unionByName(source.where("id is not null").select("id").exceptAll(linked.select("id")))
    out = linked.unionByName(rest.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return _told(out, vectors.schema[id_col].dataType, id_col)


def _told(out: DataFrame, kind, id_col: str) -> DataFrame:
    return out.select(F.col("id").cast(kind).alias(id_col), "n_links", "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"))


def _hull(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        low = [np.min([np.frombuffer(x) for x in row], axis=0).tobytes() for row in batch.column(1).to_pylist()]
        high = [np.max([np.frombuffer(x) for x in row], axis=0).tobytes() for row in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(low, pa.binary()), pa.array(high, pa.binary())], ["block", "low", "high"])


def _near_boxes(eps: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            low1, high1, low2, high2 = (_matrix(batch.column(k)) for k in range(2, 6))
            ok = pa.array(box_distance(low1, high1, low2, high2) <= eps)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(ok) for k in (0, 1)], ["b1", "b2"])

    return run
