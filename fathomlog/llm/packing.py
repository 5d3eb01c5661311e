"""Best-fit packing with certified bin counts.

Documents become token sequences of at most ``capacity``; longer ones are cut so that all
pieces but the first are full. Pieces are dealt to partitions of bounded size, each packed
best-fit decreasing. A lower bound by dual-feasible functions certifies a partition's bin
count: no packing of its pieces takes fewer, so its bins are final, but for the emptiest one,
since rests of several partitions may still share a bin. Of partitions with a gap between
count and bound, all bins with room exchange their documents: those bins are dealt to new
partitions and packed best-fit decreasing again, round after round, until no partition has a
gap, one partition is left, or a round saves too little. Only lengths travel, never texts or
ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_tokens import encoder
from .spans import as_strings
from .workspace import Workspace, small_batches

CAPACITY = 2048
#: Pieces packed in one partition, about; rounds go on while they save this share of the bins they pack.
PARTITION_PIECES, WORTH = 16_384, 0.0005


def lower_bound(lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Bins that any packing needs, and the largest sum of a dual-feasible function.

    The functions: length over capacity; that with lengths above capacity - a as 1 and those
    below a as 0; and floor((k + 1) x) / k of inner fractions x, for k up to 20, on top of
    each of the second kind.
    """
    if not len(lengths):
        return 0, 0.0
    sizes, counts = np.unique(lengths, return_counts=True)
    x = sizes / capacity
    best = float(x @ counts)
    cuts = np.unique(np.concatenate([[0], sizes[sizes * 2 <= capacity]]))
    for k in range(21):
        if k:
            scaled = (k + 1) * sizes
            y = np.where(scaled % capacity == 0, x, (scaled // capacity) / k)
        else:
            y = x
        low, high = y * counts, counts * 1.0
        # For every cut a at once: 1 above capacity - a, y between, 0 below a.
        first = np.searchsorted(sizes, cuts)
        last = np.searchsorted(sizes, capacity - cuts, "right")
        sums, ones = np.concatenate([[0], np.cumsum(low)]), np.concatenate([[0], np.cumsum(high)])
        best = max(best, float((sums[last] - sums[first] + ones[-1] - ones[last]).max()))
    return int(np.ceil(best - 1e-9)), best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each length: the fullest that still takes it, longest first.

    Bit r of ``rooms`` says that some bin has room r, so the best bin is one shift away.
    """
    bins = np.empty(len(lengths), np.int64)
    rooms, stacks, made = 0, [[] for _ in range(capacity + 1)], 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms &= ~(1 << room)
        else:
            room, b, made = capacity, made, made + 1
        bins[k] = b
        if room > n:
            if not stacks[room - n]:
                rooms |= 1 << (room - n)
            stacks[room - n].append(b)
    return bins


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``total`` ids; the first takes what is over."""
    first = total % capacity or capacity
    return [(0, min(first, total)), *((s, capacity) for s in range(first, total, capacity))]


def tokenize(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces: ``id_col``, piece, start, length, ids_crc32, and with ``with_ids`` their ids.

    A null or empty text has the end id alone.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            rows, found, raws = [], [], []
            for k, text in enumerate(as_strings(batch.column(1))):
                ids = np.array([*encode(text.as_py()), end_id], "<u4")
                for piece, (start, n) in enumerate(cut(len(ids), capacity)):
                    raw = ids[start : start + n].tobytes()
                    rows.append(k)
                    found.append((piece, start, n, zlib.crc32(raw)))
                    if with_ids:
                        raws.append(raw)
            if not rows:
                continue
            piece, start, n, crc = zip(*found, strict=True)
            columns = [batch.column(0).take(pa.array(rows)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(raws, pa.binary())] if with_ids else [])], ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _packer(capacity: int, level: int, last: bool):
    """Packs the rows of one partition; from the second level on, only if that saves bins."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row").reset_index(drop=True)
        lengths = pdf["length"].to_numpy(np.int64)
        bins = best_fit_decreasing(lengths, capacity)
        _, old = np.unique(pdf["bin"].to_numpy(np.int64), return_inverse=True)
        saved = int(old.max() - bins.max()) if level else 0
        if level and saved <= 0:
            bins, saved = old, 0
        room = capacity - np.bincount(bins, lengths).astype(np.int64)
        certified = len(room) == lower_bound(lengths, capacity)[0]
        moving = (room > 0) & (not last)
        if certified:
            moving &= np.arange(len(room)) == room.argmax()
        pdf["certified"] = certified
        pdf["open"] = moving[bins]
        pdf["bin"] = bins + pdf["part"].to_numpy(np.int64) * (1 << 32) + (level << 56)
        pdf["saved"] = 0
        pdf.loc[0, "saved"] = saved
        pdf["bins"] = 0
        pdf.loc[0, "bins"] = len(room)
        return pdf

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, workspace: Workspace | None = None, partition_pieces: int = PARTITION_PIECES, worth: float = WORTH) -> DataFrame:
    """row, sequence_id, offset (gapless from 0 in each sequence), certified of stored ``pieces``.

    ``pieces`` needs row (a distinct long) and length (1 to capacity). Full pieces are
    sequences of their own, with negative numbers. certified: the bound proves that the
    partition where the piece was last packed took no bin too many. No pieces give no rows.
    """
    ws = workspace or Workspace(pieces.sparkSession, "pack")
    small = pieces.where(F.col("length") < capacity).select("row", "length")
    parts = max(1, -(-small.count() // partition_pieces))
    schema = "row long, length long, part long, bin long, certified boolean, open boolean, saved long, bins long"
    todo = small.select("row", "length", F.pmod(F.xxhash64("row"), F.lit(parts)).alias("part"), F.lit(0).cast("long").alias("bin"))
    level, done = 0, []
    while True:
        packed = ws.write(todo.groupBy("part").applyInPandas(_packer(capacity, level, parts == 1), schema), f"packed{level}")
        left, saved, bins = packed.agg(F.count_if("open"), F.coalesce(F.sum("saved"), F.lit(0)), F.coalesce(F.sum("bins"), F.lit(0))).first()
        if not left or (level and saved < max(1, worth * bins)):
            done.append(packed)
            break
        done.append(packed.where("not open"))
        # Whole bins are dealt anew, so that a partition which saves none can keep them.
        level, parts = level + 1, max(1, -(-left // partition_pieces))
        todo = packed.where("open").select("row", "length", F.pmod(F.xxhash64("bin", F.lit(level)), F.lit(parts)).alias("part"), "bin")
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    before = Window.partitionBy("bin").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select("row", F.col("bin").alias("sequence_id"), F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"), "certified")
    full = pieces.where(F.col("length") >= capacity).select("row", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    return placed.unionByName(full)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """Pieces of ``docs``: ``id_col``, piece, start, length, ids_crc32, sequence_id, offset, certified.

    A null or empty text is one piece of length 1. Rows that repeat an id are documents of
    their own. Other columns are ignored. An empty table gives no rows.
    """
    ws = Workspace(docs.sparkSession, "pack")
    cut_up = tokenize(docs, vocabulary, capacity, id_col, text_col, end_id).withColumnRenamed(id_col, "id")
    pieces = ws.write(cut_up.withColumn("row", F.monotonically_increasing_id()), "pieces")
    out = pieces.join(pack(pieces, capacity, ws, partition_pieces), "row")
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")
