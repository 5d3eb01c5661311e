"""Line dedup by pairwise alignment of overlapping documents.

A run is the shortest sequence of consecutive lines of ``BLOCK`` characters at least that begins,
or ends, at some line. A block that can be deleted holds a run around each of its lines, so
documents overlap if they share one; a later one is aligned with the earliest document that
has the run. A patience diff aligns the two: lines that occur once in both, in an order that
both keep (a longest increasing sequence), are anchors, gaps between anchors are aligned
likewise, and matches grow over equal neighbours. Aligned blocks of at least ``BLOCK``
characters are deleted from the later document, and what is left is aligned again, so that
blocks which moved or repeat are found; shared runs that even then lie in no block, because
their lines repeat in one of the texts, go by themselves. So a line is deleted if, and only
if, it lies in a run that an earlier text holds.

Partners are asked in rounds, ``RAREST`` runs at first and twice as many in each round after:
shared runs that no deleted block covers, and whose earliest holder was not asked, name the
next ones, until none is left. A run names one partner, whatever the number of documents that
share it, so pairs stay linear in the lines and rounds logarithmic in those of a document.
Texts equal to an earlier one are dropped whole first, and only first texts are aligned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import as_strings, prefix, ranges
from .workspace import Workspace

#: Shared runs that name partners in the first round; least characters of a run, and of a deleted block.
RAREST, BLOCK = 4, 60


def patience(a: list, b: list) -> list[tuple[int, int, int]]:
    """Aligned blocks (start in a, start in b, length), in order."""
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        seen_a, seen_b = {}, {}
        for k in range(a0, a1):
            seen_a[a[k]] = -1 if a[k] in seen_a else k
        for k in range(b0, b1):
            seen_b[b[k]] = -1 if b[k] in seen_b else k
        unique = [(i, seen_b.get(x, -1)) for x, i in seen_a.items() if i >= 0 and seen_b.get(x, -1) >= 0]
        if not unique:  # lines that repeat: their first places
            places_a, places_b = ({}, {})
            for places, z, z0, z1 in ((places_a, a, a0, a1), (places_b, b, b0, b1)):
                for k in range(z0, z1):
                    places.setdefault(z[k], k)
            unique = [(i, places_b[x]) for x, i in places_a.items() if x in places_b]
        chain = _increasing(unique)
        if not chain:
            continue
        last = (a0, b0)
        for i, j in chain:
            todo.append((last[0], i, last[1], j))
            pairs.append((i, j))
            last = (i + 1, j + 1)
        todo.append((last[0], a1, last[1], b1))
    blocks: list[list[int]] = []
    for i, j in sorted(pairs):
        if blocks and blocks[-1][0] + blocks[-1][2] == i and blocks[-1][1] + blocks[-1][2] == j:
            blocks[-1][2] += 1
        else:
            blocks.append([i, j, 1])
    return [tuple(x) for x in blocks]


def shared_lines(lines: list, sizes: list[int], other: list, block: int) -> list[int]:
    """Lines in aligned blocks of ``block`` characters; what is left is aligned again, until nothing more is.

    So blocks that stand in another order, or more often, in the later document are found, too.
    Shorter blocks stand aside in turn, as they may have kept a long one from being aligned.
    """
    left, out = list(lines), []
    while True:
        aligned = patience(left, other)
        long = [(i, n) for i, _, n in aligned if sum(sizes[i : i + n]) >= block]
        for i, n in long or [(i, n) for i, _, n in aligned]:
            left[i : i + n] = [("gone", k) for k in range(i, i + n)]
            if long:
                out += range(i, i + n)
        if not aligned:
            return out


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs (sorted by the first) whose second numbers grow."""
    from bisect import bisect_left

    tails, at, back = [], [], []
    for k, (_, j) in enumerate(pairs):
        n = bisect_left(tails, j)
        back.append(at[n - 1] if n else -1)
        if n == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[n], at[n] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def runs(lines: np.ndarray, sizes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of each run of ``block`` characters, from line hashes and their characters."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(len(lines))
    ends = np.searchsorted(total, total[at] + block)
    begins = np.searchsorted(total, total[at + 1] - block, "right") - 1
    forward, backward = ends <= len(lines), begins >= 0
    start, end = np.concatenate([at[forward], begins[backward]]), np.concatenate([ends[forward], at[backward] + 1])
    return start, end, ranges(prefix(lines.view(np.uint64)), start, end).view(np.int64)


def _held(block: int):
    """Each run of a document once: (id, key, run), from (id, key, lines, sizes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, rows = [], []
            for k, (lines, sizes) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                hashes = np.unique(runs(*(x.values.to_numpy(zero_copy_only=False) for x in (lines, sizes)), block)[2])
                found.append(hashes)
                rows.append(np.full(len(hashes), k))
            if found:
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(np.concatenate(found), pa.int64())], ["id", "key", "run"])

    return run


def _align(block: int):
    """From (id, key, lines, sizes, the earlier's lines and sizes): line numbers of the later to delete."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = []
            for lines, sizes, other, more in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True):
                aligned = shared_lines(lines, sizes, other, block)
                start, end, hashes = runs(np.array(lines, np.int64), np.array(sizes, np.int64), block)
                both = np.isin(hashes, runs(np.array(other, np.int64), np.array(more, np.int64), block)[2])
                edge = np.zeros(len(lines) + 1, np.int64)
                np.add.at(edge, start[both], 1)
                np.add.at(edge, end[both], -1)
                gone.append(sorted({*aligned, *np.flatnonzero(np.cumsum(edge[:-1])).tolist()}))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone, pa.list_(pa.int32()))], ["id", "key", "gone"])

    return run


def _open(block: int):
    """From (id, key, rare, asked, lines, sizes, gone): rare runs with lines that stay so far, whose holder was not asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = []
            for k, (rare, asked, gone) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 6)), strict=True)):
                lines, sizes = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in (4, 5))
                stays = np.ones(len(lines), np.int64)
                for part in gone or []:
                    stays[part] = 0
                start, end, hashes = runs(lines, sizes, block)
                some = np.concatenate([[0], np.cumsum(stays)])
                open_, known = set(hashes[some[end] > some[start]].tolist()), set(asked)
                rest.append([x for x in rare if x["earliest"] not in known and x["run"] in open_])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rest, batch.schema.field(2).type)], ["id", "key", "rare"])

    return run


def _delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for text, gone in zip(as_strings(batch.column(2)), batch.column(3), strict=True):
            lines = text.as_py().split("\n")
            stay = np.ones(len(lines), bool)
            for part in gone.as_py():
                stay[part] = False
            kept.append("\n".join([x for x, s in zip(lines, stay.tolist(), strict=True) if s]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept)], ["id", "key", "kept_text"])


def _together(rounds: list[DataFrame]) -> DataFrame:
    """The rounds' deletions, one row for each document."""
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out if len(rounds) == 1 else out.groupBy("id", "key").agg(F.flatten(F.collect_list("gone")).alias("gone"), F.sum("partners").alias("partners"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, rarest: int = RAREST) -> DataFrame:
    """One row per row of ``docs``: id_col, n_lines, n_removed, partners, kept_text.

    Lines are the parts between newlines; they are equal if equal without spaces at their
    ends, compared by 64-bit hashes. ``block`` is the least number of characters of a deleted
    block, ``rarest`` how many runs name partners in the first round. kept_text is null where all lines stay. A text equal to
    that of a smaller id is removed whole (partners 1, kept_text empty). Null and empty texts
    have one empty line, are nobody's partner and stay. Rows that repeat id and text share
    one result; an id with several texts is a partner with each of them; rows without an id stay whole. Other columns are ignored; no rows give none.
    """
    ws = Workspace(docs.sparkSession, "lines")
    kind = docs.schema[id_col].dataType
    texts = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    keyed = texts.withColumn("key", F.sha2("text", 256))
    parts = F.transform(F.split("text", "\n", -1), F.trim)
    listed = keyed.select("id", "key", F.transform(parts, lambda x: F.xxhash64(x)).alias("lines"), F.transform(parts, F.length).alias("sizes"))
    listed = ws.write(listed, "listed")
    whole = listed.where("id is not null and (size(lines) > 1 or sizes[0] > 0)")
    first = ws.write(whole.groupBy("key").agg(F.min("id").alias("first")), "first")
    # By id, too, so that copies of one text lie in many tasks.
    unique = whole.hint("merge").join(first.withColumnRenamed("first", "id"), ["key", "id"]).dropDuplicates(["id", "key"])
    unique = ws.write(unique.select("id", "key", "lines", "sizes"), "unique")
    held = ws.write(unique.select("id", "key", "lines", "sizes").mapInArrow(_held(block), f"id {kind.simpleString()}, key string, run long"), "held")
    # Written before the join, so that the rows of a frequent run can be split.
    index = ws.write(held.groupBy("run").agg(F.count(F.lit(1)).alias("df"), F.min("id").alias("earliest")).where("df > 1"), "index")
    found = held.hint("merge").join(index, "run").where("earliest < id")
    todo = ws.write(found.groupBy("id", "key").agg(F.sort_array(F.collect_list(F.struct("df", "run", "earliest"))).alias("rare")), "shared0")
    ws.drop("held", "index")
    shared, take, rounds = todo.schema["rare"].dataType.simpleString(), rarest, []
    while True:
        k = len(rounds)
        turn = todo.withColumn("asked", F.array_distinct(F.transform(F.slice("rare", 1, take), lambda x: x["earliest"])))
        pairs = ws.write(turn.select("id", "key", F.explode("asked").alias("earlier")), f"pairs{k}")
        mine = pairs.join(unique, ["id", "key"])
        other = unique.select(F.col("id").alias("earlier"), F.col("lines").alias("others"), F.col("sizes").alias("more"))
        aligned = mine.join(other, "earlier").select("id", "key", "lines", "sizes", "others", "more")
        gone = aligned.mapInArrow(_align(block), f"id {kind.simpleString()}, key string, gone array<int>").where("size(gone) > 0")
        rounds.append(ws.write(gone.groupBy("id", "key").agg(F.collect_list("gone").alias("gone"), F.count(F.lit(1)).alias("partners")), f"gone{k}"))
        more = turn.where("size(array_distinct(transform(rare, x -> x.earliest))) > size(asked)").join(unique.select("id", "key", "lines", "sizes"), ["id", "key"])
        so_far = _together(rounds).select("id", "key", "gone")
        left = more.join(so_far, ["id", "key"], "left").select("id", "key", "rare", "asked", "lines", "sizes", "gone")
        todo = ws.write(left.mapInArrow(_open(block), f"id {kind.simpleString()}, key string, rare {shared}").where("size(rare) > 0"), f"shared{k + 1}")
        if todo.isEmpty():
            break
        take *= 2
    gone = _together(rounds)
    kept = keyed.hint("merge").join(gone, ["id", "key"]).select("id", "key", "text", "gone").mapInArrow(_delete, f"id {kind.simpleString()}, key string, kept_text string").dropDuplicates(["id", "key"])
    removed = gone.select("id", "key", "partners", F.size(F.array_distinct(F.flatten("gone"))).alias("removed")).join(kept, ["id", "key"])
    out = listed.select("id", "key", F.size("lines").alias("n_lines")).hint("merge").join(first, "key", "left").hint("merge").join(removed, ["id", "key"], "left")
    copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n_lines").cast("long").alias("n_lines"),
        F.when(copy, F.col("n_lines")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("partners", F.lit(0))).cast("long").alias("partners"),
        F.when(copy, "").otherwise(F.col("kept_text")).alias("kept_text"),
    )
