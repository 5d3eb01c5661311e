"""Substring dedup by looking up windows of words, against all earlier documents.

This is not a greedy relative Lempel-Ziv parse, which takes the longest match at each place
and goes on behind it: its factors do not overlap, so a window that begins inside one factor
and ends behind it can be missed. Here a window of ``window`` words that also stands in a
document with a smaller id is duplicate, and all words of duplicate windows go; neighbouring
windows that one earlier document holds make up a factor, and factors may overlap.
Windows are grouped in content-defined blocks: of the word grams inside each window, the one
with the smallest hash is its anchor, and neighbouring windows with one anchor form a block.
Equal windows have equal anchors, so a block can share windows only with the blocks indexed
under its anchor:

1. One pass over the texts lists each document's blocks; blocks whose anchor stands in one
   document only are no reference for any other and go.
2. Blocks alike in all their words are one entry of the index, with the smallest id. Blocks
   of larger ids are duplicate as a whole.
3. Entries that share an anchor but differ are where copies may begin or end: there, each
   window is looked up by itself.

Counts of rows stay linear in the words, whatever the number of copies of a passage: the
index keeps minima, which are summed up before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import blocks, byte_prefix, long_rows, prefix, ragged, ranges, words
from .workspace import Workspace

WINDOW, GRAM = 50, 8
_POSITION = np.uint64((1 << 26) - 1)

RUNS = "array<struct<anchor:long,context:long,lead:int,start:int,n:int>>"


def _word_sums(block):
    starts, ends, firsts = words(block)
    return prefix(ranges(byte_prefix(block.data), starts, ends)), firsts


def window_runs(block, window: int = WINDOW, gram: int = GRAM):
    """Blocks of a ``spans.Block``: (row, anchor, context, lead, start, n) arrays, and words of each row.

    start is the first of n windows, a word number in the row; lead is how far the anchor is
    from it; context hashes all words of the windows.
    """
    sums, firsts = _word_sums(block)
    n = len(sums) - 1
    starts = long_rows(block, firsts, window)
    counts = np.diff(firsts)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return (none,) * 6, counts
    at = np.arange(n - gram + 1)
    grams = ranges(sums, at, at + gram)
    best = (grams & ~_POSITION) | at.astype(np.uint64)
    width, span = window - gram + 1, 1
    while 2 * span <= width:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if span < width:
        best = np.minimum(best[: len(best) - (width - span)], best[width - span :])
    anchors = (best[starts] & _POSITION).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (np.diff(starts) != 1)]))
    n_windows = np.diff(np.concatenate([new, [len(starts)]]))
    first, anchor = starts[new], anchors[new]
    context = ranges(sums, first, first + n_windows + window - 1)
    row = np.searchsorted(firsts, first, "right") - 1
    return (row, grams[anchor].view(np.int64), context.view(np.int64), anchor - first, first - firsts[row], n_windows), counts


def _parse(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2)):
                (row, anchor, context, lead, start, n), counts = window_runs(block, window, gram)
                data = block.data.tobytes()
                sha = [hashlib.sha256(b" ".join(data[a:b].split())).hexdigest() for a, b in zip(block.bounds[:-1].tolist(), block.bounds[1:].tolist(), strict=True)]
                fields = [pa.array(anchor), pa.array(context), pa.array(lead, pa.int32()), pa.array(start, pa.int32()), pa.array(n, pa.int32())]
                offsets = pa.array(np.searchsorted(row, np.arange(block.rows + 1)), pa.int32())
                runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["anchor", "context", "lead", "start", "n"]))
                keys = [batch.column(k).slice(block.first, block.rows) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(counts, pa.int64()), pa.array(sha), runs], ["id", "text_key", "n_words", "words_sha256", "runs"])

    return run


def _windows(window: int):
    """Each window of the listed blocks: (anchor, hash, id, text_key, start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2)):
                sums, firsts = _word_sums(block)
                spans = batch.column(3).slice(block.first, block.rows)
                rows = np.repeat(np.arange(block.rows), spans.value_lengths().to_numpy(zero_copy_only=False))
                flat = spans.flatten()
                anchor, start, n = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                at = ragged(start.astype(np.int64), n.astype(np.int64))
                rows, anchor = np.repeat(rows, n), np.repeat(anchor, n)
                first = firsts[rows] + at
                found = ranges(sums, first, first + window)
                take = pa.array(rows + block.first)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(found.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(at, pa.int32())], ["anchor", "hash", "id", "text_key", "start"])

    return run


def _remove(window: int):
    """Words of the text that no listed window covers, joined by one space, and the factors that the windows make."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed, factors = [], [], []
            for text, spans in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                parts = text.as_py().encode().split()
                edge = np.zeros(len(parts) + 1, np.int64)
                made: list[dict] = []
                for x in sorted(spans, key=lambda x: x["start"]):
                    end = x["start"] + x["n"] + window - 1
                    edge[x["start"]] += 1
                    edge[end] -= 1
                    last = made[-1] if made else None
                    if last and last["first"] == x["first"] and last["start"] + last["n_words"] == x["start"] + window - 1:
                        last["n_words"] += x["n"]
                    else:
                        made.append({"start": x["start"], "n_words": end - x["start"], "first": x["first"]})
                stay = np.cumsum(edge[:-1]) == 0
                kept.append(b" ".join([w for w, s in zip(parts, stay.tolist(), strict=True) if s]).decode())
                removed.append(len(parts) - int(stay.sum()))
                factors.append(made)
            columns = [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("n_words", pa.int32()), ("first", batch.schema.field(0).type)]))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(factors, kind)], ["id", "text_key", "n_removed", "kept_text", "factors"])

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, text_key, n_words, words_sha256, n_removed, kept_text, factors.

    factors (start and n_words in words, first) are passages all of whose windows first holds, a
    document with a smaller id: the earliest with an equal block, or for single windows the
    earliest of all. They may overlap by less than a window, are as long as first stays the
    same, and cover what is removed. They and kept_text are null where nothing is removed; words_sha256 then digests the words joined by
    one space. A null text has no words. Texts of fewer than ``window`` words keep them all.
    Windows are judged on the input, against documents with strictly smaller ids, so rows
    that repeat an id are not compared with each other. Rows without an id are kept whole and
    are no reference. Other columns are ignored; no rows give no rows. text_key tells apart
    texts of rows that repeat an id.
    """
    ws = Workspace(docs.sparkSession, "substring")
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).select("id", F.xxhash64("text").alias("text_key"), "text")
    parsed = ws.write(keyed.mapInArrow(_parse(window, gram), f"id {kind}, text_key long, n_words long, words_sha256 string, runs {RUNS}"), "parsed")
    runs = parsed.where("id is not null").select("id", "text_key", F.inline("runs"))
    # What is joined on a key of its own sums is written first: so a frequent key's rows can be split.
    shared = ws.write(runs.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("anchor"), "shared")
    runs = ws.write(runs.hint("merge").join(shared, "anchor"), "runs")
    entry = ["anchor", "context", "lead", "n"]
    index = ws.write(runs.groupBy(entry).agg(F.min("id").alias("first")), "index")
    mixed = ws.write(index.groupBy("anchor").agg(F.count(F.lit(1)).alias("entries")).where("entries > 1").select("anchor"), "mixed")
    placed = ws.write(runs.hint("merge").join(index, entry), "placed")
    ws.drop("shared", "runs", "index")
    inside = placed.where(F.col("id") > F.col("first")).select("id", "text_key", "start", "n", "first")
    border = placed.where(F.col("id") == F.col("first")).hint("merge").join(mixed, "anchor")
    border = border.groupBy("id", "text_key").agg(F.collect_list(F.struct("anchor", "start", "n")).alias("spans"))
    single = keyed.hint("merge").join(border, ["id", "text_key"]).mapInArrow(_windows(window), f"anchor long, hash long, id {kind}, text_key long, start int")
    single = ws.write(single, "windows")
    earliest = single.groupBy("anchor", "hash").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("anchor", "hash", "first")
    earliest = ws.write(earliest, "earliest")
    straddling = single.hint("merge").join(earliest, ["anchor", "hash"]).where(F.col("id") > F.col("first")).select("id", "text_key", "start", F.lit(1).alias("n"), "first")
    spans = inside.unionByName(straddling).groupBy("id", "text_key").agg(F.collect_list(F.struct("start", "n", "first")).alias("spans"))
    removed = keyed.hint("merge").join(spans, ["id", "text_key"]).mapInArrow(_remove(window), f"id {kind}, text_key long, n_removed long, kept_text string, factors array<struct<start:int,n_words:int,first:{kind}>>")
    removed = removed.groupBy("id", "text_key").agg(F.first("n_removed").alias("n_removed"), F.first("kept_text").alias("kept_text"), F.first("factors").alias("factors"))
    out = parsed.drop("runs").hint("merge").join(removed, ["id", "text_key"], "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0)).cast("long"))
    return out.withColumnRenamed("id", id_col)
