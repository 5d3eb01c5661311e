"""Exact dedup with a log-structured merge index of text digests.

Each task gathers memtables of (digest, id), sorts them and flushes them as runs in which a
digest has one entry: the identifier that stays, and how many rows it stands for. The runs of
a batch are merged to one run of the first level, with a Bloom filter and the least and
largest digest of each bucket of digests; a level that has ``FAN`` runs is compacted to one run
of the next. A further batch adds runs and leaves the files of others as they are. To read the
index, entries are probed in the filters of all other runs: those that no filter claims are
final, and only the rest are merged. Rows whose digest the index holds under another
identifier are hits, and their bytes are compared with those of the text that stays before
they count as copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, partitions

#: A digest with more rows than this, and than a thousandth of all rows, goes to several tasks.
HOT_ROWS = 5_000
#: Rows of a memtable; batches that a table is taken in; runs of a level before they are compacted.
MEMTABLE, BATCHES, FAN = 200_000, 2, 4
#: Rows of a bucket of the first batch, about, and buckets at most; bits of a filter for each entry, and hashes.
BUCKET_ROWS, BUCKETS, BITS, HASHES = 1 << 17, 1 << 16, 10, 5


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _memtables(keep: str):
    """Sorted (digest, id, n) of each memtable, one entry for each digest, from (digest, id)."""
    best = "max" if keep == "max" else "min"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def flush():
            table = pa.Table.from_batches(held).group_by("digest").aggregate([("id", best), ("id", "count")]).sort_by("digest")
            return table.select(["digest", f"id_{best}", "id_count"]).rename_columns(["digest", "id", "n"]).to_batches(max_chunksize=10_000)

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= MEMTABLE:
                yield from flush()
                held, rows = [], 0
        if rows:
            yield from flush()

    return run


def _places(h: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Places of 64-bit hashes in a filter of ``size`` bits, a power of two."""
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    for k in range(HASHES):
        yield ((a + np.uint64(k) * b) & np.uint64(size - 1)).astype(np.int64)


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, low, high, bits) from (bucket, digest, h) sorted by bucket and digest."""
    bucket, low, high, hashes = None, None, None, []

    def told():
        h = np.concatenate(hashes)
        size = 1 << max(6, int(BITS * len(h) - 1).bit_length())
        bits = np.zeros(size, bool)
        for at in _places(h, size):
            bits[at] = True
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([low], pa.binary()), pa.array([high], pa.binary()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["bucket", "low", "high", "bits"])

    for batch in batches:
        number = batch.column(0).to_numpy(zero_copy_only=False)
        h = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)] if len(number) else []
        for s, e in zip(cuts, cuts[1:], strict=False):
            if bucket is not None and number[s] != bucket:
                yield told()
                hashes.clear()
            if not hashes:
                bucket, low = int(number[s]), batch.column(1)[s].as_py()
            hashes.append(h[s:e])
            high = batch.column(1)[e - 1].as_py()
    if hashes:
        yield told()


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries (run, digest, id, n) and whether another run may hold their digest.

    From (bucket, kind, run, digest, h, id, n, high, bits) sorted by bucket and kind: filters,
    whose digest is the least, come before the entries of their bucket.
    """
    bucket, filters = None, []
    for batch in batches:
        columns = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        number, kind, run = (columns[c].to_numpy(zero_copy_only=False) for c in ("bucket", "kind", "run"))
        claimed = np.zeros(batch.num_rows, bool)
        cuts = [0, *(np.flatnonzero(np.diff(number) | np.diff(kind)) + 1).tolist(), len(number)] if len(number) else []
        for s, e in zip(cuts, cuts[1:], strict=False):
            if number[s] != bucket:
                bucket, filters = number[s], []
            if kind[s] == 0:
                for k in range(s, e):
                    bits = np.unpackbits(np.frombuffer(columns["bits"][k].as_py(), np.uint8), bitorder="little").view(bool)
                    filters.append((run[k], columns["digest"][k].as_py(), columns["high"][k].as_py(), bits))
                continue
            h = columns["h"].slice(s, e - s).to_numpy(zero_copy_only=False).view(np.uint64)
            digests = columns["digest"].slice(s, e - s).to_pylist()
            for other, low, high, bits in filters:
                found = run[s:e] != other
                for at in _places(h, len(bits)):
                    found &= bits[at]
                for k in np.flatnonzero(found & ~claimed[s:e]).tolist():
                    claimed[s + k] = low <= digests[k] <= high
        entries = pa.array(kind == 1)
        out = [columns[c].filter(entries) for c in ("run", "digest", "id", "n")]
        yield pa.RecordBatch.from_arrays([*out, pa.array(claimed).filter(entries)], ["run", "digest", "id", "n", "claimed"])


@dataclass(frozen=True)
class Run:
    """Entries (bucket, digest, h, id, n) and filters, as they are written."""

    number: int
    level: int
    entries: DataFrame
    filters: DataFrame


class DigestIndex:
    """Runs by level. ``keep`` says whether the largest or the smallest id of a digest stays."""

    def __init__(self, ws: Workspace, keep: str = "max", fan: int = FAN):
        self.ws, self.keep, self.fan = ws, keep, fan
        self.runs: list[Run] = []
        self.made, self.buckets = 0, 0

    def _best(self) -> Column:
        return (F.max if self.keep == "max" else F.min)("id").alias("id")

    def _kind(self, like: DataFrame) -> str:
        return like.schema["id"].dataType.simpleString()

    def add(self, rows: DataFrame) -> None:
        """A batch of (digest, id) without nulls: memtables, merged to a run of the first level."""
        flushed = self.ws.write(rows.select("digest", "id").mapInArrow(_memtables(self.keep), f"digest binary, id {self._kind(rows)}, n long"), f"memtables{self.made}")
        if not self.buckets:
            self.buckets = min(BUCKETS, 1 << max(0, flushed.count() // BUCKET_ROWS).bit_length())
        h = F.xxhash64("digest")
        self._write(flushed.select(F.pmod(h, F.lit(self.buckets)).alias("bucket"), "digest", h.alias("h"), "id", "n"), 0)
        self.ws.drop(f"memtables{self.made - 1}")
        level = 0
        while len(full := [r for r in self.runs if r.level == level]) >= self.fan:
            whole = full[0].entries
            for r in full[1:]:
                whole = whole.unionByName(r.entries)
            self._write(whole, level + 1)
            self.runs = [r for r in self.runs if r not in full]
            self.ws.drop(*(f"{what}{r.number}" for r in full for what in ("run", "filter")))
            level += 1

    def _write(self, rows: DataFrame, level: int) -> None:
        merged = rows.groupBy("bucket", "digest", "h").agg(self._best(), F.sum("n").alias("n"))
        dealt = merged.repartition(partitions(self.ws.spark), "bucket").sortWithinPartitions("bucket", "digest")
        entries = self.ws.write(dealt, f"run{self.made}")
        keys = entries.select("bucket", "digest", "h").repartition(partitions(self.ws.spark), "bucket").sortWithinPartitions("bucket", "digest")
        filters = self.ws.write(keys.mapInArrow(_filters, "bucket long, low binary, high binary, bits binary"), f"filter{self.made}")
        self.runs.append(Run(self.made, level, entries, filters))
        self.made += 1

    def probe(self, rows: DataFrame, run: Column) -> DataFrame:
        """``rows`` (digest, id, n) with ``claimed``: whether a run other than ``run`` may hold the digest."""
        h = F.xxhash64("digest")
        none = F.lit(None).cast("binary")
        asked = rows.select(F.pmod(h, F.lit(max(self.buckets, 1))).alias("bucket"), F.lit(1).alias("kind"), run.cast("int").alias("run"), "digest", h.alias("h"), "id", "n", none.alias("high"), none.alias("bits"))
        for r in self.runs:
            kind = self._kind(rows)
            asked = asked.unionByName(r.filters.select("bucket", F.lit(0).alias("kind"), F.lit(r.number).alias("run"), F.col("low").alias("digest"), F.lit(0).cast("long").alias("h"), F.lit(None).cast(kind).alias("id"), F.lit(0).cast("long").alias("n"), "high", "bits"))
        dealt = asked.repartition(partitions(self.ws.spark), "bucket").sortWithinPartitions("bucket", "kind")
        return dealt.mapInArrow(_probe, f"run int, digest binary, id {self._kind(rows)}, n long, claimed boolean")

    def entries(self) -> DataFrame:
        """(digest, keep_id, group_size) of all that was added."""
        every = None
        for r in self.runs:
            one = r.entries.select(F.lit(r.number).alias("run"), "digest", "id", "n")
            every = one if every is None else every.unionByName(one)
        if len(self.runs) == 1:
            return every.select("digest", F.col("id").alias("keep_id"), F.col("n").alias("group_size"))
        probed = self.ws.write(self.probe(every, F.col("run")), f"probed{self.made}")
        merged = probed.where("claimed").groupBy("digest").agg(self._best(), F.sum("n").alias("n"))
        return probed.where("not claimed").select("digest", "id", "n").unionByName(merged).toDF("digest", "keep_id", "group_size")

    def lookup(self, rows: DataFrame) -> DataFrame:
        """Entries of the index for the digests of a further batch (digest, id), which is not added."""
        asked = self.probe(rows.select("digest", "id", F.lit(0).cast("long").alias("n")), F.lit(-1)).where("claimed").select("digest").distinct()
        return self.entries().join(asked, "digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", digest=sha256, batches: int = BATCHES) -> DataFrame:
    """One row per row of ``docs``: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text counts as empty, and empty texts are
    copies of each other. ``keep`` says whether the largest or the smallest id of a group
    stays. Rows that repeat both id and text share one verdict and count each in group_size.
    A row without an id is no copy: kept, keep_id null, group_size 1. Other columns are
    ignored; no rows give no rows. ``digest`` may be any function of a text column: texts
    that merely share a digest are told apart by the byte comparison. The index takes the
    table in ``batches`` batches of its partitions.
    """
    ws = Workspace(docs.sparkSession, "lsm")
    source = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).withColumn("digest", digest(F.col("text")))
    runs = ws.write(source.select("digest", "id", F.pmod(F.spark_partition_id(), F.lit(batches)).alias("batch")), "rows")
    indexed = runs.where("id is not null").select("digest", "id")
    index = DigestIndex(ws, keep)
    for k in range(batches):
        index.add(runs.where((F.col("batch") == k) & F.col("id").isNotNull()))
    level = ws.write(index.entries(), "level")
    # An entry of a frequent digest is repeated for a few sub-keys among which its rows are
    # dealt; at most a thousand digests have over a thousandth of the rows.
    hot_rows = max(HOT_ROWS, runs.count() // 1000)
    shares = F.ceil(F.col("group_size") / hot_rows).cast("int")
    hot = level.where(F.col("group_size") > hot_rows).select("digest", shares.alias("shares"))
    salt = F.when(F.col("shares").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("shares"))).cast("int")
    salted = indexed.distinct().join(F.broadcast(hot), "digest", "left").withColumn("salt", salt)
    entries = level.where("group_size > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), shares - 1)))
    members = ws.write(salted.join(entries, ["digest", "salt"]).select("id", "digest", "salt", "keep_id", "group_size"), "members")
    # Only texts of members are compared: hits with the text that stays.
    texts = ws.write(source.hint("merge").join(members, ["id", "digest"]), "texts")
    stays = texts.where(F.col("id") == F.col("keep_id")).select("digest", "group_size", F.col("text").alias("kept_text")).dropDuplicates(["digest"])
    stays = stays.withColumn("salt", F.explode(F.sequence(F.lit(0), shares - 1))).drop("group_size")
    checked = texts.hint("merge").join(stays, ["digest", "salt"]).withColumn("same", F.col("text") == F.col("kept_text"))
    verdicts = ws.write(checked.select("id", "digest", "keep_id", "group_size", "same", F.when(~F.col("same"), F.col("text")).alias("text")), "verdicts")
    ws.drop("texts")
    if verdicts.where(~F.col("same")).isEmpty():
        found = verdicts.select("id", "digest", "keep_id", "group_size", F.lit(None).cast("string").alias("text")).distinct()
    else:  # digests in common without equal bytes: such rows are grouped by their whole texts
        best = (F.max if keep == "max" else F.min)("id")
        groups = verdicts.groupBy(F.col("digest").alias("d"), F.col("text").alias("t")).agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        same = verdicts.drop("keep_id", "group_size").join(groups, (F.col("digest") == F.col("d")) & F.col("text").eqNullSafe(F.col("t")))
        found = same.select("id", "digest", "keep_id", "group_size", "text").distinct()
    out = source if digest is not sha256 else runs.drop("batch").withColumn("text", F.lit(None).cast("string"))
    out = out.join(found.select("id", "digest", "keep_id", "group_size", F.col("text").alias("other")), ["id", "digest"], "left")
    out = out.where(F.col("other").isNull() | F.col("text").isNull() | (F.col("other") == F.col("text")))
    keep_id = F.coalesce("keep_id", "id")
    sha = F.col("digest") if digest is sha256 else sha256(F.col("text"))
    return out.select(F.col("id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.coalesce(keep_id == F.col("id"), F.lit(True)).alias("kept"), F.lower(F.hex(sha)).alias("text_sha256"))


def keep_unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = exact_dedup(docs, id_col, text_col, keep).where("kept").select(id_col).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept[id_col]), "left_semi")
