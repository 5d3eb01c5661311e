"""Edit-aware token counts: a segment tree of pre-tokens for each document.

Leaves are the pieces between which a byte-level BPE always cuts: white space with the word
after it. They stand in chunks, and over the chunks a tree holds sums of characters and
tokens. A text is encoded once; its tokens are counted to leaves by their bytes. An edit finds
its leaves by character position in the tree, encodes them with one leaf of context on either
side, puts the new leaves into their chunk, and updates the sums above. Nothing else of the
document is encoded or split again, whatever the number of leaves that come or go.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_tokens import Encoder, encoder
from .spans import as_strings
from .workspace import small_batches

_LEAVES = re.compile(r"\s*\S+|\s+").finditer
#: What Python takes as white space but the tokenizer does not: such texts are one leaf.
_ODD = re.compile("[\x1c-\x1f]").search
#: Leaves of a chunk; one of more than twice as many is cut up.
CHUNK = 32


def leaf_ends(text: str) -> np.ndarray:
    """Where the pieces that can be encoded one by one end, in characters."""
    return np.array([len(text)] if _ODD(text) else [m.end() for m in _LEAVES(text)], np.int64)


def leaf_counts(text: str, encode: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tokens of each leaf, from one call of the encoder."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = leaf_ends(text)
    chars = np.diff(ends, prepend=0)
    if encode.widths is None:
        return chars, np.array([len(encode(text[e - n : e])) for e, n in zip(ends.tolist(), chars.tolist(), strict=True)], np.int64)
    stops = ends
    if not text.isascii():
        raw = np.frombuffer(text.encode(), np.uint8)
        stops = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))[ends]
    at = np.cumsum(encode.widths[encode(text)])
    return chars, np.diff(np.searchsorted(at, stops, "right"), prepend=0)


class TokenTree:
    """Chunks of leaves, and sums of characters and tokens over them as heaps of a power of two."""

    def __init__(self, text: str, encode: Encoder):
        self.encode = encode
        self.encoded = 0
        self._start(text)

    def _start(self, text: str) -> None:
        self.text = text
        self.chars, self.tokens = leaf_counts(text, self.encode)
        at = np.arange(0, len(self.chars), CHUNK)
        sums = [np.add.reduceat(x, at) if len(at) else np.zeros(0, np.int64) for x in (self.chars, self.tokens)]
        begins = np.cumsum(sums[0]) - sums[0]
        # A chunk: characters, tokens and text of its leaves; where it stands in the text given, until it is read.
        self.chunks: list = list(zip(at.tolist(), begins.tolist(), strict=True))
        self._sum_up(*sums)

    def _sum_up(self, chars, tokens) -> None:
        self.half = 1 << max(len(chars) - 1, 0).bit_length()
        self.sums = []
        for values in (chars, tokens):
            heap = np.zeros(2 * self.half, np.int64)
            heap[self.half : self.half + len(values)] = values
            level = self.half
            while level > 1:
                heap[level // 2 : level] = heap[level : 2 * level : 2] + heap[level + 1 : 2 * level : 2]
                level //= 2
            self.sums.append(heap)

    @property
    def total(self) -> int:
        return int(self.sums[1][1])

    @property
    def length(self) -> int:
        return int(self.sums[0][1])

    def chunk(self, k: int) -> tuple[list[int], list[int], str]:
        found = self.chunks[k]
        if len(found) == 2:
            leaf, begin = found
            chars = self.chars[leaf : leaf + CHUNK].tolist()
            found = self.chunks[k] = chars, self.tokens[leaf : leaf + CHUNK].tolist(), self.text[begin : begin + sum(chars)]
        return found

    def leaves(self) -> list[str]:
        out = []
        for k in range(len(self.chunks)):
            chars, _, text = self.chunk(k)
            at = 0
            for n in chars:
                out.append(text[at : at + n])
                at += n
        return out

    def _find(self, position: int) -> tuple[int, int, int]:
        """(chunk, leaf in it, where the chunk starts) of a character; of the last one at the end."""
        position = min(position, self.length - 1)
        node, start, chars = 1, 0, self.sums[0]
        while node < self.half:
            node *= 2
            if position - start >= chars[node]:
                start += int(chars[node])
                node += 1
        k, leaf, at = node - self.half, 0, start
        for n in self.chunk(k)[0]:
            at += n
            if at > position:
                break
            leaf += 1
        return k, leaf, start

    def _set(self, k: int, chars: list[int], tokens: list[int], text: str) -> None:
        self.chunks[k] = chars, tokens, text
        for heap, value in zip(self.sums, (len(text), sum(tokens)), strict=True):
            node = k + self.half
            heap[node] = value
            while node > 1:
                node //= 2
                heap[node] = heap[2 * node] + heap[2 * node + 1]

    def edit(self, start: int, end: int, new: str) -> None:
        """Put ``new`` for the characters [start, end), cut to the text's bounds."""
        start = min(max(start, 0), self.length)
        end = min(max(end, start), self.length)
        if not self.length:
            self._start(new)
            self.encoded += len(self.chars)
            return
        k1, i, begin = self._find(max(start - 1, 0))
        k2, j, _ = self._find(end)
        if i:  # one leaf of context before
            i -= 1
        elif begin:
            k1, i, begin = self._find(begin - 1)
        one, two = self.chunk(k1), self.chunk(k2)
        if j + 1 < len(two[0]):  # and one behind
            j += 1
        else:
            behind = int(self.sums[0][k2 + self.half])
            node = k2 + self.half
            while node > 1:  # characters up to the chunk's end
                if node & 1:
                    behind += int(self.sums[0][node - 1])
                node //= 2
            if behind < self.length:
                k2, j, _ = self._find(behind)
                two = self.chunk(k2)
        head, tail = sum(one[0][:i]), sum(two[0][: j + 1])
        if k1 == k2:
            old = one[2][head:tail]
        else:
            old = one[2][head:] + "".join(self.chunk(k)[2] for k in range(k1 + 1, k2)) + two[2][:tail]
        before = begin + head
        fresh = old[: start - before] + new + old[end - before :]
        chars, tokens = leaf_counts(fresh, self.encode)
        self.encoded += len(chars)
        chars, tokens = one[0][:i] + chars.tolist() + two[0][j + 1 :], one[1][:i] + tokens.tolist() + two[1][j + 1 :]
        text = one[2][:head] + fresh + two[2][tail:]
        if len(chars) <= 2 * CHUNK and k2 - k1 <= CHUNK:
            for k in range(k1 + 1, k2 + 1):
                self._set(k, [], [], "")
            self._set(k1, chars, tokens, text)
            return
        # Cut up the chunk; the other chunks keep their leaves, only the tree above is made anew.
        parts, at = [], 0
        for k in range(0, len(chars), CHUNK):
            n = sum(chars[k : k + CHUNK])
            parts.append((chars[k : k + CHUNK], tokens[k : k + CHUNK], text[at : at + n]))
            at += n
        sums = []
        for heap, values in zip(self.sums, ([len(p[2]) for p in parts], [sum(p[1]) for p in parts]), strict=True):
            known = heap[self.half : self.half + len(self.chunks)]
            sums.append(np.concatenate([known[:k1], values, known[k2 + 1 :]]).astype(np.int64))
        self.chunks[k1 : k2 + 1] = parts
        self._sum_up(*sums)


def count_tokens(docs: DataFrame, edits: DataFrame | None, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, n_tokens_edited, n_leaves, n_encoded of every row of ``docs``.

    ``edits`` holds (id_col, edits: array of struct<at, until, new>), applied in order to the
    text as the edits before left it; positions are characters and are cut to the text. It
    may be None, or lack documents: their counts do not change. n_encoded counts the leaves
    encoded for edits. A null text is empty and has no tokens. Rows that repeat an id get the
    same edits; if ``edits`` repeats an id, one of its rows counts. No rows give no rows.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    if edits is None:
        rows = rows.withColumn("edits", F.lit(None).cast("array<struct<at:long,until:long,new:string>>"))
    else:
        wanted = edits.select(edits[id_col].alias("id"), "edits").dropDuplicates(["id"])
        rows = rows.hint("merge").join(wanted, "id", "left")
    return _count(rows, vocabulary, kind).withColumnRenamed("id", id_col)


def _count(rows: DataFrame, vocabulary: str, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            out = []
            for text, edits in zip(as_strings(batch.column(1)), batch.column(2), strict=True):
                tree = TokenTree(text.as_py(), encode)
                total, n = tree.total, len(tree.chars)
                for e in edits.as_py() or []:
                    if e is not None:
                        tree.edit(e["at"] or 0, e["until"] or 0, e["new"] or "")
                out.append((total, tree.total, n, tree.encoded))
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["id", "n_tokens", "n_tokens_edited", "n_leaves", "n_encoded"])

    return rows.select("id", "text", "edits").mapInArrow(run, f"id {kind}, n_tokens long, n_tokens_edited long, n_leaves long, n_encoded long")


def count_with_edits(docs: DataFrame, edits: list, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Like ``count_tokens``, with edits computed from each row: columns (at, until, new). No shuffle."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    listed = F.array(*(F.struct(a.cast("long").alias("at"), u.cast("long").alias("until"), n.cast("string").alias("new")) for a, u, n in edits))
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), listed.alias("edits"))
    return _count(rows, vocabulary, kind).withColumnRenamed("id", id_col)
