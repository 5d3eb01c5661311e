"""SentencePiece encoding and decoding (merge-type models), exact, by backtracking.

A merge-type segmentation is correct exactly when every two neighbouring pieces are what
merging their joint text gives. So the encoder takes the longest vocabulary match at each
position (one Aho-Corasick pass), accepts it if it is compatible with the piece before it,
tries the shorter prefixes otherwise, and steps back when none is left; a bitfield keeps
positions from which no way leads on, so the work stays linear in the text.

Merges never cross the start of a run of spaces, so a text is coded by such chunks, and
each worker remembers the chunks it has met.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .spans import as_strings
from .workspace import small_batches

SPACE = "▁"
#: Entries of one generation of what a worker remembers; it keeps two.
MEMO = 250_000


class Memo(dict):
    """Remembers ``make(key)`` of about ``MEMO`` to twice as many keys used last."""

    def __init__(self, make):
        super().__init__()
        self.make = make
        self.old: dict = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > 64:
                return value
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class PieceCodec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bos, self.eos = model.bos_id(), model.eos_id()
        names = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) for i in range(size)]
        self.byte_id = [0] * 256
        byte = {i: int(names[i][3:5], 16) for i in range(size) if model.is_byte(i)}
        for i, b in byte.items():
            self.byte_id[b] = i
        normal = [i for i in range(size) if not special[i] and i not in byte]
        self.id = {names[i]: i for i in normal}
        self.text = {i: names[i] for i in normal}
        self.byte = byte
        self.skip = {i for i in range(size) if special[i]}
        self.score = {names[i]: model.get_score(i) for i in normal}
        self.chars = {c for c in self.id if len(c) == 1}
        if loose := {c for p in self.id for c in p} - self.chars:
            raise ValueError(f"pieces hold characters that are no pieces: {sorted(loose)[:5]}")
        if any(SPACE in p.lstrip(SPACE) for p in self.id) or "\n" in self.chars:
            raise ValueError("pieces reach over the start of a run of spaces, or over lines")
        reachable = {p for p in self.id if len(p) == 1 or self.merge(p) == [p]}
        self.automaton = ahocorasick.Automaton()
        for p in reachable:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in reachable), None) for p in reachable}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.memo = Memo(self.lookup)
        self.chunk = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+").findall

    def merge(self, text: str) -> list[str]:
        """Merging from single characters: highest score first, leftmost of equals."""
        parts = list(text)
        score = self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the joint text again gives just these two pieces."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(left + right) == [left, right]
        return known

    def backtrack(self, text: str) -> list[str]:
        """Pieces of a text whose characters are all in the vocabulary."""
        n = len(text)
        longest: list[str | None] = [None] * (n + 1)
        for end, piece in self.automaton.iter(text):
            start = end + 1 - len(piece)
            if longest[start] is None or len(longest[start]) < len(piece):
                longest[start] = piece
        failed = bytearray(n // 8 + 1)
        out: list[str] = []
        at, piece = 0, longest[0]
        while at < n:
            end = at + len(piece)
            if not failed[end >> 3] >> (end & 7) & 1 and (not out or self.compatible(out[-1], piece)):
                out.append(piece)
                at, piece = end, longest[end]
                continue
            piece = self.shorter[piece]
            while piece is None:
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= len(piece)
                piece = self.shorter[piece]
        return out

    def ids_of(self, chunk: str) -> list[int]:
        """Ids of a chunk; characters outside the vocabulary become the pieces of their bytes."""
        if self.chars.issuperset(chunk):
            return [self.id[p] for p in self.backtrack(chunk)]
        out: list[int] = []
        for known, run in groupby(chunk, self.chars.__contains__):
            part = "".join(run)
            out += [self.id[p] for p in self.backtrack(part)] if known else [self.byte_id[b] for b in part.encode()]
        return out

    def lookup(self, chunk: str) -> bytes | tuple[bytes, str]:
        """Ids as little-endian bytes; with their decoded text where that is not the chunk's."""
        ids = self.ids_of(chunk)
        raw = array("I", ids).tobytes()
        plain = self._plain(ids)
        return raw if plain == chunk.replace(SPACE, " ") else (raw, plain)

    def _plain(self, ids) -> str:
        """Texts of pieces with spaces in place; runs of byte pieces as UTF-8."""
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            if i in self.byte:
                raw.append(self.byte[i])
                continue
            if raw:
                out.append(_utf8(raw))
                raw.clear()
            if i not in self.skip:
                out.append(self.text[i].replace(SPACE, " "))
        if raw:
            out.append(_utf8(raw))
        return "".join(out)

    def encode(self, text: str) -> list[int]:
        """All ids, with begin and end."""
        ids = [self.bos]
        if text:
            for chunk in self.chunk(SPACE + text.replace(" ", SPACE)):
                ids += self.ids_of(chunk)
        return [*ids, self.eos]

    def decode(self, ids) -> str:
        """Text of any ids; the space that encoding puts before a text goes."""
        return self._plain(ids).removeprefix(" ")

    def round_trip(self, text: str) -> tuple[bytes, str]:
        """Ids with begin and end as bytes, and their decoded text, by remembered chunks."""
        begin, end = self.bos.to_bytes(4, "little"), self.eos.to_bytes(4, "little")
        if not text:
            return begin + end, ""
        chunks = self.chunk(SPACE + text.replace(" ", SPACE))
        found = list(map(self.memo.__getitem__, chunks))
        if SPACE in text or tuple in set(map(type, found)):
            plain = "".join([x[1] if type(x) is tuple else c.replace(SPACE, " ") for x, c in zip(found, chunks, strict=True)])
            found = [x[0] if type(x) is tuple else x for x in found]
        else:  # each chunk's ids decode to the chunk
            plain = " " + text
        return b"".join([begin, *found, end]), plain[1:]


def _utf8(raw: bytearray) -> str:
    """Each byte that starts no whole character becomes one replacement character."""
    out, at, raw = [], 0, bytes(raw)
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            n = 1
        at += n
    return "".join(out)


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``id_col``, ``ids`` (little-endian unsigned 32-bit, begin and end included) and ``decoded``.

    One row per input row, repeated rows included. A null text is empty; an empty text has
    the begin and end ids alone and decodes to an empty text. Other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model_path)
        for batch in batches:
            texts = as_strings(batch.column(1))
            at, size = 0, 0
            ids, plain = [], []
            for k, text in enumerate(texts):
                a, b = coder.round_trip(text.as_py())
                ids.append(a)
                plain.append(b)
                size += len(a)
                if size > 16 << 20 or k + 1 == len(texts):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, k + 1 - at), pa.array(ids, pa.binary()), pa.array(plain, pa.string())], ["id", "ids", "decoded"])
                    at, size = k + 1, 0
                    ids, plain = [], []

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, ids binary, decoded string")
    return out.withColumnRenamed("id", id_col)
