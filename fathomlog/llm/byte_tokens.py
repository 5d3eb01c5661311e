"""Byte-level BPE ids of a vocabulary file, one tokenizer per worker.

The file is a JSON of the ``tokenizers`` library. Its merges are those of a rank table, so
ids come from a rank-table encoder built from the JSON, which gives the same ids several
times faster; a file of another shape is encoded by the ``tokenizers`` library itself.
"""

from __future__ import annotations

import json
from functools import lru_cache, partial

import numpy as np

#: The pre-token pattern of byte-level BPE files without one of their own (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in such files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Text to ids, strings of added tokens in a text included, as the library gives them.

    ``widths`` has the UTF-8 bytes that each id stands for; None where the file's shape leaves
    only the library itself.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
        special = {x["content"]: x["id"] for x in added}
        simple = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        simple = simple and not model.get("dropout") and not model.get("ignore_merges") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        simple = simple and not any(x.get(k) for x in added for k in ("lstrip", "rstrip", "single_word"))
        if simple:
            symbol = byte_symbols()
            ranks = {bytes(symbol[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
            merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
            made = [model["vocab"]["".join(m)] for m in merges]
            simple = all(x < y for x, y in zip(made, made[1:], strict=False)) and len(ranks) == 256 + len(merges)
        if simple:
            import tiktoken

            encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
            self.encode = partial(encoding.encode, allowed_special="all") if special else encoding.encode_ordinary
            widths = {i: len(t) for t, i in ranks.items()} | {i: len(t.encode()) for t, i in special.items()}
            self.widths = np.zeros(max(widths) + 1, np.int64)
            self.widths[list(widths)] = list(widths.values())
        else:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
            self.encode, self.widths = lambda text: whole.encode(text, add_special_tokens=False).ids, None

    def __call__(self, text: str) -> list[int]:
        return self.encode(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
