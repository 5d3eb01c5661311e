"""Plain versions of what the operators compute, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode())


def substring(docs: list[tuple[int, str | None]], window: int = 50) -> dict[int, tuple[int, int, str]]:
    first: dict[tuple, int] = {}
    parts = {d: words(t) for d, t in docs}
    for d, w in parts.items():
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, d), d)
    out = {}
    for d, w in parts.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < d:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d] = len(w), sum(gone), hashlib.sha256(kept).hexdigest()
    return out


def shingles(text: str | None, n: int = 5) -> set[tuple]:
    low = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not low:
        return set()
    return {tuple(low[k : k + n]) for k in range(len(low) - n + 1)} or {tuple(low)}


def components(ids, links) -> dict[int, int]:
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    sets = {d: shingles(t) for d, t in docs}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    common: dict[tuple[int, int], int] = defaultdict(int)
    for ds in holders.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                common[a, b] += 1
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    found = components(sets, links)
    return {d: (len(s), found[d]) for d, s in sets.items()}


def _line_runs(lines: list[str], block: int):
    """The shortest runs of consecutive lines with ``block`` characters that begin, or end, at each line."""
    for k in range(len(lines)):
        for step in (1, -1):
            total, e = 0, k
            while 0 <= e < len(lines):
                total += len(lines[e])
                if total >= block:
                    yield min(k, e), max(k, e) + 1
                    break
                e += step


def lines(docs: list[tuple[int, str | None]], block: int = 60) -> tuple[dict[int, int], dict[int, int]]:
    """Lines to delete of each first text: in any run that an earlier one holds, and by one alignment with every earlier one."""
    from fathomlog.llm.line_dedup import patience

    first: dict[str, int] = {}
    for d, t in sorted(docs):
        first.setdefault(t or "", d)
    known, seen, by_run, by_partner = set(), {}, {}, {}
    for d, t in sorted(docs):
        if first[t or ""] != d:
            continue
        own = [x.strip(" ") for x in (t or "").split("\n")]
        mine = list(_line_runs(own, block))
        by_run[d] = len({k for a, b in mine if tuple(own[a:b]) in known for k in range(a, b)})
        gone = set()
        for other in seen.values():
            for i, _, n in patience(own, other):
                if sum(map(len, own[i : i + n])) >= block:
                    gone |= set(range(i, i + n))
        by_partner[d] = len(gone)
        known |= {tuple(own[a:b]) for a, b in mine}
        seen[d] = own
    return by_run, by_partner
