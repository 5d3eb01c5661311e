"""URL filters: the longest matching rule of a trie decides.

The trie goes over host labels from the last to the first, then over the segments of the
path. A rule fits its host and all its subdomains, and any path that starts with the rule's
(its last segment may go on). Of the rules that fit, the one with the most host labels wins,
then the one with the longest path; of equal rules, ``block`` wins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomlog.shipping import ship

#: Rules of one broadcast trie (a few hundred bytes each); more rules make more tries.
TRIE_RULES = 200_000
#: The method's verdict where no rule fits: a filter lets pass what it does not list.
NO_RULE = "allow"


@dataclass
class Node:
    """Children by label or segment; open ends by the rest of a path within a segment."""

    below: dict = field(default_factory=dict)
    paths: Node | None = None
    ends: dict = field(default_factory=dict)


class UrlTrie:
    """Rules (host, path, verdict); hosts and verdicts in lower case, paths as they are."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root = Node()
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.lower().split(".")):
                node = node.below.setdefault(label, Node())
            *whole, rest = path.split("/")
            node.paths = node.paths or Node()
            node = node.paths
            for segment in whole:
                node = node.below.setdefault(segment, Node())
            if node.ends.get(rest, ("", ""))[1] != "block":
                node.ends[rest] = (host.lower() + path, verdict)

    @staticmethod
    def _longest(node: Node, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            if node.ends:
                fits = [end for end in node.ends if segment.startswith(end)]
                if fits:
                    best = node.ends[max(fits, key=len)]
            node = node.below.get(segment)
            if node is None:
                break
        return best

    def match(self, host: str, path: str) -> tuple[int, int, str, str] | None:
        """(labels, path length, rule, verdict) of the rule that wins, or none."""
        node, best, segments, depth = self.root, None, path.split("/"), 0
        for label in reversed(host.split(".")):
            node = node.below.get(label)
            if node is None:
                break
            depth += 1
            if node.paths is not None and (found := self._longest(node.paths, segments)):
                best = depth, len(found[0]), *found
        return best


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _matcher(trie):
    @F.pandas_udf("labels int, length int, blocks int, rule string, verdict string")
    def match(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in batches:
            rows = [trie.value.match(h, p) or (0, 0, None, None) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame([(a, b, int(d == "block"), c, d) for a, b, c, d in rows], columns=["labels", "length", "blocks", "rule", "verdict"])

    return match


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], url_col: str = "url") -> DataFrame:
    """Adds host, path, rule and verdict to ``pages``; columns of these names are replaced.

    rule is null and the verdict ``allow`` where no rule fits: so for null urls, urls without
    ``://`` and empty hosts. Every row stays, repeated ones too; there is no shuffle. Each
    broadcast trie holds at most ``TRIE_RULES`` rules; longer lists are split over several
    tries, and the longest match over all of them counts.
    """
    spark = pages.sparkSession
    ship(spark)
    listed = sorted(set(rules))
    host, path = url_parts(F.col(url_col))
    out = pages.withColumns({"host": host, "path": path})
    found = []
    for at in range(0, len(listed), TRIE_RULES):
        found.append(_matcher(spark.sparkContext.broadcast(UrlTrie(listed[at : at + TRIE_RULES])))("host", "path"))
    if not found:
        return out.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(NO_RULE)})
    best = found[0] if len(found) == 1 else F.greatest(*found)
    out = out.withColumn("__match", best)
    return out.withColumns({"rule": F.col("__match.rule"), "verdict": F.coalesce("__match.verdict", F.lit(NO_RULE))}).drop("__match")
