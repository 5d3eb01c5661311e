"""Near dedup of documents: a chosen-path set similarity join on word shingles.

Every document branches by minwise tokens: a node is a path of (hash function, smallest
token) choices. Two similar documents share such a token with a probability that is their
similarity, so shared paths survive while dissimilar documents part. At the root every
document follows ``ROOT`` functions, so many independent trees; below, ``BRANCH`` functions
that the path picks. Small nodes are compared exhaustively; large ones branch on, unless few
comparisons are left in them.

Tokens for all paths are precomputed: a signature of ``FUNCTIONS`` minwise tokens for each
document, whose agreement also tells clearly dissimilar pairs apart before whole sets are
compared. Only classes of documents with equal sets take part, each by one member. Each node
first proposes a spanning forest of its likeliest pairs, which is confirmed. Then the nodes
whose members still lie in several components get the whole sets of those members that have a
possible partner, compare them where they stand, and tell a forest of the links found. So
neither copies nor pairs that fail ever become rows, and no link that could join two
components is left out.

A pair at similarity s is missed by one tree with the probability that its chosen paths die
out, at most 1 - s + s * q with q = (1 - s + s * q) ** 2: a third at s = 0.75, and 2e-6 for the
twelve trees together; where no node is larger than ``Sizes.small``, (1 - s) ** 12 = 6e-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .spans import blocks, byte_prefix, mix, owner, prefix, ragged, ranges, words
from .workspace import Workspace, partitions

SHINGLE = 5
#: A link: LINK[0] * intersection >= LINK[1] * union.
LINK = (100, 75)
ROOT, BRANCH, FUNCTIONS = 12, 2, 360


@dataclass(frozen=True)
class Sizes:
    """Where nodes are split. Rows count 1, and 1 more for every ``WEIGHT`` shingles.

    forest: rows of a node that first links by a spanning forest (a larger one by a star);
    small: of one that is compared exhaustively; share: of a share of a larger one; queries: of
    a block of queries; depth: levels of branching below the root.
    """

    forest: int = 64
    small: int = 2048
    share: int = 2048
    queries: int = 256
    depth: int = 10


SIZES, WEIGHT = Sizes(), 1024
#: Agreeing functions, of the first FIRST and of all, from which on a pair is compared by its
#: sets: over five standard deviations below what a pair at the threshold has.
FIRST, AGREE_FIRST, AGREE = 72, 34, 227
#: Pairs verified against one copy of a document's set.
PAIRS = 256
#: Bytes of a signature: one of each function, four of each of the root's.
WIDTH = FUNCTIONS + 4 * ROOT

_SEEDS = mix(np.arange(1, FUNCTIONS + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))
_XOR = (_SEEDS >> np.uint64(32)).astype(np.uint32)
_MUL = _SEEDS.astype(np.uint32) | np.uint32(1)


def shingle_sets(block, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a block's rows, sorted in each row, and the rows' bounds.

    A-Z count as a-z. A row of fewer than ``n`` words has its whole sequence as one shingle.
    """
    starts, ends, firsts = words(block)
    sums = prefix(ranges(byte_prefix(block.data, fold=True), starts, ends))
    counts = np.diff(firsts)
    own = owner(firsts)
    at = np.arange(len(starts))
    last = firsts[1:][own]
    ok = (at + n <= last) | ((at == firsts[:-1][own]) & (counts[own] < n))
    at, row = at[ok], own[ok]
    value = ranges(sums, at, np.minimum(at + n, last[ok]))
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(block.rows + 1))


def signatures(value: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minwise tokens under the root's functions (whole), and one byte of each under all, then the root's again."""
    low = (value >> np.uint64(32)).astype(np.uint32)
    root = np.empty((len(bounds) - 1, ROOT), np.int64)
    sig = np.empty((len(bounds) - 1, WIDTH), np.uint8)
    for k in range(FUNCTIONS):
        token = np.minimum.reduceat((low ^ _XOR[k]) * _MUL[k], bounds[:-1])
        if k < ROOT:
            root[:, k] = token
        # A product's order lies in its high bits; its low byte is spread evenly.
        sig[:, k] = ((token * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
    sig[:, FUNCTIONS:] = root.astype("<u4").view(np.uint8)
    return root, sig


def _sketch(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                value, bounds = shingle_sets(block, n)
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                digest = np.zeros((block.rows, 2), np.uint64)
                sig, root = [None] * block.rows, [None] * block.rows
                if len(full):
                    inner = np.append(bounds[:-1][full], bounds[-1])
                    digest[full, 0] = np.add.reduceat(value, inner[:-1])
                    digest[full, 1] = np.add.reduceat(mix(value + np.uint64(0x632BE59BD9B4E019)), inner[:-1])
                    tokens, signs = signatures(value, inner)
                    for k, r in enumerate(full.tolist()):
                        root[r], sig[r] = tokens[k], signs[k].tobytes()
                keys = [batch.column(k).slice(block.first, block.rows) for k in (0, 2)]
                columns = [*keys, pa.array(sizes.astype(np.int64)), pa.array(digest[:, 0].view(np.int64)), pa.array(digest[:, 1].view(np.int64))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(root, pa.list_(pa.int64())), pa.array(sig, pa.binary())], ["id", "key", "n", "d1", "d2", "root", "sig"])

    return run


def _sets(n: int):
    """(row, set) from (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                value, bounds = shingle_sets(block, n)
                raw = [value[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.rows), pa.array(raw, pa.binary())], ["row", "set"])

    return run


def _signs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, WIDTH)


def _branch(depth: int):
    """Children of nodes: (path, level, row, w) one level down, by functions that the path picks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            sig = _signs(batch.column(2))
            out = np.empty((len(path), BRANCH), np.uint64)
            first = (mix(path) % np.uint64(FUNCTIONS // BRANCH)).astype(np.int64) * BRANCH
            for k in range(BRANCH):
                token = sig[np.arange(len(path)), first + k].astype(np.uint64)
                out[:, k] = mix(path * np.uint64(3) + token + np.uint64((k << 8) + (depth << 16)))
            rows, w = (np.repeat(batch.column(k).to_numpy(zero_copy_only=False), BRANCH) for k in (1, 3))
            yield pa.RecordBatch.from_arrays([pa.array(out.ravel().view(np.int64)), pa.array(np.full(len(rows), ROOT, np.int32)), pa.array(rows), pa.array(w)], ["path", "level", "row", "w"])

    return run


class _Node:
    """Rows of one node, by the number of their shingles, and their pairs that may be similar.

    A pair is a query with any other row, of another component. It is left to a node of an
    earlier root function if both share that node and it is compared exhaustively (``mask``).
    """

    def __init__(self, level: int, rows, n, comp, query, mask, sig, sets=None):
        order = np.argsort(n, kind="stable")
        self.rows, self.n, self.comp, self.query, self.mask, sig = (z[order] for z in (rows, n, comp, query, mask, sig))
        self.sig, self.root, self.level = sig[:, :FUNCTIONS], np.ascontiguousarray(sig[:, FUNCTIONS:]).view("<u4"), level
        self.sets = None if sets is None else [sets[k] for k in order.tolist()]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, other, agreeing functions), some at a time; ``comp`` may change between."""
        rows, n, sig = self.rows, self.n, self.sig
        q = np.flatnonzero(self.query)
        for at in range(0, len(q), 64):  # queries of like sizes, against the rows of sizes that fit
            part = q[at : at + 64]
            low = np.searchsorted(n, -(-n[part[0]] * LINK[1] // LINK[0]))
            high = np.searchsorted(n, n[part[-1]] * LINK[0] // LINK[1], "right")
            agree = np.zeros((len(part), high - low), np.uint8)
            for k in range(FIRST):
                agree += sig[part, k][:, None] == sig[low:high, k][None, :]
            ok = (agree >= AGREE_FIRST) & (self.comp[part][:, None] != self.comp[low:high][None, :])
            ok &= (rows[part][:, None] < rows[low:high][None, :]) | ~self.query[low:high][None, :]
            x, y = np.nonzero(ok)
            x, y = part[x], y + low
            fits = np.minimum(n[x], n[y]) * LINK[0] >= np.maximum(n[x], n[y]) * LINK[1]
            x, y = x[fits], y[fits]
            for k in range(self.level):
                late = (self.root[x, k] != self.root[y, k]) | (self.mask[x] >> k & 1 == 0)
                x, y = x[late], y[late]
            for p in range(0, len(x), 20_000):
                u, v = x[p : p + 20_000], y[p : p + 20_000]
                score = (sig[u] == sig[v]).sum(axis=1, dtype=np.int16)
                good = score >= AGREE
                yield u[good], v[good], score[good]

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest pairs that would join all rows that may belong together."""
        found = list(self.pairs())
        x, y, score = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        parent = {c: c for c in self.comp.tolist()}

        def find(c):
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        keep = []
        for k in np.argsort(-score, kind="stable").tolist():
            a, b = find(int(self.comp[x[k]])), find(int(self.comp[y[k]]))
            if a != b:
                parent[a] = b
                keep.append(k)
        x, y = x[keep], y[keep]
        return np.minimum(self.rows[x], self.rows[y]), np.maximum(self.rows[x], self.rows[y])

    def partnered(self) -> np.ndarray:
        """Rows that have a pair."""
        some = np.zeros(len(self.rows), bool)
        for x, y, _ in self.pairs():
            some[x] = some[y] = True
        return some

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """A forest of the pairs whose whole sets are similar enough."""
        bounds = np.concatenate([[0], np.cumsum([len(z) for z in self.sets])])
        known, ids = np.unique(np.concatenate(self.sets), return_inverse=True)
        mark = np.zeros(len(known), np.int32)
        out = []
        for x, y, _ in self.pairs():
            if not len(x):
                continue
            # The query with the most partners comes first: its links spare theirs.
            asked, counts = np.unique(x, return_counts=True)
            order = np.argsort(x, kind="stable")
            groups = dict(zip(asked.tolist(), np.split(y[order], np.cumsum(counts)[:-1]), strict=True))
            for q in asked[np.argsort(-counts, kind="stable")].tolist():
                own = ids[bounds[q] : bounds[q + 1]]
                mark[own] = 1
                other = groups[q]
                for at in range(0, len(other), 256):
                    part = other[at : at + 256]
                    part = part[self.comp[part] != self.comp[q]]
                    if not len(part):
                        continue
                    lengths = bounds[part + 1] - bounds[part]
                    starts = np.cumsum(lengths) - lengths
                    common = np.add.reduceat(mark[ids[ragged(bounds[part], lengths)]], starts)
                    hit = part[LINK[0] * common >= LINK[1] * (len(own) + lengths - common)]
                    for k in np.unique(self.comp[hit], return_index=True)[1].tolist():
                        out.append((self.rows[q], self.rows[hit[k]]))
                    self.comp[np.isin(self.comp, self.comp[hit])] = self.comp[q]
                mark[own] = 0
        a, b = np.array(out, np.int64).reshape(-1, 2).T
        return np.minimum(a, b), np.maximum(a, b)


def _by_node(what: str):
    """Per node of rows (path, level, row, n, comp, query, mask, sig[, set]) sorted by path, what ``_Node`` has.

    forest, links: pairs (a, b); partnered: the entries (path, level, row, query) of rows with a pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, None, []

        def flush():
            rows, comp, query = held[1], held[3], held[4]
            if len(rows) < 2 or not query.any() or (comp == comp[0]).all():
                return
            node = _Node(int(held[0][0]), *held[1:])
            if what == "partnered":
                some = node.partnered()
                out.append((np.full(some.sum(), key), np.full(some.sum(), node.level), node.rows[some], node.query[some]))
            else:
                out.append(node.forest() if what == "forest" else node.links())

        def told():
            columns = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
            out.clear()
            names = ["path", "level", "row", "query"] if what == "partnered" else ["a", "b"]
            columns = [c.cast(pa.int32()) if x == "level" else c for c, x in zip(columns, names, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            path = batch.column(0).to_numpy(zero_copy_only=False)
            columns = [*(batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, 7)), _signs(batch.column(7))]
            if what == "links":
                sets = np.empty(batch.num_rows, object)
                for k, raw in enumerate(batch.column(8)):
                    sets[k] = np.frombuffer(raw.as_buffer(), np.uint64)
                columns.append(sets)
            cuts = np.flatnonzero(np.diff(path)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(path)], strict=True):
                part = [z[s:e] for z in columns]
                if held is not None and path[s] == key:
                    held = [np.concatenate([u, v]) for u, v in zip(held, part, strict=True)]
                    continue
                if held is not None:
                    flush()
                key, held = path[s], part
            if out:
                yield told()
        if held is not None:
            flush()
        if out:
            yield told()

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, salt, b, set) sorted so that a's own set (b null) comes before those of its partners."""
    own, key = None, None
    for batch in batches:
        a, salt, b, sets = (batch.column(k) for k in range(4))
        out = []
        for x, s, y, raw in zip(a.to_pylist(), salt.to_pylist(), b.to_pylist(), sets, strict=True):
            value = np.frombuffer(raw.as_buffer(), np.uint64)
            if y is None:
                own, key = value.copy(), (x, s)
                continue
            assert key == (x, s)
            if min(len(own), len(value)) * LINK[0] < max(len(own), len(value)) * LINK[1]:
                continue
            few, many = (own, value) if len(own) < len(value) else (value, own)
            at = np.searchsorted(many, few)
            common = int((many[np.minimum(at, len(many) - 1)] == few).sum())
            if LINK[0] * common >= LINK[1] * (len(own) + len(value) - common):
                out.append((x, y))
        if out:
            u, v = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["a", "b"])


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows whose whole sets are similar enough."""
    salted = pairs.select("a", F.pmod(F.xxhash64("b"), F.lit(1 << 20)).alias("h"), "b")
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS).cast("int").alias("shares"))
    salted = salted.join(counts, "a").select("a", F.pmod("h", "shares").cast("int").alias("salt"), "b")
    partner = salted.join(sets.withColumnRenamed("row", "b"), "b").select("a", "salt", "b", "set")
    mine = salted.select("a", "salt").distinct().join(sets.withColumnRenamed("row", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "set")
    dealt = partner.unionByName(mine).repartition(partitions(pairs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(_verify, "a long, b long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, sizes: Sizes = SIZES) -> DataFrame:
    """One row per row of ``docs``: id_col, n_shingles, component_id, kept, text_key.

    component_id is the smallest id reachable by links, kept says that it is the row's own.
    Null and empty texts, and texts of white space, have no shingles, link with nothing, and
    are kept; so are rows without an id, whose component_id is null. Rows that repeat an id
    are one document if their sets are equal; else each links for itself. Other columns are
    ignored; no rows give no rows. text_key (of xxhash64) tells apart texts of rows that repeat
    an id. ``sizes`` says where nodes are split, whatever the result.
    """
    ws = Workspace(docs.sparkSession, "near")
    text = F.coalesce(docs[text_col], F.lit(""))
    source = docs.select(docs[id_col].cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("key"))
    sketch = ws.write(source.mapInArrow(_sketch(n), "id long, key long, n long, d1 long, d2 long, root array<long>, sig binary"), "sketch")
    # One member of each class of equal sets goes on, under a number of its own.
    some = sketch.where("n > 0 and id is not null")
    first = some.groupBy("d1", "d2", "n").agg(F.min(F.struct("id", "key")).alias("rep"))
    classes = ws.write(first.select("d1", "d2", "n", "rep.id", "rep.key", F.monotonically_increasing_id().alias("row")), "classes")
    members = some.hint("merge").join(classes, ["d1", "d2", "n", "id", "key"]).dropDuplicates(["d1", "d2", "n", "id", "key"])
    members = ws.write(members.select("row", "n", (1 + F.floor(F.col("n") / WEIGHT)).cast("long").alias("w"), "root", "sig"), "members")
    signs = members.select("row", "n", "w", "sig")
    entries = members.select(F.posexplode("root").alias("level", "token"), "row", "w").select(F.xxhash64("level", "token").alias("path"), "level", "row", "w")
    nodes = _crowded(entries, ws, "nodes0")

    def sets_of(rows: DataFrame, name: str) -> DataFrame:
        wanted = classes.join(rows.select("row").distinct(), "row").select("id", "key", "row")
        texts = source.hint("merge").join(wanted, ["id", "key"]).groupBy("id", "key", "row").agg(F.first("text").alias("text"))
        return ws.write(texts.select("row", "text").mapInArrow(_sets(n), "row long, set binary"), name)

    # First as few pairs as can join the members of each node: a forest, or a star if it is large.
    everyone = nodes.select("path", "level", "row", "size", F.lit(True).alias("query"))
    large = everyone.where(F.col("size") > sizes.forest)
    centre = large.groupBy("path", "size").agg(F.min("row").alias("row"))
    star = _shares(large.join(centre.select("path", "row"), ["path", "row"], "left_anti"), centre.withColumn("block", F.lit(0)), sizes)
    first_nodes = everyone.where(F.col("size") <= sizes.forest).select("path", "row", "query").unionByName(star).withColumn("level", F.lit(0))
    pairs = ws.write(_dealt(first_nodes, signs, None, None, ws).mapInArrow(_by_node("forest"), "a long, b long").distinct(), "pairs")
    links = ws.write(_confirm(pairs, sets_of(pairs.select(F.explode(F.array("a", "b")).alias("row")), "pair-sets")), "links")
    ws.drop("pair-sets", "pairs")
    comp = components(links, ws, "comp-first")
    # Then whatever may still join components, compared by whole sets inside the nodes.
    left, mask = _mixed(nodes, comp, signs, ws, sizes)
    partnered = ws.write(_dealt(left, signs, comp, mask, ws).mapInArrow(_by_node("partnered"), "path long, level int, row long, query boolean"), "partnered")
    inside = _dealt(partnered, signs, comp, mask, ws, sets_of(partnered, "node-sets"))
    found = ws.write(inside.mapInArrow(_by_node("links"), "a long, b long"), "links-rest")
    ws.drop("node-sets", "partnered", "mixed0")
    comp = components(links.unionByName(found), ws, "comp-rest")
    whole = classes.join(comp.withColumnRenamed("node", "row"), "row", "left").select("d1", "d2", "n", "id", F.coalesce("component", "row").alias("component"))
    smallest = whole.groupBy("component").agg(F.min("id").alias("component_id"))
    whole = whole.join(smallest, "component").select("d1", "d2", "n", "component_id")
    out = sketch.select("id", "key", "n", "d1", "d2").join(whole, ["d1", "d2", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"), F.col("key").alias("text_key"))


def _crowded(entries: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """Entries (path, level, row, w) of nodes with several rows, and the node's size."""
    entries = ws.write(entries, f"{name}-all")
    # Written before the join, so that the rows of a large node can be split.
    size = entries.groupBy("path").agg(F.sum("w").alias("size"), F.count(F.lit(1)).alias("many")).where("many > 1").drop("many")
    size = ws.write(size, f"{name}-sizes")
    out = ws.write(entries.hint("merge").join(size, "path"), name)
    ws.drop(f"{name}-all", f"{name}-sizes")
    return out


def _shares(members: DataFrame, queries: DataFrame, sizes: Sizes) -> DataFrame:
    """A large node in shares: its members dealt out, each block of queries with every share."""
    shares = F.ceil(F.col("size") / sizes.share).cast("int")
    blocks_of = queries.groupBy("path").agg((F.max("block") + 1).alias("blocks"))
    dealt = members.join(blocks_of, "path").withColumn("share", F.pmod(F.xxhash64("row"), shares).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = queries.withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1)))
    key = F.xxhash64("path", "share", "block").alias("path")
    return dealt.select(key, "row", F.lit(False).alias("query")).unionByName(asked.select(key, "row", F.lit(True).alias("query")))


def _dealt(nodes: DataFrame, signs: DataFrame, comp: DataFrame | None, mask: DataFrame | None, ws: Workspace, sets: DataFrame | None = None) -> DataFrame:
    """Nodes (path, level, row, query) with all that their comparison needs, one after the other."""
    about = signs.select("row", "n", "sig")
    about = about.withColumn("comp", F.col("row")) if comp is None else about.join(comp.withColumnRenamed("node", "row"), "row", "left").withColumn("comp", F.coalesce("component", "row"))
    about = about.withColumn("mask", F.lit(0).cast("long")) if mask is None else about.join(mask, "row", "left").withColumn("mask", F.coalesce("mask", F.lit(0).cast("long")))
    if sets is not None:
        about = about.join(sets, "row")
    full = nodes.hint("merge").join(about, "row").select("path", "level", "row", "n", "comp", "query", "mask", "sig", *(["set"] if sets is not None else []))
    return full.repartition(partitions(ws.spark), "path").sortWithinPartitions("path", "row")


def _mixed(nodes: DataFrame, comp: DataFrame, signs: DataFrame, ws: Workspace, sizes: Sizes) -> tuple[DataFrame, DataFrame]:
    """Nodes (path, level, row, query) whose rows lie in several components, large ones branched or in shares.

    And (row, mask): the bits of the root functions whose node is compared exhaustively.
    """
    out, depth, mask = None, 0, None
    while True:
        labelled = nodes.join(comp.withColumnRenamed("node", "row"), "row", "left").withColumn("comp", F.coalesce("component", "row")).drop("component")
        counts = labelled.groupBy("path", "comp").agg(F.sum("w").alias("rows"))
        mixed = counts.groupBy("path").agg(F.max_by("comp", F.struct("rows", "comp")).alias("main"), F.max("rows").alias("most"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
        mixed = ws.write(mixed, f"comps{depth}")
        live = ws.write(labelled.hint("merge").join(mixed.select("path", "main", "most"), "path"), f"mixed{depth}")
        other = F.col("size") - F.col("most")
        small = live.where(F.col("size") <= sizes.small)
        if depth == 0:
            mask = ws.write(small.groupBy("row").agg(F.sum(F.expr("shiftleft(1L, level)")).alias("mask")), "mask")
        few = live.where(F.col("size") > sizes.small)
        if depth < sizes.depth:
            deep, few = few.where(other > sizes.queries), few.where(other <= sizes.queries)
        queries = few.where("comp <> main").withColumn("block", F.pmod(F.xxhash64("row"), F.ceil(other / sizes.queries)).cast("int"))
        # Queries of several blocks also meet as members.
        members = few.where((F.col("comp") == F.col("main")) | (other > sizes.queries))
        here = _shares(members.select("path", "row", "size"), queries.select("path", "row", "size", "block"), sizes).withColumn("level", F.lit(ROOT))
        here = small.select("path", "level", "row", F.lit(True).alias("query")).unionByName(here)
        out = here if out is None else out.unionByName(here)
        if depth == sizes.depth or deep.isEmpty():
            return out, mask
        depth += 1
        below = deep.select("path", "row").join(signs.select("row", "w", "sig"), "row").select("path", "row", "sig", "w").mapInArrow(_branch(depth), "path long, level int, row long, w long")
        nodes = _crowded(below, ws, f"nodes{depth}")
