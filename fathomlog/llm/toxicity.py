"""Toxicity by a subsequence string kernel support vector machine with Nyström landmarks.

The kernel of two strings sums over their common subsequences of ``ORDER`` characters, each
gap or inserted character costing a factor ``DECAY``; so "i-d.i_o t" still resembles "idiot".
Strings are words between start and end marks, pieces of very long words, and runs of single
characters joined. Landmarks are strings that stand out in toxic training documents, and some
common ones. The value of a word at a landmark is its kernel over the landmark's with itself,
at most 1, as far as it exceeds ``LEAST``: all words resemble all others a little, and a long
text holds many. A document has for each landmark the largest value of its words, and a damped
sum of those at least half; both, turned by the Nyström map of the landmarks, go into a linear
support vector machine whose margin becomes a probability. Pairs of words and landmarks are
spared the kernel only where an upper bound of it proves that the value is none.

Training reads a bounded sample of labelled documents; scoring is one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spans import as_strings
from .workspace import Workspace, small_batches

ORDER, DECAY = 4, 0.6
#: Labelled documents of each class that training reads at most, by the hash of their ids.
SAMPLE = {1: 1500, 0: 3000}
#: Landmarks from toxic and from clean documents; lengths of pieces of words that may be one,
#: and of words; longest string.
TOXIC, CLEAN, GRAM, WORD, PIECE = 40, 8, 6, 12, 24
#: What a landmark value must exceed to count; landmarks more alike than this are one.
LEAST, ALIKE = 0.2, 0.7
#: Candidates for landmarks, and landmarks that each toxic training document should hold.
CANDIDATES, COVER = 3000, 3
THRESHOLD = 0.3
START, END = "\x02", "\x03"
_EDGES = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~¡¿«»“”„‘’…–—"
_SINGLES = re.compile(r"(?<!\S)(?:\S\s){3,}\S(?!\S)")


def strings(text: str) -> set[str]:
    """Marked words of a text in lower case."""
    text = text.lower()
    found = {w.strip(_EDGES) for w in set(text.split())}
    found |= {"".join(m.split()) for m in _SINGLES.findall(text)}
    found.discard("")
    out = {START + w + END for w in found if len(w) <= PIECE}
    for w in found:
        if len(w) > PIECE:
            w = START + w + END
            out |= {w[k : k + PIECE] for k in range(0, len(w), PIECE // 2)}
    return out


def codes(words: list[str]) -> np.ndarray:
    """Code points, one row for each word, zeros after its end."""
    width = max(map(len, words), default=0)
    raw = np.array(words, dtype=f"<U{max(width, 1)}")
    return raw.view(np.uint32).reshape(len(words), -1)


def kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Kernel of each row of ``s`` with the same row of ``t``: code points, zeros after the end."""
    n, m, d = s.shape[1], t.shape[1], np.float32(DECAY)
    rows = len(s)
    t = np.where(t == 0, np.uint32(0xFFFFFFFF), t)
    total = np.zeros(rows, np.float32)
    # before[i, j]: K'_i of the row's prefix so far and the first j characters of its t
    before = np.zeros((ORDER, m + 1, rows), np.float32)
    before[0] = 1
    for x in range(n):
        same = (s[:, x][:, None] == t).T
        found = before[:, :-1] * (same * (d * d))
        total += found[ORDER - 1].sum(axis=0)
        before[1:] *= d
        run = np.zeros((ORDER - 1, rows), np.float32)
        for j in range(1, m + 1):
            run = d * run + found[:-1, j - 1]
            before[1:, j] += run
    return total


def _pair(a: str, b: str) -> float:
    return float(kernel(codes([a]), codes([b]))[0])


def alike(a: str, b: str) -> float:
    own = _pair(a, a) * _pair(b, b)
    return _pair(a, b) / own**0.5 if own else 0.0


def bound(times: np.ndarray) -> np.ndarray:
    """An upper bound of the kernel, from how often a string has each character of a landmark, in order.

    Each occurrence of a subsequence in the landmark meets at most the product of these numbers
    of occurrences in the string, each of them over ``ORDER`` characters at least.
    """
    d = np.float32(DECAY)
    open_ = np.zeros((ORDER, len(times)), np.float32)
    total = np.zeros(len(times), np.float32)
    for j in range(times.shape[1]):
        w = times[:, j]
        total += open_[ORDER - 1] * w * d
        open_[1:] = open_[1:] * d + open_[:-1] * (w * d)
        open_[1] += w * d
        open_[0] = 0
    return total * d**ORDER * np.float32(1.0001)


@dataclass
class Model:
    """Landmarks, the weights of their values, and the margin's turn into a probability."""

    landmarks: list[str]
    own: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def values(self, words: list[str]) -> np.ndarray:
        """What kernel values over the landmark's own exceed ``LEAST`` by, words by landmarks."""
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        if not words or not self.landmarks:
            return out
        marks = codes(self.landmarks)
        chars = np.unique(marks[marks > 0])
        at = np.searchsorted(chars, marks) + (marks > 0)  # 0 behind the ends
        times = np.stack([(marks == c).sum(axis=1) for c in chars]).astype(np.float32)
        least = (LEAST * self.own).astype(np.float32)
        order = np.argsort([len(w) for w in words], kind="stable")
        for first in range(0, len(words), 4096):
            part = order[first : first + 4096]
            s = codes([words[k] for k in part])
            held = np.zeros((len(s), len(chars) + 1), np.float32)
            for k, c in enumerate(chars, 1):
                held[:, k] = (s == c).sum(axis=1)
            # A common subsequence takes ORDER places of the landmark whose characters the word has.
            w, k = np.nonzero((held[:, 1:] > 0).astype(np.float32) @ times >= ORDER)
            for p in range(0, len(w), 16_384):
                u, v = w[p : p + 16_384], k[p : p + 16_384]
                close = bound(held[u[:, None], at[v]]) > least[v]
                u, v = u[close], v[close]
                if len(u):
                    out[part[u], v] = kernel(s[u], marks[v]) / self.own[v]
        return np.maximum(np.minimum(out, 1) - LEAST, 0) / (1 - LEAST)

    def score(self, features: np.ndarray) -> np.ndarray:
        z = self.slope * (features @ self.weights + self.bias) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Words:
    """Landmark values of the words a worker has met, for two generations of them."""

    LIMIT = 200_000

    def __init__(self, model: Model):
        self.model, self.new, self.old = model, {}, {}

    def learn(self, words: set[str]) -> None:
        missing = words - self.new.keys()
        known = missing & self.old.keys()
        self.new.update((w, self.old[w]) for w in known)
        fresh = list(missing - known)
        values = self.model.values(fresh)
        self.new.update(dict.fromkeys(fresh))
        for k in np.flatnonzero(values.any(axis=1)).tolist():
            self.new[fresh[k]] = values[k]

    def turn(self) -> None:
        if len(self.new) > self.LIMIT:
            self.old, self.new = self.new, {}

    def features(self, texts: list[str]) -> np.ndarray:
        """Largest values over the words of each text, then damped sums."""
        m = len(self.model.landmarks)
        out = np.zeros((len(texts), 2 * m), np.float32)
        for at in range(0, len(texts), 200):
            sets = [strings(t) for t in texts[at : at + 200]]
            self.learn(set().union(*sets))
            for k, s in enumerate(sets):
                if rows := [v for v in map(self.new.__getitem__, s) if v is not None]:
                    rows = np.array(rows)
                    out[at + k, :m] = rows.max(axis=0)
                    out[at + k, m:] = np.log1p(np.where(rows >= 0.5, rows, 0).sum(axis=0))
            self.turn()
        return out


def whole(gram: str) -> bool:
    """Whether a candidate may be a landmark: a marked word, however short, or a long enough piece."""
    return len(gram) >= GRAM or len(gram) > ORDER and gram[0] == START and gram[-1] == END


def grams_of(text: str) -> set[str]:
    """Candidates for landmarks in a text: marked words and pieces of them."""
    grams = set()
    for w in strings(text):
        if len(w) <= WORD:
            grams.add(w)
        grams |= {w[k : k + GRAM] for k in range(len(w) - GRAM + 1)}
    return grams


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, toxic documents, clean documents) of this task's training documents."""
    counts = {0: Counter(), 1: Counter()}
    for batch in batches:
        for text, label in zip(as_strings(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            counts[label].update(grams_of(text.as_py()))
    names = list(counts[0].keys() | counts[1].keys())
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([counts[c][g] for g in names], pa.int64()) for c in (1, 0))], ["gram", "toxic", "clean"])


def _features(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(model)
        for batch in batches:
            x = words.features(as_strings(batch.column(0)).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1), batch.column(2)], ["x", "label", "id"])

    return run


def svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Linear support vector machine (hinge loss, classes weighted alike) by dual coordinate descent."""
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    sign = np.where(y == 1, 1.0, -1.0)
    limit = cost * len(y) / (2 * np.where(y == 1, max((y == 1).sum(), 1), max((y == 0).sum(), 1)))
    norm = (x * x).sum(axis=1)
    a, w = np.zeros(len(y)), np.zeros(x.shape[1])
    order = np.random.default_rng(0)
    for _ in range(rounds):
        for k in order.permutation(len(y)):
            step = min(max(a[k] - (sign[k] * (x[k] @ w) - 1) / norm[k], 0.0), limit[k])
            if step != a[k]:
                w += (step - a[k]) * sign[k] * x[k]
                a[k] = step
    return w[:-1], float(w[-1])


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, with the usual smoothed targets, by Newton steps."""
    plus, minus = (y == 1).sum(), (y == 0).sum()
    goal = np.where(y == 1, (plus + 1) / (plus + 2), 1 / (minus + 2))
    u = np.column_stack([margin, np.ones(len(margin))])
    v = np.array([1.0, np.log((plus + 1) / (minus + 1))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(u @ v, -30, 30)))
        h = (u * (p * (1 - p) + 1e-9)[:, None]).T @ u + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, u.T @ (p - goal))
        v -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(v[0], 1e-3)), float(v[1])


def _present(candidates: list[str]):
    """Which candidates each training document holds: (numbers, label, id)."""
    number = {g: k for k, g in enumerate(candidates)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(number[g] for g in grams_of(t.as_py()) & number.keys()) for t in as_strings(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1), batch.column(2)], ["found", "label", "id"])

    return run


def _evidence(p: np.ndarray, n: np.ndarray, rate: float, held: np.ndarray) -> np.ndarray:
    """Log-likelihood gain of a share of toxic documents above the usual one, for ``held`` of them."""
    share = (p + 0.5) / (p + n + 1)
    return np.where(share > rate, held * np.log(share / rate) + n * np.log((1 - share) / (1 - rate)), 0.0)


def choose(candidates: list[str], toxic: list[list[int]], clean: list[list[int]], most: int = TOXIC) -> list[str]:
    """Landmarks by greedy cover: each adds the most evidence for toxic documents that lack some."""
    hold = np.zeros((len(toxic), len(candidates)), bool)
    for d, found in enumerate(toxic):
        hold[d, found] = True
    n = np.zeros(len(candidates))
    for found in clean:
        n[found] += 1
    p, rate = hold.sum(axis=0), len(toxic) / (len(toxic) + len(clean))
    need = np.full(len(toxic), COVER)
    usable = np.array([whole(c) for c in candidates], bool)
    chosen: list[str] = []
    while len(chosen) < most:
        gain = np.where(usable, _evidence(p, n, rate, hold[need > 0].sum(axis=0)), 0)
        best = int(gain.argmax()) if len(gain) else 0
        if not len(gain) or gain[best] <= 2:
            break
        usable[best] = False
        if all(alike(candidates[best], c) < ALIKE for c in chosen):
            chosen.append(candidates[best])
            need[hold[:, best]] -= 1
    return chosen


def train(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE, id_col: str = "doc_id", text_col: str = "text", landmarks: tuple[int, int] = (TOXIC, CLEAN), most: int = CANDIDATES) -> Model:
    """A model of ``labels`` (id_col, toxic) and their documents.

    Reads at most ``sample`` documents of each class, those with the smallest hashes of their
    ids, and takes at most ``landmarks`` landmarks from toxic and common strings, of at most
    ``most`` candidates. Null labels and ids are left out; an id that is labelled both ways is
    toxic. Without documents of both classes, the model knows
    no landmarks and gives the share of toxic ones.
    """
    ws = Workspace(docs.sparkSession, "toxicity")
    marks = labels.select(labels[id_col].alias("id"), F.col("toxic").cast("int").alias("label")).where("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    some = None
    for label, n in sample.items():
        part = marks.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(n)
        some = part if some is None else some.unionByName(part)
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    chosen = ws.write(texts.join(F.broadcast(some), "id").select("text", "label", "id"), "sample")
    counts = dict(chosen.groupBy("label").count().collect())
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    if not toxic or not clean:
        rate = min(max((toxic + 1) / (toxic + clean + 2), 0.01), 0.99)
        return Model([], np.zeros(0), np.zeros(0), 0.0, 1.0, float(np.log(rate / (1 - rate))))
    chosen = chosen.repartition(16)
    grams = ws.write(chosen.mapInArrow(_grams, "gram string, toxic long, clean long").groupBy("gram").agg(F.sum("toxic").alias("p"), F.sum("clean").alias("n")), "grams")
    rate = F.lit(toxic / (toxic + clean))
    p, n = F.col("p"), F.col("n")
    share = (p + 0.5) / (p + n + 1)
    gain = F.when(share > rate, p * F.log(share / rate) + n * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    best = grams.where(p >= 2).select("gram", gain.alias("gain")).where("gain > 2").orderBy(F.desc("gain"), "gram").limit(most).collect()
    candidates = [r[0] for r in best]
    kind = chosen.schema["id"].dataType.simpleString()
    # In the order of their ids, so that the same documents always give the same model.
    held = sorted(chosen.mapInArrow(_present(candidates), f"found array<int>, label int, id {kind}").collect(), key=lambda r: (r[2], r[0]))
    marks = choose(candidates, [r[0] for r in held if r[1] == 1], [r[0] for r in held if r[1] == 0], landmarks[0])
    for gram, *_ in grams.where((n > 0) & (F.length("gram") >= GRAM)).orderBy(F.desc("n"), "gram").limit(50).collect():
        if len(marks) < sum(landmarks) and all(alike(gram, c) < ALIKE for c in marks):
            marks.append(gram)
    own = np.array([_pair(m, m) for m in marks])
    model = Model(marks, own, np.zeros(len(marks)), 0.0, 1.0, 0.0)
    rows = sorted(chosen.mapInArrow(_features(model), f"x binary, label int, id {kind}").collect(), key=lambda r: (r[2], r[0]))
    x = np.array([np.frombuffer(r[0], np.float32) for r in rows], np.float64).reshape(len(rows), 2 * len(marks))
    y = np.array([r[1] for r in rows])
    # Nyström: features are kernel values turned by the inverse root of the landmarks' own kernel.
    gram = np.array([[_pair(a, b) for b in marks] for a in marks]) / np.sqrt(np.outer(own, own))
    value, vector = np.linalg.eigh(gram)
    root = np.kron(np.eye(2), vector @ np.diag(1 / np.sqrt(np.maximum(value, 0.2))) @ vector.T)
    w, bias = svm(x @ root, y, cost=1.0)
    weights = root @ w
    slope, shift = platt(x @ weights + bias, y)
    return Model(marks, own, weights, bias, slope, shift)


def _scores(model: Model, text_at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(model)
        for batch in batches:
            x = words.features(as_strings(batch.column(text_at)).to_pylist())
            yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(batch.columns) if k < len(names) - 1), pa.array(model.score(x.astype(np.float64)))], names)

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id_col and score (0 to 1) of every row of ``docs``; a null text is empty.

    Texts without words get the score of a text without any landmark. Every row stays;
    other columns are ignored; no rows give no rows.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(_scores(model, 1, ["id", "score"]), f"id {kind}, score double").withColumnRenamed("id", id_col)


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``docs``, and ``score_col`` behind them: each row's own, without a shuffle."""
    if score_col in docs.columns:
        raise ValueError(f"there is a column {score_col}; name another one for the score")
    small_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])
    return docs.mapInArrow(_scores(model, docs.columns.index(text_col), schema.names), schema)
