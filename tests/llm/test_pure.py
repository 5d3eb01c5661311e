"""Parts of the operators without Spark, against plain versions."""

import itertools
import random

import brute
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fathomlog.llm.byte_tokens import encoder
from fathomlog.llm.components import forest
from fathomlog.llm.embedding_dedup import join_blocks, join_boxes
from fathomlog.llm.line_dedup import patience
from fathomlog.llm.packing import best_fit_decreasing, cut, lower_bound
from fathomlog.llm.piece_codec import PieceCodec
from fathomlog.llm.token_counts import CHUNK, TokenTree
from fathomlog.llm.toxicity import DECAY, LEAST, ORDER, Model, alike, codes, kernel, strings, svm
from fathomlog.llm.url_filter import UrlTrie

ODD = ["", "  a  b\n\tc ", "x　y", "▁ ▁a ▁▁b", "\x00ab", "<s> </s><0x0A> <unk>", "   ", "\n\n \n", "a" * 3000, "日本語 🎉🎉", "é" * 50 + " \r\n", "<|endoftext|>", "\x1d a"]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(7)
    alphabet = "abeinth  \n▁.é日<>0x\t'"
    return ODD + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 80))) for _ in range(500)]


def test_pieces_equal_the_library(texts):
    path = public_tokenizers.path("piece_bpe_32k.model")
    coder, library = PieceCodec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for t in texts:
        ids = [library.bos_id(), *library.encode(t), library.eos_id()]
        raw, plain = coder.round_trip(t)
        assert np.frombuffer(raw, "<u4").tolist() == ids == coder.encode(t)
        assert plain == coder.decode(ids) == library.decode(ids)
    assert coder.decode([library.unk_id(), coder.byte_id[0xC3], coder.byte_id[0x28]]) == "�("


def test_byte_ids_equal_the_library(texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for t in [*texts, "a<|endoftext|>b", " <|endoftext|> \n", "<|endoftext|><|endoftext|>", "<|endof<|endoftext|>text|>"]:
        assert encoder(path)(t) == library.encode(t, add_special_tokens=False).ids


class Recorded:
    """An encoder that remembers how much it was given."""

    def __init__(self, encode):
        self.encode, self.widths, self.given = encode, encode.widths, []

    def __call__(self, text):
        self.given.append(len(text))
        return self.encode(text)


def test_token_trees_follow_edits(texts):
    r, encode = random.Random(3), encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for t in [*texts[:200], " ".join(r.choice(["the", "a", "é", "<|endoftext|>", "x\n"]) for _ in range(900))]:
        tree = TokenTree(t, encode)
        for _ in range(12):
            a = r.randint(0, len(t) + 2)
            b = r.randint(a, r.choice([a + 5, len(t) + 5]))
            new = r.choice(["", " ", "the", " the ", "\n", "'s", "é ", "<|endoftext|>", "many more words " * 30])
            tree.edit(a, b, new)
            t = t[:a] + new + t[b:]
            assert "".join(tree.leaves()) == t and tree.total == len(encode(t)) and tree.length == len(t)


def test_edits_encode_only_what_they_touch():
    r, encode = random.Random(4), Recorded(encoder(public_tokenizers.path("byte_bpe_50k.json")))
    t = " ".join("x" * r.randint(65, 90) for _ in range(1001))
    tree = TokenTree(t, encode)
    assert encode.given == [len(t)]
    for _ in range(200):
        encode.given.clear()
        at, encoded = r.randint(0, len(t)), tree.encoded
        until = at + r.choice([0, 0, 300])
        new = r.choice(["", " two more", " a " * 3 * CHUNK])
        tree.edit(at, until, new)
        t = t[:at] + new + t[until:]
        assert len(encode.given) == 1 and encode.given[0] <= len(new) + 6 * 300
        assert tree.encoded - encoded <= 3 * 3 * CHUNK + 12
    assert tree.total == len(encode.encode(t)) and "".join(tree.leaves()) == t


def test_packing_bounds():
    r = np.random.default_rng(0)
    for sizes in (r.integers(1, 33, 200), r.integers(12, 20, 90), np.full(7, 32), np.array([], int)):
        bins = best_fit_decreasing(sizes, 32)
        fill = np.bincount(bins, sizes) if len(sizes) else np.zeros(0)
        low, _ = lower_bound(sizes, 32)
        assert (fill <= 32).all() and low <= len(fill) <= 1.23 * low + 1
    assert lower_bound(np.array([17, 17, 17, 16]), 32)[0] == 4
    assert cut(5, 4) == [(0, 1), (1, 4)] and cut(4, 4) == [(0, 4)] and cut(1, 4) == [(0, 1)]


def test_patience():
    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.randint(0, 9) for _ in range(r.randint(0, 12))] for _ in range(2))
        last = (0, 0)
        for i, j, n in patience(a, b):
            assert a[i : i + n] == b[j : j + n] and i >= last[0] and j >= last[1]
            last = i + n, j + n
    assert patience(list("abcde"), list("abXde")) == [(0, 0, 2), (3, 3, 2)]


def test_forest():
    r = np.random.default_rng(1)
    for n, m in ((10, 8), (300, 250)):
        a, b = r.integers(0, n, m), r.integers(0, n, m)
        found = {i: i for i in range(n)} | dict(zip(*(x.tolist() for x in forest(a, b)), strict=True))
        assert found == brute.components(range(n), zip(a.tolist(), b.tolist(), strict=True))


def test_interval_join():
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(size=(300, 8)), np.repeat(r.normal(size=(1, 8)), 200, 0) + r.normal(size=(200, 8)) * 0.05])
    x /= np.linalg.norm(x, axis=1)[:, None]
    x = x[np.argsort(x[:, 0])]
    hit = x @ x.T >= 0.9
    np.fill_diagonal(hit, False)
    n, _, a, b = join_blocks(x, None, np.ones(500, int), None, 0.9)
    assert (n == hit.sum(1)).all()
    want = brute.components(range(500), zip(*np.nonzero(hit), strict=True))
    assert brute.components(range(500), zip(a.tolist(), b.tolist(), strict=True)) == want
    n1, n2, _, _ = join_blocks(x[:260], x[260:], np.ones(260, int), np.ones(240, int), 0.9)
    assert (n1 == hit[:260, 260:].sum(1)).all() and (n2 == hit[:260, 260:].sum(0)).all()
    boxes = np.sort(r.uniform(0, 10, (40, 1)), axis=0)
    assert set(join_boxes(boxes, boxes + 0.1, 1.0)) == {(i, j) for i in range(40) for j in range(i, 40) if boxes[j] - boxes[i] - 0.1 <= 1.0}


def test_trie():
    trie = UrlTrie([("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/a/", "block"), ("com", "/a/", "allow")])
    assert trie.match("m.example.org", "/es/x")[2:] == ("example.org/es/", "block")
    assert trie.match("m.example.org", "/en/17")[2:] == ("example.org/en/1", "block")
    assert trie.match("example.org", "/fr/")[2:] == ("org/", "allow")
    assert trie.match("notexample.org", "/es/")[2:] == ("org/", "allow")
    assert trie.match("x.com", "/a/b")[3] == "block"
    assert trie.match("x.net", "/") is None and trie.match("", "") is None


def test_gapped_words_resemble():
    assert alike("\x02idiot\x03", "\x02i-d-iot\x03") > 0.3 > alike("\x02idiot\x03", "\x02garden\x03")
    assert "\x02idiot\x03" in strings("You i d i o t of") or "\x02idiot\x03" in strings("see: i d i o t .")
    assert strings("") == set() and all(len(s) <= 24 for s in strings("x" * 999))


def plain_kernel(s: str, t: str) -> float:
    """Sum over common subsequences, from all choices of places."""

    def weights(x):
        out = {}
        for at in itertools.combinations(range(len(x)), ORDER):
            key = "".join(x[k] for k in at)
            out[key] = out.get(key, 0) + DECAY ** (at[-1] - at[0] + 1)
        return out

    a, b = weights(s), weights(t)
    return sum(v * b[k] for k, v in a.items() if k in b)


def test_kernel_equals_its_definition():
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randint(1, 9)))
    words, marks = sorted({word() for _ in range(200)}), [word() + "abc" for _ in range(6)]
    for a, b in zip(words, words[1:], strict=False):
        assert np.isclose(kernel(codes([a]), codes([b]))[0], plain_kernel(a, b), rtol=1e-5)
    found = Model(marks, np.array([plain_kernel(m, m) for m in marks]), np.zeros(6), 0.0, 1.0, 0.0).values(words)
    want = [[max(min(plain_kernel(w, m) / plain_kernel(m, m), 1) - LEAST, 0) / (1 - LEAST) for m in marks] for w in words]
    assert np.allclose(found, want, atol=1e-5) and (found > 0).mean() > 0.02
    ends = Model(["\x02disgusting\x03"], np.array([plain_kernel("\x02disgusting\x03", "\x02disgusting\x03")]), np.zeros(1), 0.0, 1.0, 0.0)
    assert (ends.values(["\x02disgust\x03", "\x02disgusted\x03"]) > 0.25).all()


def test_svm_finds_the_widest_margin():
    x = np.array([[-1.0, 0.3], [-2.0, -0.5], [1.0, 0.2], [3.0, 0.1], [-1.0, -0.7], [1.0, -0.9]])
    w, b = svm(x, np.array([0, 0, 1, 1, 0, 1]), cost=1000.0, rounds=3000)
    assert np.allclose(w, [1, 0], atol=0.02) and abs(b) < 0.02
