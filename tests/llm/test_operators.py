"""Operators on Spark: small tables with nulls, repeats, long texts and clashing columns, against plain versions."""

import hashlib
import os
import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from fathomlog.llm.byte_tokens import encoder
from fathomlog.llm.embedding_dedup import embedding_dedup
from fathomlog.llm.exact_dedup import DigestIndex, exact_dedup, keep_unique, sha256
from fathomlog.llm.line_dedup import line_dedup
from fathomlog.llm.near_dedup import Sizes, near_dedup
from fathomlog.llm.packing import best_fit_decreasing, lower_bound, pack, pack_documents
from fathomlog.llm.piece_codec import encode_decode
from fathomlog.llm.queries import op10_toxicity
from fathomlog.llm.substring_dedup import substring_dedup
from fathomlog.llm.token_counts import count_tokens
from fathomlog.llm.toxicity import score, train
from fathomlog.llm.url_filter import filter_urls
from fathomlog.llm.workspace import Workspace

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, id string, row string, n int, label string, key string, digest string, text_key string, line string, path string, part int, length int, unit int, x int"


def table(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, *["clash", "clash", 1, "c", "c", "c", "c", "c", "c", 1, 1, 1, 1]) for i, t in rows], SCHEMA)


def corpus(seed=5):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6)))
    passage = " ".join(word() for _ in range(70))
    docs = [" ".join(word() for _ in range(r.randint(1, 160))) for _ in range(40)]
    docs += [docs[0], docs[0], docs[1].upper(), docs[2] + " \n " + docs[2]]
    for k in range(25):  # near copies, and documents that share a passage
        w = docs[k].split()
        for _ in range(r.randint(1, 3)):
            w[r.randrange(len(w))] = word()
        docs.append(" ".join(w))
        docs.append(" ".join([docs[k][:200], passage, word()]))
    docs += ["<|endoftext|>", "an end <|endoftext|> inside", "an end<|endoftext|>\n  inside"]
    docs += ["", "   ", "one", "one two three four five", " ".join(word() for _ in range(30_000))]
    order = list(range(100, 100 + len(docs)))
    r.shuffle(order)
    return [*zip(order, docs, strict=True), (7, None)]


@pytest.fixture(scope="module")
def docs():
    return corpus()


def by_id(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_substring(spark, docs):
    found = substring_dedup(table(spark, docs))
    kept = F.when(F.col("kept_text").isNotNull(), F.sha2("kept_text", 256)).otherwise(F.col("words_sha256"))
    assert by_id(found.select("doc_id", "n_words", "n_removed", kept)) == brute.substring(docs)
    words = {i: brute.words(t) for i, t in docs}
    windows = {i: {tuple(w[k : k + 50]) for k in range(len(w) - 49)} for i, w in words.items()}
    for row in found.where("n_removed > 0").collect():
        own, covered, last = words[row.doc_id], set(), None
        for f in row.factors:
            assert f.first < row.doc_id and {tuple(own[k : k + 50]) for k in range(f.start, f.start + f.n_words - 49)} <= windows[f.first]
            assert last is None or f.start > last.start + last.n_words - 50 and (f.first != last.first or f.start > last.start + last.n_words - 49)
            covered |= set(range(f.start, f.start + f.n_words))
            last = f
        assert len(covered) == row.n_removed


def test_near(spark, docs):
    found = near_dedup(table(spark, docs)).collect()
    want = brute.near(docs)
    assert {r[0]: (r[1], r[2]) for r in found} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


@pytest.mark.parametrize("sizes", [Sizes(), Sizes(8, 16, 8, 8, 6), Sizes(4, 8, 8, 4, 1)])
def test_near_in_split_nodes(spark, sizes):
    """Families of near copies around the threshold, larger than nodes may be; and pairs just above it."""
    r = random.Random(3)
    docs = []
    for copies, size in ((150, 200), (60, 90)):
        base = [f"w{r.randrange(5000)}" for _ in range(size)]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randint(0, size // 25)):
                w[r.randrange(size)] = f"x{r.randrange(10**6)}"
            docs.append(" ".join(w))
    for k in range(100):  # 5 of 104 and 5 of 114 shingles are others: 99 of 109 and so on down to 0.75
        w = [f"p{k}.{j}" for j in range(74 + k % 8)]
        docs += [" ".join(w), " ".join([*w[: len(w) // 2], "y", "y", "y", "y", "y", *w[len(w) // 2 :]])]
    rows = list(enumerate(docs))
    assert {x[0]: (x[1], x[2]) for x in near_dedup(table(spark, rows), sizes=sizes).collect()} == brute.near(rows)


def test_near_with_an_id_of_two_texts(spark):
    one, two = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(5, one), (5, two), (8, two), (9, two + " end"), (11, one + " end"), (5, two)]
    found = sorted(tuple(x)[:3] for x in near_dedup(table(spark, rows)).collect())
    assert found == [(5, 56, 5), (5, 56, 5), (5, 56, 5), (8, 56, 5), (9, 57, 5), (11, 57, 5)]


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact(spark, docs, keep):
    rows = [*docs, (None, docs[0][1]), docs[3], docs[3]]
    found = exact_dedup(table(spark, rows), keep=keep).collect()
    assert len(found) == len(rows)
    groups = {}
    for i, t in rows:
        if i is not None:
            groups.setdefault(t or "", []).append(i)
    want = sorted((i, None if i is None else (max if keep == "max" else min)(groups[t or ""]), 1 if i is None else len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows if i is not None)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found if r.doc_id is not None) == want
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.keep_id) for r in found)


def test_index_takes_batches(spark):
    """Further batches leave earlier runs as they are, until a level is full; filters spare the rest."""
    r, want = random.Random(8), {}
    ws = Workspace(spark, "test")
    index = DigestIndex(ws, "min", fan=3)
    files, numbers = {}, []

    def listed(run):
        return sorted((f, os.path.getmtime(f.removeprefix("file://"))) for f in run.entries.inputFiles() + run.filters.inputFiles())

    for k in range(4):
        batch = [(1000 * k + j, f"text {r.randrange(600)}") for j in range(400)]
        for i, t in batch:
            n, first = want.get(t, (0, i))
            want[t] = n + 1, min(first, i)
        df = spark.createDataFrame(batch, "id long, text string").select("id", sha256(F.col("text")).alias("digest"))
        if k == 1:
            found = {x.digest: (x.group_size, x.keep_id) for x in index.lookup(df).collect()}
            held = {hashlib.sha256(t.encode()).digest() for _, t in batch}
            assert found == {d: v for d, v in before.items() if d in held}  # noqa: F821
            probed = index.probe(df.select("digest", "id", F.lit(0).cast("long").alias("n")), F.lit(-1)).collect()
            assert len(probed) == 400 and all(x.claimed for x in probed if x.digest in before) and sum(x.claimed for x in probed if x.digest not in before) < 40  # noqa: F821
        index.add(df)
        for run in index.runs:
            if run.number in files:
                assert listed(run) == files[run.number]
            files[run.number] = listed(run)
        numbers.append([(run.number, run.level) for run in index.runs])
        entries = {x.digest: (x.group_size, x.keep_id) for x in index.entries().collect()}
        assert entries == {hashlib.sha256(t.encode()).digest(): v for t, v in want.items()}
        before = entries
    assert numbers == [[(0, 0)], [(0, 0), (1, 0)], [(3, 1)], [(3, 1), (4, 0)]]


def test_exact_with_a_weak_digest(spark, docs):
    strong, weak = (sorted(map(tuple, exact_dedup(table(spark, docs), digest=d).collect())) for d in (sha256, lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 1))))
    assert strong == weak
    assert keep_unique(table(spark, docs)).count() == len({t or "" for _, t in docs})


@pytest.mark.parametrize("partition", [16_384, 40])
def test_packing(spark, docs, partition):
    """Ids by the library itself; a valid packing; certified partitions cannot do better."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    pieces = pack_documents(table(spark, docs), BYTES, 256, partition_pieces=partition).collect()
    whole = {}
    for p in pieces:
        whole.setdefault(p.doc_id, []).append(p)
    assert whole.keys() == {i for i, _ in docs}
    for i, t in docs:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        ps = sorted(whole[i], key=lambda p: p.piece)
        assert [p.piece for p in ps] == list(range(len(ps))) and sum(p.length for p in ps) == len(ids)
        assert all(p.length == 256 for p in ps[1:]) and [p.start for p in ps] == [sum(q.length for q in ps[:k]) for k in range(len(ps))]
        assert [p.ids_crc32 for p in ps] == [zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) for p in ps]
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    least, _ = lower_bound(np.array([p.length for p in pieces]), 256)
    assert len(by_sequence) <= least + (2 if partition > 1000 else 4)
    if partition > 1000 and all(p.certified for p in pieces):
        assert len(by_sequence) == least


def test_partitions_with_gaps_exchange(spark):
    """Triples that fill a bin together, dealt to small partitions that best-fit decreasing leaves gaps in."""
    r = random.Random(5)
    lengths = []
    for _ in range(300):
        a, b = r.randint(20, 45), r.randint(20, 45)
        lengths += [a, b, 100 - a - b]
    r.shuffle(lengths)
    pieces = spark.createDataFrame(list(enumerate(lengths)), "row long, length long").repartition(3)
    found = pack(pieces, 100, partition_pieces=30, worth=0.0).collect()
    fill = {}
    for x in found:
        fill.setdefault(x.sequence_id, []).append((x.offset, lengths[x.row]))
    assert sorted(x.row for x in found) == list(range(900)) and all(sum(n for _, n in v) <= 100 for v in fill.values())
    alone = sum(int(best_fit_decreasing(np.array(lengths[k::30]), 100).max()) + 1 for k in range(30))
    assert 300 <= len(fill) < alone - 10


def test_pieces(spark, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = by_id(encode_decode(table(spark, docs), PIECES))
    for i, t in docs:
        ids = [library.bos_id(), *library.encode(t or ""), library.eos_id()]
        assert np.frombuffer(found[i][0], "<u4").tolist() == ids and found[i][1] == library.decode(ids)


def test_token_counts(spark, docs):
    encode = encoder(BYTES)
    edits = spark.createDataFrame([(i, [(0, 3, "New "), (10**9, 10**9, "!")]) for i, _ in docs if i % 2], "doc_id long, edits array<struct<at:long,until:long,new:string>>")
    found = by_id(count_tokens(table(spark, docs), edits, BYTES))
    for i, t in docs:
        t = t or ""
        assert found[i][0] == len(encode(t))
        assert found[i][1] == len(encode("New " + t[3:] + "!" if i % 2 else t))
    assert by_id(count_tokens(table(spark, docs), None, BYTES))[7][:2] == (0, 0)


def test_lines(spark):
    shared = [f"this is line number {k} of a shared block of text" for k in range(4)]
    rows = [(1, "\n".join(["first one has its own start", *shared, "and an end of its own"])), (2, "\n".join(["another start altogether", *shared])), (3, "\n".join(["another start altogether", *shared])), (4, None), (5, ""), (6, "short\nshort"), (7, "short\nshort other"), (8, "x" * 50_000)]
    found = by_id(line_dedup(table(spark, rows)))
    assert found[1] == (6, 0, 0, None) and found[2] == (5, 4, 1, "another start altogether")
    assert found[3] == (5, 5, 1, "") and found[4] == found[5] == (1, 0, 0, None)
    assert found[7][1] == 0 and found[8] == (1, 0, 0, None)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_lines_of_all_documents(spark):
    """Every line of a run that an earlier text holds goes; that is no less than one alignment with all earlier texts."""
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    by_run, by_partner = brute.lines(docs)
    found = {r.doc_id: r.n_removed for r in line_dedup(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r.doc_id in by_run}
    assert found == by_run and all(found[d] >= n for d, n in by_partner.items()) and sum(found.values()) > 200


def test_lines_that_repeat_and_move(spark):
    """Few different lines, in all orders: what blocks can be made of them, and a document id with two texts."""
    r = random.Random(6)
    line = [f"line {k} " + "x" * r.choice([5, 15, 30, 45, 70]) for k in range(12)]
    rows = [(k, "\n".join(r.choice(line) for _ in range(r.randint(1, 9)))) for k in range(60)]
    by_run, by_partner = brute.lines(rows)
    found = {x.doc_id: x.n_removed for x in line_dedup(table(spark, rows)).collect() if x.doc_id in by_run}
    assert found == by_run and all(found[d] >= n for d, n in by_partner.items())
    long = "a line of more than sixty characters, which stands in two of the texts"
    rows = [(1, "own\nother " + long), (1, long + "\nother"), (2, "its own\n" + long), (2, "its own\n" + long)]
    for _ in range(2):
        found = sorted(tuple(x) for x in line_dedup(table(spark, rows)).collect() if x.doc_id == 2)
        assert found == [(2, 2, 1, 1, "its own")] * 2


def test_lines_of_many_partners(spark):
    """A document put together from fourteen earlier ones: every part goes, however rare its line."""
    block = lambda k: [f"block {k}, line {n}, with words enough to be a line of its own" for n in range(2)]
    licence = "this licence line, of more than sixty characters, stands in very many of the documents"
    rows = [(k, "\n".join([f"the start of document {k}", *block(k)])) for k in range(14)]
    rows += [(50 + k, f"document {50 + k} has a start\n{licence}") for k in range(20)]
    rows += [(100, "\n".join(["its own first line", *(x for k in range(14) for x in block(k)), licence, "its own last line"]))]
    found = by_id(line_dedup(table(spark, rows)))
    assert found[100] == (31, 29, 15, "its own first line\nits own last line")
    assert found[50] == (2, 0, 0, None) and all(found[51 + k] == (2, 1, 1, f"document {51 + k} has a start") for k in range(19))


def test_ragged_embeddings(spark, tmp_path):
    """Files of different vector lengths: one length counts for the table, whatever a batch holds."""
    spark.createDataFrame([(k, [1.0, k / 100, 0.0]) for k in range(20)], "vec_id long, embedding array<double>").coalesce(1).write.parquet(f"{tmp_path}/v/a")
    spark.createDataFrame([(100 + k, [1.0] * 4) for k in range(11)], "vec_id long, embedding array<double>").coalesce(1).write.parquet(f"{tmp_path}/v/b")
    got = by_id(embedding_dedup(spark.read.parquet(f"{tmp_path}/v/a", f"{tmp_path}/v/b")))
    assert all(got[100 + k] == (0, 100 + k, True) for k in range(11)) and all(got[k] == (19, 0, k == 0) for k in range(20))


def test_embeddings_that_repeat(spark):
    """Ties at the threshold, repeated rows and ids, rows without an id, huge and tiny components."""
    at = [0.9, (1 - 0.81) ** 0.5]
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.9, 0.5]), (3, at), (4, [1e300, 0.0]), (5, [0.0, 1e-300]), (None, [1.0, 0.0]), (1, [0.0, 1.0]), (6, [-1.0, 0.0])]
    ids = [i for i, _ in rows if i is not None]
    unit = np.array([np.array(v) / max(map(abs, v)) if max(map(abs, v)) > 1e100 or max(map(abs, v)) < 1e-100 else v for i, v in rows if i is not None])
    unit /= np.sqrt((unit * unit).sum(axis=1))[:, None]
    hit = unit @ unit.T >= 0.9
    links = hit.sum(axis=1) - 1
    label = brute.components(range(len(ids)), zip(*np.nonzero(hit), strict=True))
    smallest = {c: min(i for i, k in zip(ids, label, strict=True) if label[k] == c) for c in set(label.values())}
    found = embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = sorted((i, int(n)) for (i, _), n in zip([r for r in rows if r[0] is not None], links, strict=True))
    assert sorted((x.vec_id, x.n_links) for x in found if x.vec_id is not None) == want
    want = sorted((i, smallest[label[k]]) for k, i in enumerate(ids))
    assert sorted((x.vec_id, x.component_id) for x in found if x.vec_id is not None) == want
    assert [(x.n_links, x.component_id, x.kept) for x in found if x.vec_id is None] == [(0, None, True)]


@pytest.mark.parametrize("block_bytes", [16 << 20, 1000])
def test_embeddings(spark, block_bytes):
    r = np.random.default_rng(4)
    base = r.normal(size=(60, 6))
    x = np.concatenate([base, base[:20] + r.normal(size=(20, 6)) * 0.1, base[:5], base[5:8] * 3])
    rows = [(int(i), v.astype(float).tolist()) for i, v in enumerate(x)]
    odd = [(900, None), (901, []), (902, [0.0] * 6), (903, [float("nan")] * 6), (904, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (905, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows + odd], "vec_id long, embedding array<double>, id string, unit int")
    got = by_id(embedding_dedup(df, block_bytes=block_bytes))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hit = unit @ unit.T >= 0.9
    np.fill_diagonal(hit, False)
    comp = brute.components(range(len(x)), zip(*np.nonzero(hit), strict=True))
    for i in range(len(x)):
        assert got[i] == (int(hit[i].sum()), comp[i], comp[i] == i)
    for i, _ in odd:
        assert got[i] == (0, i, True)


def test_urls(spark):
    rows = [(1, "http://M.Example.ORG/es/1?x=/en/1#a"), (2, None), (3, "no scheme"), (4, "https://a.com?q=1/fr/"), (5, "http://x.com/fr/1"), (6, "http:///p"), (7, "http://x.com/fr/1")]
    df = spark.createDataFrame([(i, u, "clash") for i, u in rows], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(df, [("org", "/", "allow"), ("example.org", "/es/", "block"), ("com", "/fr/", "block")]).collect()}
    assert got[1] == ("m.example.org", "/es/1", "example.org/es/", "block")
    assert got[2] == got[3] == ("", "", None, "allow") and got[4] == ("a.com", "", None, "allow")
    assert got[5] == got[7] == ("x.com", "/fr/1", "com/fr/", "block") and got[6] == ("", "/p", None, "allow")
    assert filter_urls(df, []).where("verdict = 'allow'").count() == 7


def test_toxicity(spark):
    r = random.Random(2)
    plain = lambda: " ".join("".join(r.choice("abcdeghilnorst") for _ in range(r.randint(2, 7))) for _ in range(r.randint(5, 60)))
    rows, labels = [], []
    for i in range(240):
        bad = i % 6 == 0
        text = plain()
        if bad:
            at = r.randrange(len(text))
            text = f"{text[:at]} {r.choice(['zquork', 'vlimpf'])} {text[at:]}"
        rows.append((i, text))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, plain() + " z-q.u_ork"), (1003, "z" * 20_000)]
    labelled = spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, toxic int")
    model = train(table(spark, rows), labelled.where("doc_id % 4 <> 2 or doc_id is null"))
    got = {i: s[0] for i, s in by_id(score(table(spark, rows), model)).items()}
    held = [(i, t) for i, t in labels if i % 4 == 2]
    assert sum((got[i] >= 0.3) == bool(t) for i, t in held) >= 0.97 * len(held)
    assert all(0 <= s <= 1 for s in got.values()) and got[1000] == got[1001] < 0.3 and got[1003] < 0.3
    assert got[1002] > got[1001]
    empty = train(table(spark, []), spark.createDataFrame([], "doc_id long, toxic int"))
    assert score(table(spark, rows[:3]), empty).count() == 3


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
@pytest.mark.parametrize(("sf", "recall", "wrong"), [("sf0.01", 0.4, 0.03), ("sf0.1", 0.85, 0.02)])
def test_toxicity_of_held_out_documents(spark, sf, recall, wrong):
    held = op10_toxicity(spark, f"/root/testdata/{sf}").where("held_out").join(spark.read.parquet(f"/root/testdata/{sf}/labels.parquet"), "doc_id").collect()
    toxic = [x.predicted for x in held if x.toxic == 1]
    clean = [x.predicted for x in held if x.toxic == 0]
    assert np.mean(toxic) >= recall and np.mean(clean) <= wrong


def test_toxicity_of_odd_tables(spark):
    """Labels that repeat or disagree, repeated rows, rows without an id."""
    rows = [(1, "a zquork b"), (1, "a zquork b"), (2, "plain words"), (None, "a zquork"), (3, "zquork then"), (4, "more plain words")]
    labels = spark.createDataFrame([(1, 0), (1, 1), (3, 1), (3, 1), (2, 0), (4, 0), (None, 1)], "doc_id long, toxic int")
    found = score(table(spark, rows), train(table(spark, rows), labels)).collect()
    assert len(found) == len(rows) and all(0 <= x.score <= 1 for x in found)
    assert len({x.score for x in found if x.doc_id == 1}) == 1
    again = score(table(spark, rows), train(table(spark, rows[::-1]).repartition(3), labels.repartition(2))).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))


EMPTY = {
    "exact": exact_dedup,
    "near": near_dedup,
    "substring": substring_dedup,
    "lines": line_dedup,
    "packing": lambda d: pack_documents(d, BYTES),
    "pieces": lambda d: encode_decode(d, PIECES),
    "counts": lambda d: count_tokens(d, None, BYTES),
    "embeddings": lambda d: embedding_dedup(d.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0)).alias("embedding"))),
    "urls": lambda d: filter_urls(d.withColumnRenamed("text", "url"), [("com", "/", "block")]),
}


@pytest.mark.parametrize("name", EMPTY)
def test_empty_table(spark, name):
    assert EMPTY[name](table(spark, [])).count() == 0


@pytest.mark.parametrize("name", EMPTY)
def test_repeated_rows_and_missing_ids(spark, name):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other text"), (None, "a b c d e f"), (None, None), (2, "a b c d e f")]
    found = EMPTY[name](table(spark, rows))
    assert found.count() == len(rows)
