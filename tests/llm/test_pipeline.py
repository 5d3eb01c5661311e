"""The pipeline's stages against plain versions, one after the other."""

import random

import brute
import corpus_pipeline
import public_tokenizers
from test_operators import corpus

from fathomlog.llm.byte_tokens import encoder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, t if t is None or len(t) < 50_000 else t[:50_000]) for i, t in corpus(9)]
    toxic = {i for i, t in rows if t and len(t) > 100 and r.random() < 0.25}
    rows = [(i, f"{t} zquorkel {t[:30]} vlimpfy" if i in toxic else t) for i, t in rows]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i, t in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    have = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "substring_dedup", "best_fit_packing"]

    def stage(name, df):
        stages[name](spark, df, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    after = stage("toxicity", have)
    assert after.columns == COLUMNS
    kept = {x.doc_id: x.text for x in after.collect()}
    gone = {i for i, _ in rows} - kept.keys()
    assert len(gone & toxic) >= 0.9 * len(toxic) and len(gone - toxic) <= 0.03 * len(rows)

    after = stage("exact_dedup", after)
    last: dict[str, int] = {}
    for i, t in kept.items():
        last[t or ""] = max(last.get(t or "", -1), i)
    assert after.columns == COLUMNS and {x.doc_id for x in after.collect()} == set(last.values())

    kept = {i: kept[i] for i in last.values()}
    after = stage("near_dedup", after)
    component = brute.near(list(kept.items()))
    assert after.columns == COLUMNS and {x.doc_id for x in after.collect()} == {i for i, (_, c) in component.items() if c == i}

    kept = {i: t for i, t in kept.items() if component[i][1] == i}
    after = stage("substring_dedup", after)
    want = brute.substring(list(kept.items()))
    found = {x.doc_id: x for x in after.collect()}
    assert after.columns == COLUMNS and found.keys() == kept.keys()
    for i, x in found.items():
        if want[i][1]:
            assert len(brute.words(x.text)) == want[i][0] - want[i][1] and x.n_chars == len(x.text)
        else:
            assert x.text == kept[i]

    pieces = stage("best_fit_packing", after).collect()
    encode = encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(p.length for p in pieces) == sum(len(encode(x.text or "")) + 1 for x in found.values())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(pieces)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def kept(spark, tmp_path, rows, stage):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, str(tmp_path))
    assert out.columns == COLUMNS or stage == "best_fit_packing"
    return sorted(((x.doc_id, getattr(x, "text", None)) for x in out.collect()), key=repr)


def test_rows_without_ids_and_repeated_ids(spark, tmp_path):
    r = random.Random(4)
    plain = lambda n: " ".join("".join(r.choice("abcdeghilnorst") for _ in range(r.randint(2, 7))) for _ in range(n))
    rows = [(i, plain(30) + (" zquorkel vlimpfy" if i % 4 == 0 else "")) for i in range(80)]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    clean, toxic = plain(20), plain(20) + " zquorkel vlimpfy"
    odd = [(None, toxic), (None, clean), (5, clean), (5, toxic), (5, clean), (6, None), (7, "")]
    assert kept(spark, tmp_path, odd, "toxicity") == sorted([(None, clean), (5, clean), (5, clean), (6, None), (7, "")], key=repr)
    one, two = plain(60), plain(60)
    copies = [(1, one), (9, one), (9, one), (None, one), (None, two), (None, two), (4, None), (3, ""), (9, "other")]
    assert kept(spark, tmp_path, copies, "exact_dedup") == sorted([(9, one), (None, two), (4, None), (9, "other")], key=repr)
    alike = [(2, one), (None, one + " end"), (None, two), (3, two + " end"), (3, one + " ends"), (8, None), (None, "")]
    assert kept(spark, tmp_path, alike, "near_dedup") == sorted([(2, one), (3, two + " end"), (8, None), (None, "")], key=repr)
    shared = [(2, f"a {one}"), (None, f"b {one} c"), (2, "short"), (None, None)]
    assert kept(spark, tmp_path, shared, "substring_dedup") == sorted([(2, f"a {one}"), (None, "b c"), (2, "short"), (None, None)], key=repr)
    assert [i for i, _ in kept(spark, tmp_path, shared, "best_fit_packing")] == [2, 2, None, None]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
