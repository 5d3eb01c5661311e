"""A training-data pipeline over ``documents``: filter, three kinds of dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and is
written as Parquet before the next one reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomlog.llm.exact_dedup import exact_dedup
from fathomlog.llm.near_dedup import near_dedup
from fathomlog.llm.packing import pack_documents
from fathomlog.llm.substring_dedup import substring_dedup
from fathomlog.llm.toxicity import THRESHOLD, train, with_scores
from fathomlog.llm.workspace import Workspace

ROW, KEY = "__row", "__key"


def _rows(docs: DataFrame, key: Column, least: bool = False) -> DataFrame:
    """``docs`` with ROW and KEY, which tell rows apart but for copies of id and text.

    ROW is the id; a row without one gets a number by its text beyond all ids (below them if
    ``least``), so that it takes part as the last of all documents.
    """
    number = F.lit(1 << 62) + F.pmod(F.xxhash64(_text()), F.lit(1 << 60))
    return docs.withColumns({ROW: F.coalesce(F.col("doc_id").cast("long"), -number if least else number), KEY: key})


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored below the threshold; learned from the labels of three folds of four.

    Each row is judged by its own text, whatever its id; empty and null texts stay.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold != 2))
    return with_scores(docs, model, score_col="__score").where((F.col("__score") < THRESHOLD) | (_text() == "")).drop("__score")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id; one of rows that repeat it. Rows without an id come last."""
    rows = _rows(docs, F.sha2(_text(), 256), least=True)
    kept = exact_dedup(rows, ROW).where("kept").select(ROW, F.col("text_sha256").alias(KEY)).distinct()
    return rows.hint("merge").join(kept, [ROW, KEY], "left_semi").dropDuplicates([ROW, KEY]).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents, the one with the smallest id; rows without an id come last.

    Rows that repeat an id with other texts are judged each by its own component.
    """
    rows = _rows(docs, F.xxhash64(_text()))
    kept = near_dedup(rows, ROW).where("kept").select(ROW, F.col("text_key").alias(KEY)).distinct()
    return rows.hint("merge").join(kept, [ROW, KEY], "left_semi").select(*docs.columns)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one has; n_chars follows the text.

    Rows without an id are later than all others; texts that stay whole, null ones among them, are as they were.
    """
    rows = _rows(docs, F.xxhash64(_text()))
    cut = substring_dedup(rows, id_col=ROW).where("n_removed > 0").select(ROW, F.col("text_key").alias(KEY), "kept_text").dropDuplicates([ROW, KEY])
    out = rows.hint("merge").join(cut, [ROW, KEY], "left")
    n_chars = F.when(F.col("kept_text").isNull(), F.col("n_chars")).otherwise(F.length("kept_text").cast("long"))
    return out.withColumns({"text": F.coalesce("kept_text", "text"), "n_chars": n_chars}).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens; every row is a document, with an id or not."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("near_dedup", near), ("substring_dedup", substring), ("best_fit_packing", packing)]

#: SQL can express neither the classifier nor the packing; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, of ``documents``."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = ws.write(docs, name)
            if k:
                ws.drop(STAGES[k - 1][0])
    return docs
