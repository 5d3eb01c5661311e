"""The registered query of each operator, over its whole table, and its SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .embedding_dedup import embedding_dedup
from .exact_dedup import exact_dedup
from .line_dedup import line_dedup
from .near_dedup import near_dedup
from .packing import pack_documents
from .piece_codec import encode_decode
from .substring_dedup import substring_dedup
from .token_counts import count_with_edits
from .toxicity import THRESHOLD, score, train
from .url_filter import filter_urls

#: Fixed values of the query contracts: rules of the URL filter.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(_table(spark, sf_dir, "embeddings"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "partners", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits of every document: a header in front, 16 characters in the middle out, one line at the end."""
    docs = _table(spark, sf_dir, "documents")
    n = F.length(F.coalesce("text", F.lit("")))
    header = F.concat_ws(" ", F.lit("lang:"), "lang", F.lit("source:"), "source", F.lit("\n"))
    middle = (n / 2).cast("long") + F.length(header)
    edits = [(F.lit(0), F.lit(0), header), (middle, middle + 16, F.lit("")), (F.lit(1 << 40), F.lit(1 << 40), F.lit("\nEnd of text."))]
    return count_with_edits(docs, edits, public_tokenizers.path("byte_bpe_50k.json"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = substring_dedup(_table(spark, sf_dir, "documents"))
    kept = F.when(F.col("kept_text").isNotNull(), F.sha2("kept_text", 256)).otherwise(F.col("words_sha256"))
    return parsed.select("doc_id", "n_words", "n_removed", kept.alias("kept_sha256"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = train(docs, _table(spark, sf_dir, "labels").where(fold != 2))
    scored = score(docs, model)
    return scored.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


OP5_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id,
       CAST(count(*) OVER (PARTITION BY text) AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text) AS kept,
       sha256(text) AS text_sha256
FROM t
"""

OP9_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(h, s, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (
  SELECT page_id, arg_max(h || s, length(h) * 10000 + length(s)) AS rule, arg_max(v, length(h) * 10000 + length(s)) AS verdict
  FROM q JOIN r ON (host = h OR host LIKE '%.' || h) AND starts_with(path, s) GROUP BY page_id)
SELECT q.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM q LEFT JOIN m ON q.page_id = m.page_id
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_embedding_dedup, op2_line_dedup, op3_piece_codec, op4_best_fit_packing, op5_exact_dedup, op6_token_counts, op7_near_dedup, op8_substring_dedup, op9_url_filter, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5_SQL, "op9_url_filter": OP9_SQL}
