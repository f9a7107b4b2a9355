"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quirefold.llm import bpe, crosspolytope, decontaminate, language, licenses, minhash, quality, secrets, tokenfiles, urls
from quirefold.llm.scratch import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(modulus: int, rest: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == rest, F.lit(False))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = tokenfiles.write(_table(spark, sf_dir, "documents"), Scratch(spark, "token-files"), "segments", public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return tokenfiles.digests(segments)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = _held_out(5, 0)
    model = language.fit(docs.where(~held_out))
    return language.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = _held_out(3, 1)
    return quality.score(docs.select("doc_id", held_out.alias("held_out"), "text"), quality.fit(docs, labels.where(~held_out)))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents")).drop("places")
    return found.withColumn("score", F.round("score", 6))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op10_crosspolytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspolytope.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), least=0.98)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_files, op2_decontaminate, op3_language_id, op4_quality, op5_licenses, op6_bpe, op7_url_filter, op8_minhash, op9_secrets, op10_crosspolytope)}


#: Shared shingles of all pairs of texts.
_NEAR_TEXTS = """
WITH RECURSIVE texts AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0d]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM texts),
shingles AS (SELECT doc_id, unnest(s) AS s FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT p.a, p.b FROM shared p JOIN sets x ON x.doc_id = p.a JOIN sets y ON y.doc_id = p.b WHERE 100 * p.n >= 85 * (len(x.s) + len(y.s) - p.n)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(low.b, doc_id)) AS component_id, least(doc_id, coalesce(low.b, doc_id)) = doc_id AS kept FROM sets LEFT JOIN low ON low.a = doc_id"""

#: Cosines of all pairs of a label.
_NEAR_VECTORS = """
WITH RECURSIVE fine AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, e.b FROM reach r JOIN links e ON e.a = r.b),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(low.b, vec_id)) AS component_id, least(vec_id, coalesce(low.b, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN low ON low.a = vec_id LEFT JOIN counts ON counts.a = vec_id"""


def oracle_sql() -> dict[str, str]:
    return {"op5_licenses": licenses.oracle(), "op7_url_filter": urls.ORACLE, "op8_minhash": _NEAR_TEXTS, "op10_crosspolytope": _NEAR_VECTORS}
