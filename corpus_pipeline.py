"""A training-data pipeline: five of the operators in a row, each stage written and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quirefold.llm import bpe, decontaminate, language, minhash, secrets
from quirefold.llm.scratch import Scratch

#: The last stage runs in executors whose heaps the others have filled, so it keeps fewer encoded pieces than op 6 does.
KEPT_PIECES = 120_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts foreign to all languages that the labelled rows teach (``language.Pairs``)."""
    names = docs.columns
    inner = docs.toDF(*(n if n == "text" else f"__{i}" for i, n in enumerate(names)))  # no column clashes with the predictions
    judged = language.predict(inner, language.fit(docs), keep_text=True, open_set=True)
    return judged.where(F.col("lang_pred") != "und").select(*inner.columns).toDF(*names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five words, 0.8): the one with the smallest id.

    Rows without an id and rows that share one are told apart by a hash of id and text, so that each is judged by its
    own text; such rows rank behind those with an id of their own, and of equal id and text one stays.
    """
    scratch, names = Scratch(spark, "near-dedup"), docs.columns
    inner = docs.toDF(*(n if n in ("doc_id", "text") else f"__{i}" for i, n in enumerate(names)))
    repeated = scratch.save(inner.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id", F.lit(True).alias("__odd")), "repeated")
    some = not repeated.isEmpty()
    if some:
        told = inner.join(repeated.withColumnRenamed("doc_id", "__id"), F.col("doc_id").eqNullSafe(F.col("__id")), "left").drop("__id")
        keyed = told.withColumn("__key", F.when(F.col("__odd"), F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))).otherwise(F.col("doc_id").cast("long")))
        keyed = scratch.save(keyed, "keyed")
    else:
        keyed = inner.withColumn("__key", F.col("doc_id").cast("long"))
    judged = scratch.save(minhash.near_duplicates(keyed.select(F.col("__key").alias("doc_id"), "text")).select("doc_id", "kept"), "judged")
    kept = keyed.join(judged.where("not kept").select(F.col("doc_id").alias("__key")), "__key", "left_anti")
    if some:
        kept = kept.where("__odd is null").unionByName(kept.where("__odd").dropDuplicates(["__key"]))
    return kept.select(*inner.columns).toDF(*names)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets; ``n_chars`` follows the new text."""
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, pieces=KEPT_PIECES)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("byte_bpe", byte_bpe),
]

#: Learned models and bucket hashing are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch, before = Scratch(spark, "pipeline"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, name)
            if before:
                scratch.drop(before)
            before = name
    return docs
