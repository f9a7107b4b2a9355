import random

import corpus_pipeline as cp
from pyspark.sql import functions as F

SYLLABLES = ["ka", "lo", "mu", "tii", "ny", "vak", "sto", "hyy", "poj", "kku", "lla", "ssa", "jo", "rve", "uo"]


def words(r, parts, low, high, n):
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(low, high))) for _ in range(n))


def kept(spark, sf_dir, docs):
    return {r.doc_id for r in cp.language_id(spark, docs, sf_dir).select("doc_id").collect()}


def test_a_fifth_language_and_junk_go_and_known_languages_stay(spark, sf_dir):
    r = random.Random(5)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    fifth = [(-k, words(r, SYLLABLES, 2, 4, r.randint(15, 200)), None) for k in range(1, 61)]
    junk = [(-k, words(r, "abcdefghijklmnopqrstuvwxyz", 2, 9, r.randint(15, 200)), None) for k in range(101, 161)]
    got = kept(spark, sf_dir, docs.unionByName(spark.createDataFrame(fifth + junk, docs.schema)))
    assert not [i for i in got if i < 0]
    lettered = {x.doc_id for x in docs.where(F.rlike("text", F.lit("[A-Za-z]"))).collect()}
    assert len(lettered & got) >= 0.97 * len(lettered)


def test_a_left_out_language_goes(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    for name in ("en", "es"):
        left = {x.doc_id for x in docs.where((F.col("lang") == name) & (F.length("text") >= 64)).collect()}
        got = kept(spark, sf_dir, docs.withColumn("lang", F.when(F.col("lang") != name, F.col("lang"))))
        assert len(got & left) <= 0.05 * len(left) and len(got) >= 0.9 * docs.where(F.col("lang") != name).count()
