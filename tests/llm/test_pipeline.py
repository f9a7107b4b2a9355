import tiktoken
import public_tokenizers

import corpus_pipeline as cp
from quirefold.llm import bpe, secrets

KEY = "ed85aea7af91af30d358df8319c45ee8ae9f5135"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


def test_stages_in_order():
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "byte_bpe"]


def test_run_on_the_small_tables(spark, sf_dir):
    out = cp.run(spark, sf_dir).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = {r.doc_id for r in out}
    assert len(out) == len(ids) and ids < set(docs)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})
    for r in out:
        text = reference.decode(r.ids)
        assert r.n_tokens == len(r.ids) and (text == docs[r.doc_id].text or secrets.MASK in text)


def test_each_stage_handles_odd_rows(spark, sf_dir):
    passage = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    base = " ".join(f"word{i % 37} the of and" for i in range(60))
    rows = [(1, base, "en", "a", len(base), "x"), (2, base, "en", None, None, None), (2, base, "en", None, None, None), (3, None, None, "b", None, ""), (4, "", "fr", "", 0, ""), (5, "123 !!", "en", "", 6, ""),
            (6, f"{base[:200]} unlike {passage} others", "en", "", 1, ""), (None, "no id but some plain words stand here", "en", "", 1, ""), (8, f'keep this text: token = "{KEY}" and go on', "en", "", 1, "")]
    docs = spark.createDataFrame(rows, SCHEMA)

    def ids(df):
        assert df.columns == docs.columns
        return sorted((r.doc_id or -1) for r in df.collect())

    assert not {3, 4, 5} & set(ids(cp.language_id(spark, docs, sf_dir)))
    assert ids(cp.near_dedup(spark, docs, sf_dir)) == [-1, 1, 3, 4, 5, 6, 8]
    assert ids(cp.decontamination(spark, docs, sf_dir)) == [-1, 1, 2, 2, 3, 4, 5, 8]
    masked = cp.secret_scan(spark, docs, sf_dir)
    assert ids(masked) == [-1, 1, 2, 2, 3, 4, 5, 6, 8]
    eight = masked.where("doc_id = 8").first()
    assert KEY not in eight.text and secrets.MASK in eight.text and eight.n_chars == len(eight.text)
    assert cp.byte_bpe(spark, docs, sf_dir).count() == 9
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_repeated_and_null_ids_lose_only_copies(spark, sf_dir):
    one, two = (" ".join(f"{w}{i}" for i in range(80)) for w in ("alpha", "beta"))
    rows = [(1, one, "en", "a", 1, "x"), (2, one, "en", "a", 1, "x"), (2, two, "en", "b", 1, "x"), (2, two, "en", "b", 1, "x"), (None, two, "en", "c", 1, "x"), (None, "gamma delta", "en", "d", 1, "x"), (None, None, "en", "e", 1, "x"), (3, None, "en", "f", 1, "x")]
    kept = [(r.doc_id, r.text) for r in cp.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), sf_dir).collect()]
    assert len(kept) == len(set(kept)) == 5
    assert sum(t == one for _, t in kept) == 1 and sum(t == two for _, t in kept) == 1 and {(None, "gamma delta"), (None, None), (3, None)} <= set(kept)
