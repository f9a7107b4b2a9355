import re
import time

from quirefold.llm import secrets as sec

KEY = "ed85aea7af91af30d358df8319c45ee8ae9f5135"


def test_many_candidates_in_one_text_take_linear_time(spark):
    """A text of about 2 MB with 50,000 candidates, some of them secrets, beside small ones."""
    parts = [f"{'token' if k % 100 == 0 else 'commit'} = {KEY[k % 20:]}{KEY[:k % 20]} " for k in range(50_000)]
    text = "".join(parts)
    df = spark.createDataFrame([(1, text, "src"), (2, f'password = "{KEY}"', "src")], "doc_id long, text string, source string")
    forest = sec.train(sec.default_findings(spark))
    began = time.time()
    got = {r.doc_id: r.findings for r in sec.found(df, forest).collect()}
    assert time.time() - began < 60
    assert [f.start for f in got[1]] == [m.start() for m in re.finditer(sec.CANDIDATE, text)]
    assert sum(f.secret for f in got[1]) >= 500 and all(got[1][k].secret for k in range(0, 50_000, 100))
    masked = {r.doc_id: r.text for r in sec.redact(df).collect()}
    assert len(masked[1]) == len(text) - sum(f.secret for f in got[1]) * (len(KEY) - len(sec.MASK))


def test_short_passwords_and_words_after_key_names(spark):
    secrets = ['password="hunter2!"', "password: Tr0ub4dor&3zzQ9", "pwd = x9$kQ2!z", "DB_PASSWORD=Summer2024!", 'secret: "qP7#vv9Lm"']
    plain = ["the password: required", "token: expired", 'password = "undefined"', "secret = settings.token", "password: ********", "one two three four"]
    df = spark.createDataFrame([(k, t, "src1") for k, t in enumerate(secrets + plain)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in sec.scan(df).collect()}
    assert [got[k].n_secrets for k in range(len(secrets))] == [1] * len(secrets)
    assert [got[len(secrets) + k].n_secrets for k in range(len(plain))] == [0] * len(plain)
    masked = {r.doc_id: r.text for r in sec.redact(df).collect()}
    assert masked[0] == f'password="{sec.MASK}"' and masked[1] == f"password: {sec.MASK}" and masked[3] == f"DB_PASSWORD={sec.MASK}"


def test_characters_beyond_the_basic_plane_keep_places(spark):
    text = f'\U0001f600\U0001f600 token = "{KEY}" \U0001f511 secret={KEY[::-1]}'
    df = spark.createDataFrame([(1, text, None)], "doc_id long, text string, source string")
    row = sec.scan(df).first()
    assert row.starts == [text.index(KEY), text.index(KEY[::-1])]


def test_planted_secrets_of_the_tables(spark):
    """Every ``token = "<hex>"`` planted in the documents is found, and hardly anything else."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    planted = {(r.doc_id, m.start(1)) for r in docs.collect() for m in re.finditer(r'(?i)token = "([0-9a-f]{32,})"', r.text or "")}
    found = {(r.doc_id, s) for r in sec.scan(docs).collect() for s in r.starts}
    assert planted and planted <= found and len(found - planted) <= 0.02 * docs.count()
