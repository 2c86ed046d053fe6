import zlib

import numpy as np

from quittance.llm import language


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    out = language.identify(d, language.train(d)).join(d, "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert len(out) > 100
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_cases(docs, rows):
    model = language.train(docs)
    got = language.identify(docs, model).collect()
    assert len(got) == len(rows)
    text = {}
    for r in rows:
        text.setdefault(r[0], r[1])
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.lang_pred in ("en", "fr", "und")
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text[r.doc_id] or ""))


def test_lang_is_no_input(docs):
    from pyspark.sql import functions as F

    model = language.train(docs)
    key = lambda df: sorted(map(str, language.identify(df, model).collect()))
    assert key(docs) == key(docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None).cast("string")))


def test_codewords_differ():
    for n in (1, 2, 4, 9, 40):
        code = language.codewords(n)
        assert code.shape[0] == n and len({tuple(r) for r in code.tolist()}) == n or n == 1


def test_nothing_to_learn(docs, no_docs, rows):
    assert language.train(no_docs) is None
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}
    assert language.identify(no_docs, None).count() == 0


def test_recognised_keeps_clean_documents(docs, rows):
    kept = language.recognised(docs, language.train(docs))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert None in ids
    assert {r[0] for r in rows if r[1] is None or not any(map(str.isalpha, r[1]))} & ids == set()
