import gc
import zlib
from io import BytesIO

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quittance.llm import tokencount, tokenio, tokens
from quittance.llm.tokens import encoder, tokenizer_path

NAME = "byte_bpe_50k.json"
PLAIN = Tokenizer.from_file(tokenizer_path(NAME))


@pytest.fixture(scope="module")
def plain():
    return PLAIN


def ids_of(plain, text):
    return plain.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab é\n\t ,.'s<|endoftext|>1漢  \x1c😀"), max_size=60), min_size=1, max_size=4))
def test_pieces_encode_as_whole_texts(texts):
    got = [np.frombuffer(p, "<u4").tolist() for p in encoder(tokenizer_path(NAME)).packed(texts)]
    assert got == [ids_of(PLAIN, t) for t in texts]


def test_files_round_trip(docs, rows, plain):
    got = sorted(map(tuple, tokenio.token_output(docs).collect()), key=lambda r: r[1])
    assert len(got) == len(rows)
    at = 0
    for doc_id, start, n, _ in got:
        assert start == at
        at += n
    assert [r[0] is None for r in got] == sorted((r[0] is None for r in got), reverse=True)
    known = [r[0] for r in got if r[0] is not None]
    assert known == sorted(known)
    want = sorted((str(r[0]), len(x := [*ids_of(plain, r[1]), 0]), zlib.crc32(np.array(x, "<u4").tobytes())) for r in rows)
    assert sorted((str(r[0]), r[2], r[3]) for r in got) == want


@pytest.mark.parametrize("bits", [False, True])
def test_rolling_files(spark, monkeypatch, tmp_path, rows, docs, plain, bits):
    """Many small files of a part, byte and bit planes, and what a lost attempt left."""
    monkeypatch.setattr(tokenio, "FILE_IDS", 3000)
    monkeypatch.setattr(tokenio, "FILE_DOCS", 5)
    path = str(tmp_path / "planes")
    (tmp_path / "planes").mkdir()
    (tmp_path / "planes" / "_part-00000-00000-99").write_bytes(b"cut")
    files = tokenio.write_ids(docs, path, tokenizer_path(NAME), bits=bits, block=512)
    got = sorted(map(tuple, tokenio.read_digests(files, path).collect()), key=lambda r: r[1])
    assert max(f.n_docs for f in files.collect()) == 5 and files.count() > len(rows) // 5
    assert sorted(p.name for p in (tmp_path / "planes").iterdir()) == sorted(f.file for f in files.collect())
    want = sorted((str(r[0]), len(x := [*ids_of(plain, r[1]), 0]), zlib.crc32(np.array(x, "<u4").tobytes())) for r in rows)
    assert sorted((str(r[0]), r[2], r[3]) for r in got) == want
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()


def test_kept_pieces_are_bounded(monkeypatch, plain):
    """Long pieces aren't kept, many short ones only up to the bytes of two generations; ids stay right."""
    monkeypatch.setattr(tokens, "KEPT_BYTES", 20_000)
    enc = tokens.Encoder(tokenizer_path(NAME))
    for i in range(0, 2000, 100):
        texts = [f"w{j} x{j * 7} {'ab9' * 40}{j} line\nhead{j} end" for j in range(i, i + 100)]
        assert [np.frombuffer(p, "<u4").tolist() for p in enc.packed(texts)] == [ids_of(plain, t) for t in texts]
        assert max(map(len, [*enc.pieces, *enc.old, *enc.heads])) <= tokens.KEPT_CHARS
        assert len(enc.pieces) + len(enc.old) + len(enc.heads) < 1500


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [0, 1, 7, 1000, 5000])
def test_planes(n, bits):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
    assert (tokenio.from_planes(tokenio.to_planes(ids, bits), n) == ids).all()
    sink = BytesIO()
    w = tokenio.PlaneWriter(sink, bits, 512)
    w.add(1, ids.tobytes())
    w.add(None, ids[: n // 2].tobytes())
    w.close()
    r = tokenio.PlaneReader(sink, sink.tell())
    assert r.doc_ids.to_pylist() == [1, None] and r.counts.tolist() == [n, n // 2]
    assert (r.ids(n, n // 2) == ids[: n // 2]).all() and (r.ids(0, n) == ids).all()


def test_broken_file():
    with pytest.raises(ValueError, match="plane file"):
        tokenio.PlaneReader(BytesIO(bytes(80)), 80)


@pytest.mark.parametrize("name", [NAME, "piece_bpe_32k.model", "word_bpe_49k.json"])
def test_counts(docs, rows, name):
    enc = encoder(tokenizer_path(name))
    if name.endswith(".json"):
        t = Tokenizer.from_file(tokenizer_path(name))
        count = lambda s: len(t.encode(s, add_special_tokens=False).ids)
    else:
        count = lambda s: len(enc.encode([s])[0])
    got = sorted(map(tuple, tokencount.token_counts(docs, name).collect()), key=str)
    assert got == sorted(((r[0], len((r[1] or "").encode()), count(r[1] or "")) for r in rows), key=str)


def test_cache_is_used(spark, docs, tmp_path):
    cache = str(tmp_path / "cache")
    first = sorted(map(tuple, tokencount.token_counts(docs, NAME, cache).collect()), key=str)
    stored = spark.read.parquet(cache)
    n = stored.count()
    assert n == stored.select("digest").distinct().count()
    assert sorted(map(tuple, tokencount.token_counts(docs, NAME, cache).collect()), key=str) == first
    assert spark.read.parquet(cache).count() == n


def test_query_hits_its_cache(spark, tmp_path, docs):
    """A second run over the same and more documents encodes only the new ones."""
    docs.limit(40).coalesce(1).write.parquet(str(tmp_path / "a" / "documents.parquet"))
    docs.coalesce(1).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    key = lambda df: sorted(map(str, df.collect()))
    first = key(tokencount.op7_token_counts(spark, str(tmp_path / "a")))
    both = key(tokencount.op7_token_counts(spark, str(tmp_path / "b")))
    cache = f"{tokencount.shared_dir(spark)}/token-counts/{tokencount.tokenizer_version(tokenizer_path(NAME))}"
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count()
    assert set(first) <= set(both) == {str(r) for r in both}
    assert key(tokencount.op7_token_counts(spark, str(tmp_path / "b"))) == both


def test_empty(no_docs):
    assert tokenio.token_output(no_docs).count() == 0 and tokencount.token_counts(no_docs).count() == 0


def test_batches_of_texts_are_bounded_by_rows_and_bytes(monkeypatch):
    monkeypatch.setattr(tokens, "BATCH_TEXTS", 3)
    monkeypatch.setattr(tokens, "BATCH_BYTES", 10)
    texts = ["a" * 11, "b" * 4, None, "c" * 6, "d", "", "e", "f", "g" * 30]
    cut = [b.column("text").to_pylist() for b in tokens.in_batches(pa.record_batch([pa.array(texts)], ["text"]))]
    assert cut == [texts[:1], texts[1:4], texts[4:7], texts[7:8], texts[8:]]
    assert not list(tokens.in_batches(pa.record_batch([pa.array([], pa.string())], ["text"])))


def test_encoding_keeps_the_collector_off(monkeypatch):
    """No collection goes through the lists of pieces; afterwards the collector runs as before."""
    enc, seen = tokens.Encoder(tokenizer_path(NAME)), []
    monkeypatch.setattr(enc, "_after_spaces", lambda new, f=enc._after_spaces: [seen.append(gc.isenabled()), f(new)][1])
    enc.packed([f"one {i} two three{i}" for i in range(50)])
    assert seen == [False] and gc.isenabled()
