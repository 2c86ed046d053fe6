"""run() against brute force on a small table."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from quittance.llm import language
from test_decontam import brute as contaminated
from test_simhash import brute as components


def test_stages(spark, tmp_path, docs, bench, rows, bench_rows):
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    bench.coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    sf = str(tmp_path)
    start = spark.read.parquet(f"{sf}/documents.parquet")
    now, columns = start, start.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == columns
            now.write.parquet(f"{sf}/{name}")
            now = spark.read.parquet(f"{sf}/{name}")
        seen.append([tuple(r) for r in now.collect()])
    told = Counter(tuple(r) for r in language.recognised(start, language.train(start)).collect())
    assert Counter(seen[0]) == told
    assert sorted(r[0] for r in seen[1] if r[0] is not None) == sorted({c for _, _, c in components(seen[0]) if c is not None})
    bad = {(x[0]) for x in contaminated(seen[1], bench_rows) if x[-1] and x[0] is not None}
    assert sorted(str(r[0]) for r in seen[2]) == sorted(str(r[0]) for r in seen[1] if r[0] not in bad)
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    had, got = defaultdict(int), defaultdict(int)
    for r in seen[2]:
        had[r[3]] += size(r)
    for r in seen[3]:
        got[r[3]] += size(r)
    assert set(seen[3]) <= set(seen[2]) and max(Counter(seen[3]).values()) <= 2
    assert abs(sum(got.values()) - 1.5 * sum(had.values())) <= len(had) * max(map(size, seen[2]))
    assert len(seen[4]) == len(seen[3])
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, now.collect()))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def stages(spark, folder, rows, items):
    """doc_ids after each stage."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    now, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(folder)).write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
        out.append([r.doc_id for r in now.select("doc_id").collect()])
    return out


def test_no_documents(spark, tmp_path):
    assert stages(spark, tmp_path, [], [(1, "some words of an item")]) == [[]] * 5


def test_no_language_is_known(spark, tmp_path):
    rows = [(i, f"plain words number {i} and more of them", None, "s", 0) for i in range(20)]
    assert stages(spark, tmp_path, rows, [(1, "other words")]) == [[]] * 5


def test_no_benchmark(spark, tmp_path, rows):
    """Nothing is contaminated by an empty benchmark; a null text doesn't get past the first stage."""
    mine = [(*r[:4], 0) for r in rows if r[0] is not None]
    out = stages(spark, tmp_path, mine, [])
    assert out[0] and set(out[0]) < {r[0] for r in mine} and Counter(out[2]) == Counter(out[1]) and len(out[4]) == len(out[3])
    assert not {r[0] for r in mine if not r[1]} & set(out[0])
