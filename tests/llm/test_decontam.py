import hashlib
import random
import re

import pytest

from quittance.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows, items):
    found = []
    cut = []
    for item, text in items:
        w = WORD.findall(lower(text or ""))
        if w:
            cut += [(item, w[i : i + 10]) for i in range(max(1, len(w) - 9))]
    for r in rows:
        w = WORD.findall(lower(r[1] or ""))
        hit, ids = set(), set()
        for item, g in cut:
            for i in range(len(w) - len(g) + 1):
                if w[i] == g[0] and w[i : i + len(g)] == g:
                    hit.update(range(i, i + len(g)))
                    ids |= {str(item)} if item is not None else set()
        found.append((r[0], len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(found, key=str)


NAMES = ["doc.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def test_against_brute_force(docs, bench, rows, bench_rows):
    got = sorted(map(tuple, decontam.contamination(docs, bench).select(*NAMES).collect()), key=str)
    assert got == brute(rows, bench_rows)
    assert sum(r[-1] for r in got) >= 4


def test_empty_tables(docs, no_docs, bench, rows):
    assert decontam.contamination(no_docs, bench).count() == 0
    none = decontam.contamination(docs, bench.where("false"))
    assert none.count() == len(rows) and none.where("contaminated").count() == 0


def test_proximity(spark):
    d = spark.createDataFrame([(1, "alpha x beta gamma"), (2, "alpha x x x beta gamma"), (3, "gamma beta alpha")], "doc_id long, text string")
    i = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    got = {r.doc["doc_id"]: len(r.hits) for r in decontam.search(d, i, slop=1).collect()}
    assert got[1] > 0 and got[2] == 0
    assert all(len(r.hits) == 0 for r in decontam.search(d, i).collect())


@pytest.mark.parametrize("slop", [1, 2])
def test_proximity_against_brute_force(spark, slop):
    """Each word up to slop from its place, the rarest too; 'b a c d' for one, with a or b rarest."""
    rng = random.Random(slop)
    texts = ["b a c d", "b b b a c d", "a a a b c d", "x b a c d", "d c b a", "c"]
    texts += [" ".join(rng.choice("abcdx") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    items = ["a b c d", "b a", "c", "d x a", "a a b"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    i = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = set()
    for n, text in enumerate(texts):
        w = text.split()
        for m, item in enumerate(items):
            g = item.split()
            for s in range(len(w) + slop):
                if all(g[k] in w[max(s + k - slop, 0) : s + k + slop + 1] for k in range(len(g))):
                    want.add((n, s, str(m)))
    got = {(r.doc["doc_id"], s, x) for r in decontam.search(d, i, slop=slop).collect() for h in r.hits for s in h["starts"] for x in h["items"]}
    assert got == want and (0, 0, "0") in got


def test_other_columns_stay(docs, bench):
    assert decontam.contamination(docs, bench).select("doc.*").columns == docs.columns


def test_repeated_rows_are_searched_once(spark, bench_rows):
    """Equal rows share their candidates: as many as one row has, not the cube of the copies."""
    items = spark.createDataFrame(bench_rows[:1], "item_id long, text string")
    rows = [(1, f"before {bench_rows[0][1]} after")] * 300 + [(None, bench_rows[0][1])] * 50
    d = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = decontam.phrases(items)
    assert decontam.candidates(decontam.build_index(d), wanted).count() == 2 * wanted.count()
    got = sorted(map(tuple, decontam.contamination(d, items).select(*NAMES).collect()), key=str)
    assert got == brute(rows, bench_rows[:1])


@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_phrase_of_all_items(spark, monkeypatch, sent):
    """A header that all items share, with phrases shuffled and sent."""
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", sent)
    head = "answer this question with one of the letters below now please"
    items = [(n, f"{head} number{n} and{n}") for n in range(200)]
    rows = [(0, f"x {head} y {head}"), (1, items[3][1]), (2, "no such header"), (3, None), (4, "")]
    got = decontam.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.select(*NAMES).collect()), key=str) == brute(rows, items)
