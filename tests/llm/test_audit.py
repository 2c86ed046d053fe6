import re
from itertools import permutations

import numpy as np
import pytest

from quittance.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failing(text):
    w = WORD.findall(text)
    bits = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text))]
    return {f for f, b in zip("ABCD", bits, strict=True) if b}


def brute(rows, labels):
    """Apply every order step by step."""
    least = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            least[text or ""] = min(least.get(text or "", doc_id), doc_id)
    good, toxic = ({d for d, *x in labels if d is not None and x[i] == 1} for i in (0, 1))
    docs = []
    for doc_id, text, _, source, *_ in rows:
        fails = failing(text or "") | ({"E"} if doc_id is not None and doc_id > least[text or ""] else set())
        docs.append((source or "", fails, doc_id in good, doc_id in toxic))
    out = []
    for part in {d[0] for d in docs}:
        mine, steps = [d for d in docs if d[0] == part], []
        for order in permutations("ABCDE"):
            left = mine
            for s, f in enumerate(order, 1):
                gone, left = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
                steps.append((f, ["".join(order), s, len(left), len(gone), sum(f in d[1] for d in mine) - len(gone), sum(d[1] == {f} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)]))
        shapley = {f: sum(x[3] for g, x in steps if g == f) for f in "ABCDE"}
        out += [(part, *x, shapley[f]) for f, x in steps]
    return sorted(out)


LABELS = "doc_id long, quality int, toxic int, text string, mask int"


def run(docs, labels):
    return sorted(tuple(r) for r in audit.interactions(docs, labels).select("part", "filter_order", "step", *audit.COUNTS).collect())


def test_against_brute_force(spark, docs, rows):
    labels = [(i, i % 2, i % 3 % 2, "clash", 1) for i in range(0, 100, 3)] + [(3, 1, 1, None, None), (5, None, 1, None, None), (None, 1, 1, None, None), (10**9, 1, 1, None, None)]
    assert run(docs, spark.createDataFrame(labels, LABELS)) == brute(rows, [x[:3] for x in labels])


def test_copies_of_one_text(spark):
    """A third of all rows share a text, in several sources, with repeated rows of the smallest doc_id."""
    rows = [(1000 - i, "same words " * 30, None, f"s{i % 3}") for i in range(300)] + [(701, "same words " * 30, None, "s1")] * 2 + [(i, f"text {i} " * 40, None, "s0") for i in range(600)]
    rows += [(None, "same words " * 30, None, "s2"), (5000, None, None, None), (5001, "", None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(7)
    assert run(docs, spark.createDataFrame([], LABELS)) == brute(rows, [])


def test_more_parts_than_are_held(spark, monkeypatch):
    monkeypatch.setattr(audit, "AT_ONCE", 3)
    rows = [(i, "WORD # " * (i % 70) + f"{i}", None, f"s{i % 11}") for i in range(80)]
    assert run(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame([(1, 1, 0, "", 0)], LABELS)) == brute(rows, [(1, 1, 0)])


def test_no_rows(spark, no_docs):
    assert run(no_docs, spark.createDataFrame([], LABELS)) == []


def test_table():
    assert audit.FIRST.shape == (32, 120) and (audit.FIRST[0] == 6).all() and (np.sort(np.unique(audit.FIRST[31])) == [1]).all()


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 64])
def test_pieces(monkeypatch, rows, piece):
    """Cutting a text anywhere changes nothing, not inside words, at spaces or inside a character."""
    monkeypatch.setattr(audit, "PIECE", piece)
    for _, text, *_ in rows:
        if text and len(text) < 3000:
            assert audit.conditions(text.encode()) == sum(1 << "ABCD".index(f) for f in failing(text)), text
