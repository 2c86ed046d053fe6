import re
from collections import defaultdict

from quittance.llm import mixing


def goal(sizes):
    """Targets by resharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: (total - sum(out.values())) * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        out |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    return out


def measure(docs):
    kept = mixing.drawn(docs)
    return mixing.copies(kept, mixing.plan(kept)).selectExpr("doc_id", "source", "size", "source_size", "target", "size * copies AS taken").collect()


def test_targets_and_sizes(docs, rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want, got, most = goal(sizes), defaultdict(int), defaultdict(int)
    out = measure(docs)
    assert len(out) == len(rows)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        got[r.source] += r.taken
        most[r.source] = max(most[r.source], r["size"])
    for s, t in want.items():
        assert abs(got[s] - t) <= most[s]


def test_reruns_agree(docs):
    key = lambda rs: sorted(map(tuple, rs), key=str)
    assert key(measure(docs)) == key(measure(docs.repartition(7)))


def test_mix_repeats_rows(docs):
    taken = sum(r.taken for r in measure(docs))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in mixed.collect()) == taken


def test_empty(no_docs):
    assert measure(no_docs) == [] and mixing.mix(no_docs).count() == 0


def test_clashing_columns_stay(spark):
    rows = [(i, "some words here", "s", 99, "t", 1.5, 7, 8, 3, 4, 5) for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, tie string, key double, cell int, sub int, copies int, target int, row int")
    assert set(map(tuple, mixing.mix(d).collect())) <= set(rows)
    assert mixing.mix(d).columns == d.columns


def test_low_weights_spread_over_cells(spark):
    """Texts without spaces, and weights near zero, don't pile up in a cell."""
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(i, "\u6f22\u5b57" * (50 + i % 7), "s") for i in range(3000)], "doc_id long, text string, source string")
    for weight in (None, F.lit(1e-9)):
        rows = mixing.drawn(d, weight)
        assert rows.groupBy("cell").count().agg(F.max("count")).first()[0] < 60
        taken = mixing.copies(rows, mixing.plan(rows)).selectExpr("sum(size * copies)").first()[0]
        assert abs(taken - 4500) <= 1


def test_source_without_words(spark):
    d = spark.createDataFrame([(1, None, "a"), (2, " ", "a"), (3, "x y z", "b")], "doc_id long, text string, source string")
    got = {r.doc_id: (r.target, r.taken) for r in measure(d)}
    assert got[1] == got[2] == (0.0, 0) and got[3][1] in (3, 6)
