import math
import random
import re
from collections import Counter, defaultdict

import pytest

from quittance.llm import quality
from quittance.llm.common import stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n, inside = Counter(g), set()
    for i, x in enumerate(g):
        if n[x] > 1:
            inside |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), len(w) < 50 or 100 * len(inside) > 50 * len(w)


COLS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_against_brute_force(docs, rows):
    got = [tuple(r) for r in quality.judge(docs.select("doc_id", "text", "lang", "source")).select("doc_id", *COLS).collect()]
    assert sorted(got, key=str) == sorted(((r[0], *brute(r[1])) for r in rows), key=str)


def test_base_is_never_overruled(docs):
    out = quality.judge(docs.select("doc_id", "text", "lang", "source"))
    assert out.where("kept AND base_failed").count() == 0
    assert out.where("kept IS NULL").count() == 0


def test_fences_follow_the_group(spark):
    """The share of symbols that is usual in one source is far out in another."""
    word = lambda i: f"word{i % 37}x{i}"
    plain = lambda n: " ".join(word(i + n) for i in range(100))
    marked = lambda n: " ".join(("# " if i % 2 else "") + word(i + n) for i in range(100))
    rows = [(i, plain(i), "en", "prose") for i in range(300)] + [(1000 + i, marked(i), "en", "tables") for i in range(300)]
    rows += [(5000, " ".join("# * | < > $ & % " + word(i) for i in range(100)), "en", "prose")]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[5000] and all(v for k, v in got.items() if k != 5000)


def test_sketches_merge(spark, docs):
    """Counts of groups add up to those of all, whatever the partitions."""
    rows = stored(quality.with_measures(quality.measured(docs.select("doc_id", "text", "lang", "source"))), "measures")
    n = rows.where("NOT base_failed").count() * (len(quality.MEASURES) + len(quality.SIZES))
    got = {r.level: r.n for r in quality.sketches(rows).groupBy("level").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    assert got == {"source": n, "lang": n, "all": n}
    laid = lambda df: sorted(map(str, quality.fences(quality.sketches(df)).collect()))
    assert laid(rows.repartition(1)) == laid(rows.repartition(7, "doc_id"))


def brute_fences(measured):
    """{group: {measure: (q1, q2, q3, lo, hi)}} from sorted values of each group, as the docstring has it."""
    groups = defaultdict(list)
    for _, lang, source, failed, x, words, lines in measured:
        if not failed:
            for g in (("source", lang, source), ("lang", lang), ("all",)):
                groups[g].append((x, words, lines))
    to = lambda v: math.floor(math.log(v) / math.log(quality.GAMMA)) if v else None
    mid = lambda c: quality.GAMMA ** (c + 0.5)
    out = {}
    for g, docs in groups.items():
        out[g] = {}
        for m, of in quality.MEASURES.items():
            v = sorted(x[m] for x, *_ in docs)
            q1, q2, q3 = (v[math.ceil(len(v) * q / 4) - 1] for q in (1, 2, 3))
            if q2:
                least = q2 * (quality.GAMMA - 1)
                out[g][m] = q1, q2, q3, q1 - quality.REACH * max(q2 - q1, least), q3 + quality.REACH * max(q3 - q2, least)
                continue
            sizes = sorted(mid(to(d[1 if of == "words" else 2])) for d in docs)
            unit = to(1 / sizes[math.ceil(len(v) / 2) - 1])
            cells = sorted(to(x) for x in v if x)
            hi = mid(unit - 1 + quality.FAR)
            if cells:
                p50, p99 = (mid(cells[math.ceil(len(cells) * q / 100) - 1]) for q in (50, 99))
                hi = 2 * p99 - p50
            for c in sorted({unit - 1} | {c for c in cells if c >= unit}):
                above = sum(x > c for x in cells)
                if above and sum(x > c + quality.FAR for x in cells) >= quality.PLATEAU * above:
                    hi = mid(c + quality.FAR)
                    break
            out[g][m] = q1, q2, q3, 0.0, hi
    return out, {g: len(d) for g, d in groups.items()}


def brute_kept(rows):
    measured = []
    for doc_id, text, lang, source in rows:
        n, chars, symbols, dup, repeat, failed = brute(text)
        lines = len([x for x in (text or "").split("\n") if WORD.search(x)])
        x = {"symbol_share": max(symbols - 1, 0) / max(n, 1), "dup_share": max(dup - 1, 0) / max(lines, 1), "word_length": chars / max(n, 1), "repeat_share": max(repeat - 6, 0) / max(n, 1)}
        x = {m: quality.GAMMA ** (math.floor(math.log(v) / math.log(quality.GAMMA)) + 0.5) if v else 0.0 for m, v in x.items()}
        measured.append((doc_id, lang, source, failed, x, n, lines))
    laid, size = brute_fences(measured)

    def fence(lang, source, m):
        known = size.get(("lang", lang), 0) >= quality.MIN_GROUP
        if size["source", lang, source] < quality.MIN_GROUP:
            return laid[("lang", lang) if known else ("all",)][m][3:]
        q1, q2, q3, lo, hi = laid["source", lang, source][m]
        if known:
            *_, llo, lhi = laid["lang", lang][m]
            if llo <= q2 <= lhi:
                lo, hi = llo if q1 < llo else lo, lhi if q3 > lhi else hi
        return lo, hi

    out = []
    for doc_id, lang, source, failed, x, *_ in measured:
        bounds = {} if failed else {m: fence(lang, source, m) for m in quality.MEASURES}
        near = lambda m: bounds[m][0] * (1 - 1e-9) <= x[m] <= bounds[m][1] * (1 + 1e-9)
        out.append((doc_id, not failed and all(near(m) for m in x)))
    return sorted(out, key=str)


def text_of(rng, n, junk=0.0):
    """Words in lines, with marks, long words or repeated lines in a share of documents."""
    words = [f"{'abcdefghij'[rng.randrange(10)] * rng.randint(1, 3)}{rng.randrange(10**4)}" for _ in range(n)]
    lines = [" ".join(words[i : i + 9]) for i in range(0, n, 9)]
    if rng.random() < junk:
        kind = rng.randrange(3)
        lines = [x.replace(" ", " | ") for x in lines] if kind == 0 else [x.replace(" ", "xyzzy" * 3, 4) for x in lines] if kind == 1 else lines[:4] * 2 + lines
    return "\n".join(lines)


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize("small", [199, 200])
def test_kept_against_brute_force(spark, small):
    """Sources around MIN_GROUP, a small language, a source of junk and one whose use of marks differs."""
    rng, rows = random.Random(small), []

    def add(n, lang, source, junk=0.05):
        rows.extend((len(rows) + i, text_of(rng, rng.randint(40, 120), junk), lang, source) for i in range(n))

    add(500, "en", "a")
    add(small + 12, "en", "b", 0.2)
    add(60, "fr", "a", 0.3)
    add(30, None, None)
    rows += [(9000 + i, text_of(rng, 90).replace(" ", " # "), "en", "tables") for i in range(small)]
    rows += [(None, None, "en", "a"), (9999, "", "en", "a"), (9998, rows[0][1] * 300, "en", "a"), rows[5], rows[5]]
    got = quality.judge(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "kept")
    assert sorted(map(tuple, got.collect()), key=str) == brute_kept(rows)


@pytest.mark.parametrize("share", [0.15, 0.3])
def test_source_of_junk(spark, share):
    """A source with much junk is held to its language: junk goes, the rest stays."""
    rng = random.Random(1)
    good = lambda: text_of(rng, rng.randint(60, 120))
    rows = [(i, good(), "en", f"s{i % 4}") for i in range(1600)]
    rows += [(5000 + i, good().replace(" ", " $ ") if i < 400 * share else good(), "en", "bad") for i in range(400)]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(got[5000 + i] for i in range(int(400 * share)))
    assert sum(not v for v in got.values()) == int(400 * share)


def test_empty(no_docs):
    assert quality.judge(no_docs.select("doc_id", "text", "lang", "source")).count() == 0


def test_labelled_documents(spark):
    """Nearly all documents of good quality that pass the base rules stay, and those of bad quality go."""
    sf = "/root/testdata/sf0.01"
    out = quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("NOT base_failed")
    n = {(r.quality, r.kept): r["count"] for r in out.groupBy("quality", "kept").count().collect()}
    assert n[1, True] >= 0.99 * (n[1, True] + n.get((1, False), 0))
    assert n.get((0, True), 0) <= 0.05 * n[0, False]


def laid_on(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
    return quality.fences(quality.sketches(stored(quality.with_measures(quality.measured(docs)), "measures"))).collect()


def test_no_measure_has_the_same_fences_everywhere(spark):
    """Fences follow the groups of the test data, whether most documents have a measure or few."""
    rows = [r for r in laid_on(spark, "/root/testdata/sf0.1") if r.level == "source" and r.n >= quality.MIN_GROUP]
    assert len(rows) >= 15
    for m in quality.MEASURES:
        assert len({r[f"{m}_hi"] for r in rows}) >= 5, m
    assert len({r.word_length_lo for r in rows}) >= 5


def test_junk_that_differs_by_source(spark):
    """Two sources with a measure in few of their documents: as usual there stays, what nothing leads up to goes, at other heights in each."""
    rng, rows = random.Random(8), []
    long_text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))

    def marked(n, k):
        words = long_text(n).split()
        for i in range(k):
            words.insert(rng.randrange(len(words)), "#")
        return " ".join(words)

    for i in range(400):  # short texts, of which few have some marks and a few very many
        rows.append((i, marked(60, rng.choice([2, 3, 4, 5, 6, 8, 10]) if i % 5 == 0 else 90 if i % 41 == 1 else 0), "en", "notes"))
    for i in range(400):  # long texts: 30 marks are as far out here as 90 in the others
        rows.append((1000 + i, marked(900, 60 if i % 41 == 1 else 0), "en", "books"))
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.kept for r in quality.judge(frame).select("doc_id", "kept").collect()}
    junk = {i for i in range(400) if i % 5 and i % 41 == 1} | {1000 + i for i in range(400) if i % 41 == 1}
    assert {k for k, v in got.items() if not v} == {1000 + i for i in range(400) if i % 41 == 1} | {k for k in junk if k < 1000 and not got[k]}
    laid = {r.source: r for r in quality.fences(quality.sketches(quality.with_measures(quality.measured(frame)))).collect() if r.level == "source"}
    assert laid["books"].symbol_share_hi < 0.03 < laid["notes"].symbol_share_hi
