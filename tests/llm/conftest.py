"""A small table of documents that holds every awkward case, and the same as Python rows."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, phrase string, key string, spans string"


def prose(rng: random.Random, n: int, lang: str = "en") -> str:
    parts = {"en": ["the", "of", "and", "tion", "ing", "her", "ash", "wor"], "fr": ["le", "de", "eau", "été", "ç", "ment", "oui", "que"]}[lang]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(w.capitalize() + ("." if i % 11 == 10 else "") for i, w in enumerate(words))


@pytest.fixture(scope="session")
def bench_rows():
    rng = random.Random(5)
    return [(0, prose(rng, 12)), (1, "Two WORDS"), (2, None), (3, ""), (10, prose(rng, 25)), (None, "odd item without id"), (4, "--- ...")]


@pytest.fixture(scope="session")
def rows(bench_rows):
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(1, 160), rng.choice(["en", "fr"])) for _ in range(60)]
    long = prose(rng, 30_000)
    passage = prose(rng, 60)
    texts += [texts[0], texts[0], texts[1].upper(), long, long + " more", None, None, "", " \t\n", "7 8 9 -- !", "a", "é", "x" * 50_000]
    texts += [f"{prose(rng, 40)} {passage} {prose(rng, 30)}" for _ in range(6)]
    words = passage.split()
    words[30] = "Changed"
    texts.append(f"{prose(rng, 20)} {' '.join(words)} {prose(rng, 20)}")
    texts += ["start " + bench_rows[0][1] + " end", bench_rows[4][1].upper(), "so two words, and two-words", "odd item Without id!", bench_rows[4][1][:70]]
    texts += ["same line\nsame line\n\nother\nsame line", "one two three " * 40, "a b c a b c", "<|endoftext|> in a text", "tab\tand\x0bvt\x1cfs nbsp ls \U0001f600 x"]
    texts += ['api_key = "abcDEF123456"; token: abc', "AKIA" + "A1B2" * 5 + " " + "0123456789abcdef" * 3, "password=12345 PASSWD:'longer-than-six'"]
    out = []
    for i, t in enumerate(texts):
        out.append((i, t, ["en", "fr", None][i % 3] if i % 7 else "en", [None, "s1", "s2", "s3", "s3", "s3"][i % 6], 0, "clash", "clash", "clash"))
    out.append(out[4])  # a repeated row
    out.append((None, texts[2], "en", "s1", 0, None, None, None))
    out.append((None, "text without an id", None, None, None, None, None, None))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def bench(spark, bench_rows):
    return spark.createDataFrame(bench_rows, "item_id long, text string")
