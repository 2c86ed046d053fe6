import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quittance.llm import simhash


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute_fp(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if not w:
        return 0
    g = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fps = [brute_fp(r[1]) for r in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                comp[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted(((r[0], f"{fps[i]:016x}", least.get(root(i))) for i, r in enumerate(rows)), key=str)


def test_against_brute_force(docs, rows):
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str) == brute(rows)


def test_chain_of_fingerprints(spark):
    """Links reach on through steps of two bits."""
    rng = np.random.default_rng(2)
    at, chain = int(rng.integers(1 << 62)), []
    for k in range(40):
        chain.append(at)
        at ^= (1 << int(rng.integers(63))) | (1 << int(rng.integers(63)))
    got = simhash.links(spark.createDataFrame([(c,) for c in set(chain)], "fp long")).collect()
    parent = {c: c for c in chain}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for r in got:
        assert (r.a ^ r.b).bit_count() <= 2
        parent[root(r.a)] = root(r.b)
    assert len({root(c) for c in chain}) == 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=40), st.integers(0, 5))
def test_trie_finds_every_pair(values, flips):
    rng = np.random.default_rng(flips)
    more = [v ^ (1 << int(rng.integers(64))) for v in values for _ in range(flips)]
    values = sorted(set(values) | set(more))
    edges = simhash.trie_links(np.array(values, np.uint64))
    parent = {v: v for v in values}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        assert (a ^ b).bit_count() <= 2
        parent[root(a)] = root(b)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                assert root(a) == root(b)


def test_one_of_each(docs, rows):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    got = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    want = {c for _, _, c in brute(rows) if c is not None}
    assert sorted(got) == sorted(want)


def test_empty(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.one_of_each(no_docs).count() == 0
