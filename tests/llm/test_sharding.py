import zlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from quittance.llm import sharding


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=12), st.integers(1, 5))
def test_smallest_capacity(sizes, shards):
    def fits(cap):
        n, room = 1, cap
        for s in sizes:
            if s > cap:
                return False
            if s > room:
                n, room = n + 1, cap
            room -= s
        return n <= shards

    want = next(c for c in range(sum(sizes) + 1) if fits(c)) if sizes else 0
    assert sharding.smallest_capacity(sizes, shards) == want


def check(out, rows, shards):
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in out) == sorted(
        (str(r[0]), len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows
    )
    slots, of_text = defaultdict(list), defaultdict(set)
    for r in out:
        slots[r.shard].append(r.slot)
        of_text[r.text_crc32, r["size"]].add(r.shard)
        assert 0 <= r.shard < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())


def test_groups_and_slots(docs, rows):
    for shards in (1, 3, 40):
        check(sharding.assign(sharding.sized(docs), shards).collect(), rows, shards)


def test_cuts_are_minimax(spark):
    import random

    rng = random.Random(1)
    groups = [(f"{rng.getrandbits(128):032x}", rng.randint(1, 50)) for _ in range(5000)]
    df = spark.createDataFrame(groups, "grp string, size long")
    groups.sort()
    cuts = sharding.minimax_cuts(df, 40)
    sums = defaultdict(int)
    for g, s in groups:
        sums[sum(c <= g for c in cuts)] += s
    assert max(sums.values()) == sharding.smallest_capacity([s for _, s in groups], 40)


def test_empty(no_docs):
    assert sharding.assign(sharding.sized(no_docs)).count() == 0
