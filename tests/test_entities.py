import random

import pytest

from quittance.operators import entities
from quittance.plans import registry
from quittance.sources import fixtures

SF = "/root/testdata/sf0.001"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def brute(left, right, least):
    out = []
    for i, block, x in left:
        for j, other, y in right:
            if block is not None and block == other and x is not None and y is not None and max(len(x), len(y)):
                likeness = round(1 - distance(x, y) / max(len(x), len(y)), 6)
                if likeness >= least:
                    out.append((i, j, likeness))
    return sorted(out)


@pytest.mark.parametrize("least", [0.5, 0.7])
def test_similar_against_brute_force(spark, least):
    """Names that differ in length, at the front or at the end, repeated names, nulls."""
    rng = random.Random(1)
    name = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
    side = lambda: [(i, rng.choice([1, 2, None]), rng.choice([name(), name(), "acme ltd", None])) for i in range(60)]
    left, right = side(), side()
    frame = lambda rows, x: spark.createDataFrame(rows, f"{x} long, block int, {x[0]}_name string")
    got = entities.similar(frame(left, "left_id"), frame(right, "right_id"), "block", least)
    assert sorted(map(tuple, got.select("left_id", "right_id", "similarity").collect())) == brute(left, right, least)


def test_query_loses_no_pair_of_a_nation(spark):
    rows = lambda t, x: [tuple(r) for r in fixtures.table(spark, SF, t).select(*x).collect()]
    want = brute(rows("customer", ["c_custkey", "c_nationkey", "c_name"]), rows("supplier", ["s_suppkey", "s_nationkey", "s_name"]), 0.5)
    got = registry.QUERIES["entity_similarity_by_nation"](spark, SF).collect()
    assert want and sorted(map(tuple, got)) == want
