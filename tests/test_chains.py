"""Hash chains, Merkle proofs and matches between windows against plain versions."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quittance.operators import integrity, windows

ROW = "grp string, seq long, payload string, previous_hash string, hash string"


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def chain(grp, payloads):
    last, out = integrity.GENESIS, []
    for i, p in enumerate(payloads):
        out.append((grp, i, p, last, h(last + p)))
        last = out[-1][-1]
    return out


def plain(rows):
    rows = sorted(rows, key=lambda r: r[1])
    if rows[0][3] != integrity.GENESIS:
        return False, "BAD_GENESIS", rows[0][1]
    for i, r in enumerate(rows):
        if r[1] != i:
            return False, "SEQ_GAP_OR_REORDER", r[1]
        if r[4] != h(r[3] + r[2]):
            return False, "HASH_MISMATCH", r[1]
        if i and r[3] != rows[i - 1][4]:
            return False, "LINK_BROKEN", r[1]
    return True, None, None


def test_chains_are_made_and_verified(spark):
    payloads = {f"g{i}": [f"{i}-{j}" for j in range(n)] for i, n in enumerate((1, 2, 300, 5, 40))}
    events = spark.createDataFrame([(g, j, p) for g, ps in payloads.items() for j, p in enumerate(ps)], "grp string, seq long, payload string").repartition(5)
    made = integrity.chained(events, "grp")
    assert sorted(map(tuple, made.select(*(x.split()[0] for x in ROW.split(", "))).collect())) == sorted(r for g, ps in payloads.items() for r in chain(g, ps))
    assert all(r.valid for r in integrity.verified_chains(made, "grp").collect())
    assert integrity.verified_chains(made.where("false"), "grp").count() == 0


def test_first_fault_of_a_chain(spark):
    """Changed payloads, hashes, links and first rows, gaps, repeated rows, nulls, alone and together."""
    rng, rows, want = random.Random(3), [], {}
    for i in range(120):
        mine = chain(f"g{i}", [f"p{i}.{j}" for j in range(rng.randint(1, 12))])
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(mine))
            g, seq, p, prev, now = mine[k]
            kind = rng.randrange(6)
            if kind == 0:
                mine[k] = (g, seq, p + "!", prev, now)
            elif kind == 1:
                mine[k] = (g, seq, p, "x", h("x" + p))
            elif kind == 2 and len(mine) > 1:
                del mine[k]
            elif kind == 3:
                mine[k] = (g, seq + 50, p, prev, now)
            elif kind == 4:
                mine[k] = (g, seq, p, prev, None)
            else:
                mine.append(mine[k])
        rows += mine
        want[f"g{i}"] = (len(mine), *plain(mine))
    got = {r.grp: (r.n, r.valid, r.reason, r.seq) for r in integrity.verified_chains(spark.createDataFrame(rows, ROW).repartition(4), "grp").collect()}
    assert got == want
    assert {w[2] for w in want.values()} == {None, "BAD_GENESIS", "SEQ_GAP_OR_REORDER", "HASH_MISMATCH", "LINK_BROKEN"}


def test_merkle_proofs(spark):
    sizes = {"a": 1, "b": 2, "c": 3, "d": 8, "e": 13}
    leaves = spark.createDataFrame([(g, i, h(f"{g}{i}")) for g, n in sizes.items() for i in range(n)], "grp string, pos long, hash string").repartition(3)
    roots = {r.grp: r.root for r in windows.merkle_roots(leaves).collect()}
    proofs = windows.merkle_proofs(leaves).withColumn("ok", windows.proof_holds(F.col("hash"), F.col("steps"), F.col("root"))).withColumn("bad", windows.proof_holds(F.lit("x"), F.col("steps"), F.col("root"))).collect()
    assert len(proofs) == sum(sizes.values()) and all(p.ok and not p.bad and p.root == roots[p.grp] for p in proofs)
    for p in proofs:
        assert len(p.steps) == (sizes[p.grp] - 1).bit_length()
        at = p.hash
        for s in p.steps:
            at = h(s.hash + at if s.left else at + s.hash)
        assert at == p.root
    assert windows.merkle_proofs(leaves.where("false")).count() == 0


@pytest.mark.parametrize("tolerance", [0, 3])
def test_one_reference_on_many_rows(spark, tolerance):
    """Two thousand rows a side under a placeholder reference, beside references of one row a side."""
    rng = random.Random(tolerance)
    s = [(f"s{i:05d}", "NA", rng.choice([100, 102, 250]), rng.randrange(30)) for i in range(2000)] + [(f"t{i}", f"u{i}", 5, 1) for i in range(50)] + [("x", None, 5, 1), ("y", "u1", None, 1)]
    c = [(f"c{i:05d}", "NA", rng.choice([100, 102, 250, 7]), rng.randrange(30)) for i in range(2000)] + [(f"d{i}", f"u{i}", 5, i % 7) for i in range(50)] + [("z", None, 5, 1)]
    used, want = set(), set()
    for txn, utr, amount, w in sorted(c):
        for sid, u, a, v in sorted(s):
            if sid not in used and u is not None and u == utr and a is not None and abs(v - w) <= 2 and abs(a - amount) <= tolerance:
                used.add(sid)
                want.add((txn, sid, utr, abs(a - amount)))
                break
    frame = lambda rows, x: spark.createDataFrame(rows, f"{x} string, utr string, amount long, window long")
    got = windows.cross_window_matches(frame(s, "settlement_id"), frame(c, "txn_id"), tolerance)
    assert {(r.txn_id, r.settlement_id, r.utr, r.difference) for r in got.collect()} == want and len(want) > 1500


@pytest.mark.parametrize("tolerance, one_pass", [(0, None), (2, None), (0, 0), (2, 0)])
def test_pairs_between_windows(spark, tolerance, one_pass):
    """Few amounts, so that many pairs add up to many credits and credits want the same settlements; in one pass and in rounds."""
    rng = random.Random(tolerance)
    s = [(f"s{i:03d}", rng.choice([None, 10, 11, 25, 40, 41, 77, -5]), rng.choice([None, *range(8)])) for i in range(50)]
    c = [(f"c{i:03d}", rng.choice([20, 21, 35, 50, 66, 88, 117, 118, 5, None]), rng.choice([None, *range(8)])) for i in range(40)]
    used, want = set(), {}
    for txn, amount, w in c:
        left = [r for r in s if r[0] not in used and None not in r and w is not None and abs(r[2] - w) <= 2]
        pair = next(((a, b) for i, a in enumerate(left) for b in left[i + 1 :] if amount is not None and abs(a[1] + b[1] - amount) <= tolerance), None)
        if pair:
            used |= {pair[0][0], pair[1][0]}
            want[txn] = (pair[0][0], pair[1][0], pair[0][1] + pair[1][1], amount)
    sd, cd = spark.createDataFrame(s, "settlement_id string, amount long, window long"), spark.createDataFrame(c, "txn_id string, amount long, window long")
    got = {r.txn_id: (r.first_id, r.second_id, r.settled, r.credited) for r in windows.cross_window_pairs(sd, cd, tolerance, one_pass=one_pass).collect()}
    assert got == want and len(want) > 8
    assert windows.cross_window_pairs(sd.where("false"), cd).count() == 0


@pytest.mark.parametrize("one_pass", [None, 0])
def test_pairs_of_parts(spark, one_pass):
    """Credits of a part don't see what those of another have taken; by themselves they go in order."""
    s = spark.createDataFrame([("s1", 10, 0), ("s2", 20, 0), ("s3", 10, 0), ("s4", 20, 1)], "settlement_id string, amount long, window long")
    c = spark.createDataFrame([("c1", 30, 0, 7), ("c2", 30, 0, 7), ("c3", 30, 0, 8), ("c4", 30, 0, 7)], "txn_id string, amount long, window long, part long")
    got = lambda part: sorted(tuple(r)[:3] for r in windows.cross_window_pairs(s, c, one_pass=one_pass, part=part).collect())
    assert got(None) == [("c1", "s1", "s2"), ("c2", "s3", "s4")]
    assert got("part") == [("c1", "s1", "s2"), ("c2", "s3", "s4"), ("c3", "s1", "s2")]
