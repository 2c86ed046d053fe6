"""Payments against invoices, and claims of invoices, against plain versions."""

import random
import time
from itertools import combinations

import numpy as np
import pytest

from quittance.operators import invoices, turns

P = "payment_id string, tenant string, amount long, currency string, tolerance long, partial boolean, most int"
I = "payment_id string, seq long, invoice_id string, tenant string, amount long, currency string, status string"  # noqa: E741


def plain(p, named):
    pid, tenant, amount, money, tol, partial, most = p
    named, seen = sorted(named, key=lambda r: r[1]), set()
    for _, _, id_, t, _, c, _ in named:
        fault = "DUPLICATE_INVOICE" if id_ in seen else "TENANT_MISMATCH" if t != tenant else "MIXED_CURRENCY" if (c or "").strip().upper() != money.strip().upper() else None
        if fault:
            return pid, "BLOCKED", "MODEL_INVALID", (), 0, amount, 0, 0, fault
        seen.add(id_)
    fit = sorted((r[4], r[2]) for r in named if r[6] == "ELIGIBLE" and r[4] is not None)
    n, fit = len(fit), fit[:50]
    for a, id_ in fit:
        if a == amount:
            return pid, "EXACT_MATCH", "OPTIMAL", (id_,), a, 0, 1, len(fit), None
    best = None
    for k in range(1, min(most, 8) + 1):
        for c in combinations(range(len(fit)), k):
            off = abs(sum(fit[i][0] for i in c) - amount)
            if off <= tol and (best is None or (off, k, c) < best):
                best = off, k, c
    if best:
        off, k, c = best
        return pid, "SPLIT_MATCH_WITH_TOLERANCE" if off else "SPLIT_MATCH", "FEASIBLE" if n > 50 else "OPTIMAL", tuple(fit[i][1] for i in c), sum(fit[i][0] for i in c), off, off * 1000 + k, len(fit), None
    for a, id_ in fit:
        if partial and a > amount:
            return pid, "PARTIAL_PAYMENT", "FEASIBLE", (id_,), a, a - amount, a - amount, len(fit), None
    return pid, "NO_FEASIBLE_MATCH", "INFEASIBLE", (), 0, amount, 0 + amount, len(fit), None


def test_matches_against_brute_force(spark):
    rng, pay, inv = random.Random(6), [], []
    for i in range(300):
        n = rng.choice([0, 1, 3, 6, 9])
        mine = [(f"p{i}", j, f"i{j if rng.random() < 0.97 else 0}", "t" if rng.random() < 0.98 else "u", rng.choice([None, *range(50, 9000, 7)]), rng.choice(["INR", " inr"]) if rng.random() < 0.98 else rng.choice(["USD", None]), rng.choice(["ELIGIBLE"] * 9 + ["LOCKED", None])) for j in range(n)]
        some = [r[4] for r in rng.sample(mine, rng.randint(0, n)) if r[4]]
        pay.append((f"p{i}", "t", max(1, sum(some) + rng.choice([0, 0, -3, 5])), "inr", rng.choice([0, 4, 10]), rng.random() < 0.5, rng.choice([1, 2, 8, 20])))
        inv += mine
    pay.append(("many", "t", 10, "INR", 0, True, 8))
    inv += [("many", j, f"m{j}", "t", 10 + j, "INR", "ELIGIBLE") for j in range(501)] + [(None, 1, "x", "t", 5, "INR", "ELIGIBLE")]
    pd_, id_ = spark.createDataFrame(pay, P), spark.createDataFrame(inv, I).repartition(4)
    found = invoices.matched(pd_, id_)
    got = {r.payment_id: (r.payment_id, r.status, r.solver_status, tuple(r.invoice_ids), r.total, r.difference, r.objective, r.considered, r.reason) for r in found.collect()}
    want = {p[0]: plain(p, [r for r in inv if r[0] == p[0]]) for p in pay[:-1]}
    assert got.pop("many")[1::7] == ("BLOCKED", "TOO_MANY_INVOICES")
    assert {k: (v, want[k]) for k, v in got.items() if (*v[:6], *v[7:]) != (*want[k][:6], *want[k][7:]) or (v[3] and v[6] != want[k][6])} == {}
    assert len({v[1] for v in got.values()}) == 6
    checked = {r.payment_id: r.failures for r in invoices.verified(found, pd_, id_).collect()}
    assert len(checked) == len(pay) and not any(checked.values())


def test_most_candidates_end():
    """Fifty invoices and eight to choose end in seconds, and what lies beyond fifty is told."""
    rng = np.random.default_rng(0)
    amounts = np.sort(rng.integers(10**5, 10**7, 50))
    ids, began = [f"i{i:02d}" for i in range(50)], time.time()
    target = int(amounts[[1, 9, 22, 30, 41, 44, 47, 49]].sum())
    got = invoices.settle(amounts, ids, target, 0, 8, False, True)
    assert got[:2] == ("SPLIT_MATCH", "FEASIBLE") and got[3] == target and len(got[2]) <= 8
    assert invoices.settle(np.full(50, 7), ids, 7 * 8 + 1, 1, 8, False, False)[2] == ids[:8]
    assert time.time() - began < 20


@pytest.mark.parametrize("change, failure", [
    ({"total": 1}, {"TOTAL"}), ({"difference": 9}, {"DIFFERENCE"}), ({"objective": 5}, {"OBJECTIVE"}), ({"solver_status": "TIMEOUT"}, {"SOLVER_STATUS"}), ({"invoice_ids": ["a", "a"], "total": 200}, {"DUPLICATE_ID", "TOO_MANY", "BEYOND_TOLERANCE", "DIFFERENCE", "OBJECTIVE"}),
    ({"invoice_ids": ["zz"]}, {"UNKNOWN_ID", "TOTAL", "BEYOND_TOLERANCE", "DIFFERENCE", "OBJECTIVE"}), ({"invoice_ids": ["b"]}, {"NOT_ELIGIBLE"}), ({"invoice_ids": ["c"]}, {"OTHER_TENANT"}), ({"invoice_ids": []}, {"EMPTY", "TOTAL", "BEYOND_TOLERANCE", "DIFFERENCE", "OBJECTIVE"}),
    ({"status": "NO_FEASIBLE_MATCH"}, {"CHOSEN_WITHOUT_A_MATCH"}), ({"status": "PARTIAL_PAYMENT"}, {"NOT_PARTIAL", "OBJECTIVE"}), ({}, set()),
])
def test_each_check(spark, change, failure):
    good = {"payment_id": "p", "status": "EXACT_MATCH", "solver_status": "OPTIMAL", "invoice_ids": ["a"], "total": 100, "difference": 0, "objective": 1, "considered": 1} | change
    answers = spark.createDataFrame([tuple(good.values())], invoices.FOUND)
    named = spark.createDataFrame([("p", 0, "a", "t", 100, "INR", "ELIGIBLE"), ("p", 1, "b", "t", 100, "INR", "LOCKED"), ("p", 2, "c", "u", 100, "INR", "ELIGIBLE")], I)
    assert set(invoices.verified(answers, spark.createDataFrame([("p", "t", 100, "INR", 0, False, 1)], P), named).first().failures) == failure


@pytest.mark.parametrize("one_pass, share", [(None, 0.05), (0, 0), (0, 1), (30, 0.01)])
def test_allocations_in_order(spark, monkeypatch, one_pass, share):
    """In one pass, in rounds, by component: as payments one after another would get them."""
    monkeypatch.setattr(turns, "LEAST_SHARE", share)
    rng = random.Random(1)
    claims = [(i, j, f"t:{x}") for i in range(120) for j, x in enumerate(rng.sample(range(90), rng.randint(1, 4)))]
    claims += [(200 + i, j, f"c{i + j}") for i in range(40) for j in (0, 1)]  # a chain
    taken, want = set(), {}
    for i in sorted({c[0] for c in claims}):
        mine = [c[2] for c in sorted(claims) if c[0] == i]
        clash = next((x for x in mine if x in taken), None)
        want[i] = (clash is None, clash)
        taken |= set(mine) if clash is None else set()
    got = {r.seq: (r.ok, r.conflict) for r in invoices.allocated(spark.createDataFrame(claims, "seq long, place int, item string"), one_pass).collect()}
    assert got == want
