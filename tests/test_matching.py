"""The matching against a sequential replay, and its parts at their boundaries."""

import random

import pytest

from quittance.operators import graph, matching, turns

HOUR, DAY = 3600, 86400


def replay(pay, setl, bank):
    """Payments one after the other, each with the credits that are left; no refunds or chargebacks."""
    by_utr, used, out = {}, set(), {}
    for b in bank:
        if b["type"] == "CREDIT" and b["utr"]:
            by_utr[b["utr"]] = b
    clock = max(p["captured_s"] for p in pay)
    for p in sorted(pay, key=lambda p: p["seq"]):
        mine = sorted((s for s in setl if s["payment_id"] == p["payment_id"]), key=lambda s: s["seq"])
        net = p["amount"] - p["fee"] - p["tax"]
        if not mine:
            out[p["payment_id"]] = ("PENDING_SETTLEMENT" if clock - p["captured_s"] < 3 * DAY else "MISSING_BANK_CREDIT", None)
            continue
        if len(mine) > 1:
            out[p["payment_id"]] = ("DUPLICATE_SETTLEMENT", None)
            continue
        s, status, txn = mine[0], "AUTO_MATCHED", None
        off = abs(net - s["amount"]) > 100
        if off:
            status = "AMOUNT_MISMATCH"
        hit = by_utr.get(s["utr"]) if s["utr"] else None
        ambiguous = False
        if hit:
            txn = hit
            if status == "AUTO_MATCHED" and abs(hit["amount"] - s["amount"]) > 100:
                status = "AMOUNT_MISMATCH"
        else:
            tol = max(100, int(s["amount"] * 0.01 + 0.5))
            c = [b for b in bank if b["type"] == "CREDIT" and b["txn_id"] not in used and abs(b["amount"] - s["amount"]) <= tol
                 and (s["settled_s"] is None or -HOUR <= b["txn_s"] - s["settled_s"] <= 72 * HOUR)]
            if len(c) == 1:
                txn = c[0]
            ambiguous = len(c) > 1
        if txn:
            used.add(txn["txn_id"])
            if status == "AUTO_MATCHED" and s["settled_s"] is not None and txn["txn_s"] - s["settled_s"] > DAY:
                status = "DELAYED_BANK_CREDIT"
        elif status == "AUTO_MATCHED":
            if ambiguous:
                status = "NEEDS_MANUAL_REVIEW"
            elif s["settled_s"] is not None and clock - s["settled_s"] > 2 * DAY:
                status = "MISSING_BANK_CREDIT"
        if status == "AUTO_MATCHED" and not hit:
            near = txn is not None and s["settled_s"] is not None and abs(txn["txn_s"] - s["settled_s"]) < DAY
            delta = abs(net - s["amount"])
            score = 25 + 15 + 5 + 10 * near - 20 * (txn is None) - (5 if 0 < delta else 0) - 30 * ambiguous
            if score < 50:
                status = "NEEDS_MANUAL_REVIEW"
        out[p["payment_id"]] = (status, txn["txn_id"] if txn else None)
    return out


@pytest.mark.parametrize("seed, one_pass, share", [(0, 1 << 18, 0.05), (0, 0, 0.05), (1, 0, 0), (1, 0, 1), (1, 40, 0.01)])
def test_contested_credits(spark, monkeypatch, seed, one_pass, share):
    """Decided in one pass, in rounds, in one round and then by component, and in rounds until few are left."""
    monkeypatch.setattr(turns, "ONE_PASS", one_pass)
    monkeypatch.setattr(turns, "LEAST_SHARE", share)
    rng = random.Random(seed)
    pay, setl, bank = [], [], []
    for i in range(160):
        amount, t = rng.choice([10_000, 10_050, 250_000, 251_000]), rng.randrange(400) * 6 * HOUR
        pay.append({"seq": i, "payment_id": f"pay_{i:03}", "order_id": f"o{i}", "amount": amount, "fee": 0, "tax": 0, "method": "upi", "status": "captured", "captured_s": t, "class": 0})
        for j in range(rng.choice([0, 1, 1, 1, 1, 1, 2])):
            setl.append({"seq": 2 * i + j, "settlement_id": f"s{i}_{j}", "payment_id": f"pay_{i:03}", "amount": amount + rng.choice([0, 0, 50, 500]), "utr": rng.choice([None, f"U{i}", f"V{i}"]), "settled_s": rng.choice([t, t, t + DAY, None]), "class": 0})
    for i in range(120):
        bank.append({"seq": i, "txn_id": f"t{i:03}", "utr": rng.choice([None, f"U{rng.randrange(160)}"]), "amount": rng.choice([10_000, 10_080, 250_000, 252_000]), "type": rng.choice(["CREDIT"] * 5 + ["DEBIT"]), "txn_s": rng.randrange(480) * 5 * HOUR, "narration": None})
    frame = lambda rows, schema: spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    p = frame(pay, "seq long, payment_id string, order_id string, amount long, fee long, tax long, method string, status string, captured_s long, class int")
    s = frame(setl, "seq long, settlement_id string, payment_id string, amount long, utr string, settled_s long, class int")
    b = frame(bank, "seq long, txn_id string, utr string, amount long, type string, txn_s long, narration string")
    none_r = spark.createDataFrame([], "seq long, refund_id string, payment_id string, amount long, status string")
    none_c = spark.createDataFrame([], "seq long, chargeback_id string, payment_id string, amount long, status string")
    r = matching.match(p, s, b, none_r, none_c)
    got = {x.payment_id: (x.status, x.bank_txn_id) for x in r.collect()}
    want = replay(pay, setl, bank)
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}
    assert sum(t is not None for _, t in got.values()) > 20


def by_turn(rows):
    taken, want, of = set(), {}, {}
    for r in rows:
        of.setdefault(r[0], set()).add(r[1])
    for seq in sorted(of):
        left = of[seq] - taken
        want[seq] = (min(len(left), 2), min(left) if len(left) == 1 else None)
        taken |= left if len(left) == 1 else set()
    return want


def resolved(spark, rows, one_pass):
    got = matching.resolve(spark.createDataFrame(rows, "seq long, txn_id string, credit long, txn_s long, narration string"), one_pass)
    return {r.seq: (r.n, r.txn_id) for r in got.collect()}


@pytest.mark.parametrize("one_pass", [None, 0])
def test_one_component_of_claims(spark, one_pass):
    """A batch whose claims all hang together, with chains that many rounds long."""
    rows = [(i, f"t{j:03}", 100, 0, None) for i in range(60) for j in (i, i + 1)] + [(100 + i, f"t{j:03}", 100, 0, None) for i in range(30) for j in range(25)]
    assert resolved(spark, rows, one_pass) == by_turn(rows)
    assert resolved(spark, [], one_pass) == {}


@pytest.mark.parametrize("one_pass", [None, 0])
def test_long_chains_take_no_long_time(spark, one_pass):
    """A chain of 20,000 payments, each with the credit of the one before, and a component of as many around shared credits."""
    import time

    n = 20_000
    rows = [(0, "c0", 1, 0, None)] + [(i, f"c{j}", 1, 0, None) for i in range(1, n) for j in (i - 1, i)]
    rng = random.Random(2)
    rows += [(n + i, f"d{j}", 1, 0, None) for i in range(n) for j in {i // 2, rng.randrange(n // 2), 0}]
    began = time.time()
    assert resolved(spark, rows, one_pass) == by_turn(rows)
    assert time.time() - began < 60


def test_components(spark):
    edges = [(f"n{i}", f"n{i + 1}") for i in range(30)] + [("x1", "x2"), ("x2", "x1")]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[f"n{i}"] for i in range(31)} == {"n0"} and got["x1"] == got["x2"] == "x1"


def test_unknown_currency_is_an_error(spark):
    from quittance.functions.currency import to_inr

    df = spark.createDataFrame([(1, 101, "USD"), (2, -5, "EUR"), (3, 7, "JPY")], "i long, minor long, currency string")
    assert {r.i: r.inr_minor for r in to_inr(df, "minor").collect()} == {1: 8408, 2: 0, 3: 385}
    with pytest.raises(Exception, match="unknown currency"):
        to_inr(spark.createDataFrame([(1, 1, "XXX")], "i long, minor long, currency string"), "minor").collect()


@pytest.mark.parametrize("seed, shown", [(0, 8), (1, 3), (2, 0)])
def test_payments_without_a_time(spark, monkeypatch, seed, shown):
    """Many payments without a time of settlement, few or many credits of their amounts, some taken by reference or claimed by timed ones: as one after the other.

    Those that find two credits whatever goes before them make no candidates, so these don't grow with payments times credits.
    """
    monkeypatch.setattr(matching, "SHOWN", shown)
    made, resolve = [], matching.resolve
    monkeypatch.setattr(matching, "resolve", lambda claims: made.append(claims.count()) or resolve(claims))
    rng = random.Random(seed)
    pay, setl, bank = [], [], []
    for i in range(120):
        amount = rng.choice([10_000, 250_000, 900_000])
        pay.append((i, f"pay_{i:03}", f"o{i}", amount, 0, 0, "upi", "captured", i * HOUR, 0))
        setl.append((i, f"s{i}", f"pay_{i:03}", amount, rng.choice([None, None, f"U{i}"]), rng.choice([None, None, i * HOUR]), 0))
    for i in range(300):
        bank.append((i, f"t{i:03}", rng.choice([None, f"U{rng.randrange(120)}"]), rng.choice([250_000, 250_500, *[10_000] * (i % 60 == 0), 900_000 + i % 7 * 4000]), "CREDIT", rng.randrange(400) * HOUR, None))
    schemas = ("seq long, payment_id string, order_id string, amount long, fee long, tax long, method string, status string, captured_s long, class int",
               "seq long, settlement_id string, payment_id string, amount long, utr string, settled_s long, class int", "seq long, txn_id string, utr string, amount long, type string, txn_s long, narration string")
    rows = [[dict(zip((c.split()[0] for c in x.split(", ")), r, strict=True)) for r in t] for x, t in zip(schemas, (pay, setl, bank), strict=True)]
    none = spark.createDataFrame([], "seq long, refund_id string, chargeback_id string, payment_id string, amount long, status string")
    r = matching.match(*(spark.createDataFrame(t, x) for x, t in zip(schemas, (pay, setl, bank), strict=True)), none, none)
    assert {x.payment_id: (x.status, x.bank_txn_id) for x in r.collect()} == replay(*rows)
    # 60 or so have no time, and each of the two larger amounts a hundred credits or more
    assert made and (shown == 3 or (made[0] > 2000) == (shown == 0)), made


def test_tables_on_the_way_are_deleted(spark, tmp_path):
    import os

    from quittance.sources import stored

    before = set(os.listdir(stored.shared_dir(spark)))
    df = stored.once(spark, "kept", str(tmp_path), lambda: stored.stored(stored.stored(spark.range(9), "first"), "second"))
    assert df.count() == 9
    assert [x.rpartition("-")[0] for x in set(os.listdir(stored.shared_dir(spark))) - before] == ["kept"]
