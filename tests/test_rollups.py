"""Edges of sums, accuracy, restored balances, versions and details."""

import hashlib

from pyspark.sql import functions as F

from quittance.operators import rollups


def test_accuracy(spark):
    rows = spark.createDataFrame([("a", "AUTO_MATCHED"), ("b", "AMOUNT_MISMATCH"), ("c", "NEEDS_MANUAL_REVIEW"), ("d", "AUTO_MATCHED"), ("orphan_x", "ORPHAN_BANK_CREDIT")], "payment_id string, status string")
    labels = spark.createDataFrame([("a", "ORPHAN_BANK_CREDIT"), ("b", "AUTO_MATCHED"), ("c", "NEEDS_MANUAL_REVIEW"), ("orphan_x", "ORPHAN_BANK_CREDIT"), ("z", "AUTO_MATCHED")], "payment_id string, expected_label string")
    assert tuple(rollups.pass_accuracy(rows, labels).first()) == (66.67, 2, 2, 1, 5)
    assert tuple(rollups.pass_accuracy(rows.where("false"), labels).first()) == (0.0, 0, 0, 0, 0)


def test_micro_totals_of_nothing(spark):
    none = spark.createDataFrame([], "label string, tp long, fp long, fn long")
    assert tuple(rollups.micro_totals(none).first()) == (0, 0, 0, 0.0, 0.0, 0.0)


def test_restorations(spark):
    cases = [("t", i, "INR", d, c, None) for i, (d, c) in enumerate([(100, 60), (60, 100), (50, 50), (50, 50), (10, 20), (10, 20)])]
    lines = [("t", 0, "DEBIT", 40), ("t", 0, "CREDIT", 40), ("t", 1, "DEBIT", 40), ("t", 1, "CREDIT", 40), ("t", 2, "DEBIT", 5), ("t", 2, "CREDIT", 5), ("t", 4, "DEBIT", 10), ("u", 5, "DEBIT", 10), ("u", 5, "CREDIT", 10)]
    got = {r.transaction_id: r for r in rollups.restorations(spark.createDataFrame(cases, "tenant string, transaction_id long, currency string, debit long, credit long, policy string"), spark.createDataFrame(lines, "tenant string, transaction_id long, side string, amount long")).collect()}
    assert {k: (r.after_debit, r.after_credit, r.result) for k, r in got.items()} == {0: (100, 100, "VERIFIED"), 1: (100, 100, "VERIFIED"), 2: (55, 55, "VERIFIED"), 3: (50, 50, "FAILED"), 4: (20, 20, "FAILED"), 5: (10, 20, "FAILED")}
    assert got[0].proof_hash == hashlib.sha256(b"t:0:INR:100:60:40:40:40:100:100:0:VERIFIED:correction-policy-v1").hexdigest()


def test_changed_layers(spark):
    runs = spark.createDataFrame([(1, {"a": "1", "b": "2"}), (2, {"a": "1", "b": None}), (3, {"a": "0"}), (4, {"a": "1", "b": "2", "c": "9"})], "run_id int, versions map<string,string>")
    assert {r.run_id: (r.replayable, r.changed_layers) for r in rollups.changed_layers(runs, {"a": "1", "b": "2"}).collect()} == {1: (True, []), 2: (False, ["b"]), 3: (False, ["a", "b"]), 4: (True, [])}


def test_details_of_an_exception(spark):
    e = spark.createDataFrame([("e1", "p1", None, "t1"), ("e2", "p1", "s2", None), ("e3", None, None, "t9")], "id string, payment_id string, settlement_id string, bank_txn_id string")
    tables = {
        "payments": spark.createDataFrame([(1, "p1", "o1", 10), (2, "p1", "o2", 11)], "seq long, payment_id string, order_id string, amount long"),
        "orders": spark.createDataFrame([(1, "o1", 12)], "seq long, order_id string, amount long"),
        "settlements": spark.createDataFrame([(2, "s2", "p1", 8), (1, "s1", "p1", 7)], "seq long, settlement_id string, payment_id string, amount long"),
        "bank": spark.createDataFrame([(1, "t1", 5)], "seq long, txn_id string, amount long"),
        "refunds": spark.createDataFrame([("p1",), ("p1",)], "payment_id string"),
        "chargebacks": spark.createDataFrame([], "payment_id string"),
    }
    results = spark.createDataFrame([("p1", "X")], "payment_id string, status string")
    audit = spark.createDataFrame([("e1", 5), ("p1", 7), ("p1", 6), ("other", 9)], "entity_id string, at_s long")
    d = rollups.exception_details(e, tables, results, spark.createDataFrame([("e2", "why")], "id string, summary string"), audit)
    names = ["shown_settlement", "its_payment_amount", "its_order_amount", "its_settlement_amount", "its_bank_amount", "n_refunds", "n_chargebacks", "result_status", "summary", "n_audit", "last_audit_s"]
    got = {r.id: tuple(r[n] for n in names) for r in d.collect()}
    assert got == {
        "e1": ("s1", 10, 12, 7, 5, 2, 0, "X", None, 3, 7),
        "e2": ("s2", 10, 12, 8, None, 2, 0, "X", "why", 2, 7),
        "e3": (None, None, None, None, None, 0, 0, None, None, 0, None),
    }
    assert d.where(F.col("id").isNull()).count() == 0
