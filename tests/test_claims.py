"""Claims against evidence: each check alone, nulls and unknown cases."""

import hashlib

import pytest

from quittance.operators import claims

CLAIM = "case_id string, place int, claim_id string, type string, statement string, evidence_ids array<string>, asserted array<struct<key:string,expected:long,observed:long>>"
EVIDENCE = "case_id string, evidence_id string, source_id string, access string, linked_ids array<string>, body string"
CASE = "case_id string, payment_id string, settlement_id string, utr string, gross long, fee long, tax long, refund long, chargeback long, settled long, created_s long, settled_s long, discrepancy long, tolerance long, window_h int, n_contradictions int"

GOOD = ("x", "p", "s", "U1", 1000, 20, 5, 75, None, 900, 0, 48 * 3600, 100, None, None, 0)
EVIDENCES = [("x", "own", "p", "PUBLIC", None, None), ("x", "linked", "q", None, ["s"], None), ("x", "body", "q", "INTERNAL", [], "see U1."), ("x", "case", "x", "INTERNAL", None, ""), ("x", "closed", "p", "HIGHLY_RESTRICTED", None, None), ("x", "far", "q", "PUBLIC", ["z"], "U2"), ("x", "far", "q", "PUBLIC", ["z"], "U2"), ("y", "other", "p", "PUBLIC", None, None)]


def judge(spark, claim, case=GOOD):
    made = claims.validated(spark.createDataFrame([claim], CLAIM), spark.createDataFrame(EVIDENCES, EVIDENCE), spark.createDataFrame([case], CASE)).collect()
    assert len(made) == 1
    r = made[0]
    assert r.receipt_hash == hashlib.sha256("|".join([r.claim_id, r.type, r.status, ",".join(r.evidence_ids), ";".join(r.reasons)]).encode()).hexdigest()
    return r.status, r.reasons


def changed(**k):
    names = [c.split()[0] for c in CASE.split(", ")]
    return tuple(k.get(n, v) for n, v in zip(names, GOOD, strict=True))


@pytest.mark.parametrize("claim, case, status, reasons", [
    (("AMOUNT", "x", ["own", "linked", "body", "case"], None), GOOD, "VERIFIED", []),
    (("AMOUNT", "x", ["nope", "closed", "far", "other"], None), GOOD, "DISPUTED", ["INVENTED_EVIDENCE_ID: nope", "INVENTED_EVIDENCE_ID: other", "UNAUTHORIZED_EVIDENCE: closed", "UNLINKED_EVIDENCE: far"]),
    (("TIMING", "x", ["far"], None), GOOD, "UNSUPPORTED", ["UNLINKED_EVIDENCE: far"]),
    (("TIMING", None, None, None), GOOD, "VERIFIED", []),
    ((None, None, [], None), GOOD, "INSUFFICIENT_EVIDENCE", ["NO_EVIDENCE_CITED"]),
    (("AMOUNT", "x", ["case"], None), changed(payment_id=None, settlement_id=None), "UNSUPPORTED", ["MISSING_FINANCIAL_RECORDS"]),
    (("TIMING", "x", ["own"], [("fee", 1, 2), ("tax", 3, 3), ("net", None, 4), ("due", 5, None)]), GOOD, "DISPUTED", ["AMOUNT_MISMATCH: fee (1 != 2)"]),
    (("AMOUNT", "The refund explains it", ["own"], None), GOOD, "VERIFIED", []),
    (("AMOUNT", "the Variance", ["own"], None), changed(refund=76), "DISPUTED", ["ARITHMETIC_MISMATCH: Variance 100 != Deductions 101"]),
    (("TIMING", "the variance", ["own"], None), changed(refund=76), "VERIFIED", []),
    (("TIMING", "x", ["own"], None), changed(settled_s=48 * 3600 + 1), "DISPUTED", ["TIMING_WINDOW_VIOLATION"]),
    (("TIMING", "x", ["own"], None), changed(settled_s=None), "VERIFIED", []),
    (("POLICY", "all Within Tolerance", ["own"], None), changed(discrepancy=101), "UNSUPPORTED", ["POLICY_TOLERANCE_EXCEEDED"]),
    (("POLICY", "all within tolerance", ["own"], None), changed(discrepancy=101, tolerance=101), "VERIFIED", []),
    (("POLICY", "x", ["own"], None), changed(n_contradictions=2), "UNSUPPORTED", ["CONFLICTING_EVIDENCE"]),
])
def test_each_check(spark, claim, case, status, reasons):
    kind, statement, ids, asserted = claim
    assert judge(spark, ("x", 0, "c", kind, statement, ids, asserted), case) == (status, reasons)


def test_unknown_case_and_none(spark):
    assert judge(spark, ("zz", 0, "c", "AMOUNT", "x", ["own"], None)) == ("DISPUTED", ["INVENTED_EVIDENCE_ID: own", "MISSING_FINANCIAL_RECORDS"])
    none = claims.validated(spark.createDataFrame([], CLAIM), spark.createDataFrame(EVIDENCES, EVIDENCE), spark.createDataFrame([GOOD], CASE))
    assert none.count() == 0 and claims.case_receipts(none, "r").count() == 0
