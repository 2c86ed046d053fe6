"""Claims about cases, checked against the records and the evidence of the case.

A claim's references meet the evidence of its case in one equi join on case and id; what they lack, and what the records of the
case say against the claim, become reasons, in a fixed order, and reasons make its status.

claims (case_id, place, claim_id, type, statement, evidence_ids, asserted array of (key, expected, observed)); evidence (case_id, evidence_id,
source_id, access, linked_ids, body); cases (case_id, payment_id, settlement_id, utr, gross, fee, tax, refund, chargeback, settled, created_s,
settled_s, discrepancy, tolerance, window_h, n_contradictions): null ids say that there is no such record. A claim of an unknown case has
no evidence and no records. Null arrays are empty, null numbers 0; repeated rows of evidence are one. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Access that a claim may not use, the types that speak of money, defaults of a policy.
RESTRICTED, MONEY = ("HIGHLY_RESTRICTED", "RESTRICTED_CLEARANCE_REQUIRED"), ("AMOUNT", "FINANCIAL_EXPLANATION")
WINDOW_H, TOLERANCE = 48, 100
#: Reasons whose names hold one of these dispute a claim; others leave it unsupported.
DISPUTING = "INVENTED|UNAUTHORIZED|MISMATCH|VIOLATION"


def _references(claims: DataFrame, evidence: DataFrame, cases: DataFrame) -> DataFrame:
    """(claim_id, reasons): what is wrong with the evidence that a claim cites, unknown first, then restricted, then unlinked."""
    cited = claims.select("claim_id", "case_id", F.posexplode("evidence_ids").alias("at", "evidence_id"))
    ids = cases.select("case_id", "payment_id", "settlement_id", "utr")
    known = evidence.dropDuplicates(["case_id", "evidence_id"]).withColumn("there", F.lit(True))
    each = cited.join(known, ["case_id", "evidence_id"], "left").join(ids, "case_id", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    has = lambda x: no(F.col("source_id") == F.col(x)) | no(F.array_contains("linked_ids", F.col(x)))
    linked = has("payment_id") | has("settlement_id") | no(F.contains("body", F.col("utr"))) | no(F.contains("body", F.col("payment_id"))) | no(F.col("source_id") == F.col("case_id"))
    told = lambda rank, name: F.struct(F.lit(rank).alias("rank"), F.col("at"), F.concat(F.lit(f"{name}: "), "evidence_id").alias("reason"))
    found = F.col("there").isNotNull()
    wrong = F.array_compact(
        F.array(
            F.when(~found, told(0, "INVENTED_EVIDENCE_ID")), F.when(found & no(F.col("access").isin(*RESTRICTED)), told(1, "UNAUTHORIZED_EVIDENCE")), F.when(found & ~linked, told(2, "UNLINKED_EVIDENCE"))
        )
    )
    return each.select("claim_id", F.explode(wrong).alias("w")).groupBy("claim_id").agg(F.transform(F.sort_array(F.collect_list("w")), lambda w: w["reason"]).alias("of_evidence"))


def _of_records() -> Column:
    """What the records of the case say against a claim, in order."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    text = lambda c: c.cast("string")
    money = F.coalesce(F.col("type").isin(*MONEY), F.lit(False))
    said = F.lower(F.coalesce("statement", F.lit("")))
    off = F.filter(F.coalesce("asserted", F.array()), lambda a: a["expected"] != a["observed"])
    amounts = F.transform(off, lambda a: F.concat(F.lit("AMOUNT_MISMATCH: "), a["key"], F.lit(" ("), text(a["expected"]), F.lit(" != "), text(a["observed"]), F.lit(")")))
    variance, deducted = F.abs(n("gross") - n("settled")), n("fee") + n("tax") + n("refund") + n("chargeback")
    explains = money & (F.contains(said, F.lit("refund explains")) | F.contains(said, F.lit("variance")))
    late = F.abs(F.col("settled_s") - F.col("created_s")) > F.coalesce("window_h", F.lit(WINDOW_H)) * 3600
    one = lambda wrong, reason: F.when(F.coalesce(wrong, F.lit(False)), F.array(reason)).otherwise(F.array().cast("array<string>"))
    return F.concat(
        one(money & F.col("payment_id").isNull() & F.col("settlement_id").isNull(), F.lit("MISSING_FINANCIAL_RECORDS")),
        amounts,
        one(explains & (variance != deducted), F.concat(F.lit("ARITHMETIC_MISMATCH: Variance "), text(variance), F.lit(" != Deductions "), text(deducted))),
        one(late, F.lit("TIMING_WINDOW_VIOLATION")),
        one((n("discrepancy") > F.coalesce("tolerance", F.lit(TOLERANCE))) & F.contains(said, F.lit("within tolerance")), F.lit("POLICY_TOLERANCE_EXCEEDED")),
        one(n("n_contradictions") > 0, F.lit("CONFLICTING_EVIDENCE")),
    )


def validated(claims: DataFrame, evidence: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, place, claim_id, type, status, evidence_ids, reasons, receipt_hash) of every claim; evidence_ids sorted.

    VERIFIED without a reason, DISPUTED by what is invented, restricted, unequal or late, else UNSUPPORTED; INSUFFICIENT_EVIDENCE if a
    claim about money cites nothing, whatever else is wrong.
    """
    asked = claims.withColumn("evidence_ids", F.coalesce("evidence_ids", F.array().cast("array<string>"))).withColumn("type", F.coalesce("type", F.lit("FINANCIAL_EXPLANATION")))
    told = asked.join(cases, "case_id", "left").join(_references(asked, evidence, cases), "claim_id", "left")
    none = F.array().cast("array<string>")
    reasons = told.withColumn("found", F.concat(F.coalesce("of_evidence", none), _of_records()))
    uncited = (F.size("evidence_ids") == 0) & F.col("type").isin(*MONEY)
    status = F.when(uncited, "INSUFFICIENT_EVIDENCE").when(F.size("found") == 0, "VERIFIED").when(F.exists("found", lambda r: r.rlike(DISPUTING)), "DISPUTED").otherwise("UNSUPPORTED")
    out = reasons.withColumn("status", status).withColumn("reasons", F.when(uncited, F.array_append("found", "NO_EVIDENCE_CITED")).otherwise(F.col("found"))).withColumn("evidence_ids", F.sort_array("evidence_ids"))
    body = F.concat_ws("|", "claim_id", "type", "status", F.array_join("evidence_ids", ","), F.array_join("reasons", ";"))
    return out.select("case_id", "place", "claim_id", "type", "status", "evidence_ids", "reasons", F.sha2(body, 256).alias("receipt_hash"))


def case_receipts(answers: DataFrame, run_id: str) -> DataFrame:
    """(case_id, n, verified, disputed, unsupported, insufficient, abstain, canonical_hash) of validated(): the digest covers a case's receipts in order of place.

    A case abstains if all that can be said is that evidence lacks. The digests of a case's few claims come together in a row.
    """
    count = lambda s: F.count_if(F.col("status") == s)
    per = answers.groupBy("case_id").agg(
        F.count("*").alias("n"), count("VERIFIED").alias("verified"), count("DISPUTED").alias("disputed"), count("UNSUPPORTED").alias("unsupported"), count("INSUFFICIENT_EVIDENCE").alias("insufficient"),
        F.sort_array(F.collect_list(F.struct("place", "receipt_hash"))).alias("r"),
    )
    abstain = (F.col("insufficient") > 0) & (F.col("verified") == 0) & (F.col("disputed") == 0)
    digest = F.sha2(F.concat_ws("|", F.lit(run_id), "case_id", F.array_join("r.receipt_hash", ":")), 256)
    return per.select("case_id", "n", "verified", "disputed", "unsupported", "insufficient", abstain.alias("abstain"), digest.alias("canonical_hash"))
