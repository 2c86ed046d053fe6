"""Exception rows, their lists and pages, gates and states, as projections, filters and sorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What to do about a status.
ACTIONS = {
    "PENDING_SETTLEMENT": "Wait for T+2 settlement window to complete. No action needed.",
    "MISSING_BANK_CREDIT": "Contact Razorpay support with settlement ID. Check bank statement for UTR.",
    "AMOUNT_MISMATCH": "Verify fee and tax deduction against Razorpay settlement report. Check for hidden charges.",
    "DUPLICATE_SETTLEMENT": "Contact Razorpay support immediately. Potential overpayment. Provide both settlement IDs.",
    "ORPHAN_BANK_CREDIT": "Identify source of credit. Check if it belongs to a different merchant account or batch.",
    "REFUND_MISMATCH": "Verify refund was processed. Check if settlement was generated before refund was applied.",
    "CHARGEBACK_ADJUSTMENT": "Review chargeback reason. Prepare evidence for dispute if applicable.",
    "DELAYED_BANK_CREDIT": "Monitor bank account. If delay exceeds 72h, contact bank and Razorpay.",
    "NEEDS_MANUAL_REVIEW": "Manually verify records. Multiple candidates exist — human judgment required.",
}
OTHER_ACTION = "Review exception details and take appropriate action."

#: The states that an exception may go to.
TRANSITIONS = {
    "OPEN": ["INVESTIGATING", "ESCALATED"],
    "INVESTIGATING": ["PENDING_APPROVAL", "CORRECTING", "ESCALATED"],
    "PENDING_APPROVAL": ["APPROVED", "REJECTED", "ESCALATED"],
    "REJECTED": ["INVESTIGATING", "CORRECTING", "ESCALATED"],
    "APPROVED": ["CORRECTING", "RE_CALCULATING"],
    "CORRECTING": ["RE_CALCULATING", "ESCALATED"],
    "RE_CALCULATING": ["RE_VERIFICATION", "ESCALATED"],
    "RE_VERIFICATION": ["FINALIZABLE", "CORRECTING", "ESCALATED", "UNRESOLVABLE"],
    "FINALIZABLE": ["RESOLVED", "ESCALATED"],
    "ESCALATED": ["INVESTIGATING", "UNRESOLVABLE"],
    "UNRESOLVABLE": ["INVESTIGATING"],
    "RESOLVED": ["REOPENED"],
    "REOPENED": ["INVESTIGATING"],
}

#: Fixed values of the gates, in minor units, seconds and attempts.
BANDS = ((500_000, "LOW"), (5_000_000, "MEDIUM"), (50_000_000, "HIGH"))
MAX_ATTEMPTS = 3
WINDOW_S, EARLY_S = 48 * 3600, 12 * 3600

SORTS = {"amount": ["amount"], "confidence": ["score"], "date": ["created_s"], "type": ["exception_type"], "risk": ["risk"]}
MOST_ROWS = 200


def suggested_action(status: Column) -> Column:
    pairs = [F.lit(x) for pair in ACTIONS.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), status), F.lit(OTHER_ACTION))


def exception_rows(results: DataFrame, orphans: DataFrame, decisions: DataFrame) -> DataFrame:
    """A row for each result that isn't matched and each orphan credit. A result without a decision has its risk from its score."""
    own = results.where("status <> 'AUTO_MATCHED'").join(decisions.select("payment_id", "risk"), "payment_id", "left").select(
        "payment_id", "order_id", F.get("settlement_ids", F.lit(0)).alias("settlement_id"), F.nullif(F.array_join("settlement_ids", ","), F.lit("")).alias("settlements"), "bank_txn_id",
        F.coalesce(F.nullif("expected_net", F.lit(0)), F.nullif("bank_amount", F.lit(0)), "payment_amount").alias("amount"), "mismatch", "score", "status", "risk", F.col("captured_s").alias("created_s"),
    )
    none = lambda t: F.lit(None).cast(t)
    loose = orphans.select(
        none("string").alias("payment_id"), none("string").alias("order_id"), none("string").alias("settlement_id"), none("string").alias("settlements"), F.col("txn_id").alias("bank_txn_id"),
        "amount", none("long").alias("mismatch"), "score", "status", none("string").alias("risk"), none("long").alias("created_s"),
    )
    by_score = F.when(F.col("score") < 30, "HIGH").when(F.col("score") < 60, "MEDIUM").otherwise("LOW")
    rows = own.unionByName(loose).withColumn("risk", F.coalesce("risk", by_score)).withColumn("action", suggested_action(F.col("status")))
    return rows.withColumnRenamed("status", "exception_type").withColumn("state", F.lit("OPEN")).withColumn("id", F.concat(F.lit("exc_"), F.coalesce("payment_id", "bank_txn_id")))


def page(rows: DataFrame, sort: str = "risk", ascending: bool = False, number: int = 1, size: int = 50, kind: str | None = None, risk: str | None = None, state: str | None = None,
         least: int | None = None, most: int | None = None, search: str | None = None) -> DataFrame:
    """A page of the exceptions. Risks sort as text, an unknown sort means risk; ties go by score under risk and by id."""
    for name, wanted in (("exception_type", kind), ("risk", risk), ("state", state)):
        if wanted and wanted != "ALL":
            rows = rows.where(F.col(name) == wanted)
    if least is not None or most is not None:
        rows = rows.where(F.col("score").between(least or 0, 100 if most is None else most))
    if search and search.strip():
        found = [F.coalesce(F.contains(F.col(c), F.lit(search.strip())), F.lit(False)) for c in ("payment_id", "order_id", "settlement_id", "exception_type", "id")]
        rows = rows.where(found[0] | found[1] | found[2] | found[3] | found[4])
    keys = [F.col(c).asc() if ascending else F.col(c).desc() for c in SORTS.get(sort, SORTS["risk"])]
    if sort not in SORTS or sort == "risk":
        keys.append(F.col("score").asc())
    size = min(MOST_ROWS, max(1, size))
    return rows.orderBy(*keys, "id").offset((max(1, number) - 1) * size).limit(size)


def least_sure(rows: DataFrame, n: int = 5) -> DataFrame:
    return rows.where("state = 'OPEN' AND score < 70 AND exception_type NOT IN ('AUTO_MATCHED', 'PENDING_SETTLEMENT')").orderBy("score", "id").limit(n)


def to_resolve(rows: DataFrame, n: int = 5) -> DataFrame:
    kinds = ("AUTO_MATCHED", "PENDING_SETTLEMENT", "DELAYED_BANK_CREDIT")
    return rows.where((F.col("state") == "OPEN") & ~F.col("exception_type").isin(*kinds)).orderBy(F.desc("amount"), "id").limit(n)


def temporal_state(captured_s: Column, now_s: Column, settled: Column, credited: Column, window_s: int = WINDOW_S) -> Column:
    """Null if the capture time is unknown and not both are observed."""
    elapsed = F.greatest(F.lit(0), now_s - captured_s)
    return (
        F.when(settled & credited, "NOT_YET_SETTLED")
        .when(captured_s.isNull(), F.lit(None))
        .when(elapsed > window_s, "DELAYED_SETTLEMENT")
        .when(elapsed < EARLY_S, "NOT_YET_SETTLED")
        .otherwise("PENDING_SETTLEMENT")
    )


def gate(failures: Column, high: Column, medium: Column, attempts: Column) -> dict[str, Column]:
    """Columns routing, risk, escalated, end_state of a batch with so many broken invariants and risky decisions."""
    blocked = failures > 0
    return {
        "routing": F.when(blocked, "CRITICAL_BLOCKED").when(high > 0, "MAKER_CHECKER_REQUIRED").when(medium > 0, "CONTROLLED_REVIEW").otherwise("STRAIGHT_THROUGH"),
        "risk": F.when(blocked, "CRITICAL").when(high > 0, "HIGH").when(medium > 0, "MEDIUM").otherwise("LOW"),
        "escalated": blocked & (attempts >= MAX_ATTEMPTS),
        "end_state": F.when(blocked, end_state(attempts, F.lit("CRITICAL"))),
    }


def end_state(attempts: Column, risk: Column) -> Column:
    """Null while attempts are left."""
    return F.when(attempts > MAX_ATTEMPTS, F.when(risk.isin("CRITICAL", "HIGH"), "ESCALATED_TO_CONTROLLER").otherwise("PERMANENTLY_BLOCKED_PENDING_REVIEW"))


def exposure_band(amount: Column) -> Column:
    band = F.lit("CRITICAL")
    for most, name in reversed(BANDS):
        band = F.when(amount <= most, name).otherwise(band)
    return band


def risk_family(category: Column, kind: Column, currency: Column) -> Column:
    """The first family that a foreign currency or a keyword of category and type tells."""
    tidy = lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))
    text = F.concat_ws(" ", tidy(category), tidy(kind))
    families = (
        ("REFUND_VARIANCE", ("REFUND",)), ("FEE_MISMATCH", ("FEE",)), ("CHARGEBACK_RISK", ("CHARGEBACK",)), ("SLA_BREACH", ("SLA", "DELAYED")), ("DUPLICATE_CREDIT", ("DUPLICATE", "DUP_")),
        ("CROSS_CURRENCY", ("FX", "CURRENCY")), ("MISSING_CREDIT", ("MISSING",)), ("AMOUNT_VARIANCE", ("MISMATCH", "AMOUNT", "VARIANCE")),
    )
    family = F.when((F.coalesce(currency, F.lit("")) != "") & (tidy(currency) != "INR"), "CROSS_CURRENCY")
    for name, words in families:
        family = family.when(text.rlike("|".join(words)), name)
    return family.otherwise("UNCLASSIFIED")


def transition_allowed(source: Column, target: Column) -> Column:
    allowed = F.create_map(*(x for s, ts in TRANSITIONS.items() for x in (F.lit(s), F.array(*map(F.lit, ts)))))
    return F.coalesce(F.array_contains(F.element_at(allowed, source), target), F.lit(False))
