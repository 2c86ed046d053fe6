"""Late adjustments, corrections, proofs of balance, versions and fingerprints of ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Debit and credit account of a correction by its type and the side that lacks.
ACCOUNTS = (
    ("SETTLEMENT_VARIANCE", "DEBIT", "SETTLEMENT_VARIANCE_CLEARING", "SETTLEMENT_RECEIVABLE"),
    ("SETTLEMENT_VARIANCE", "CREDIT", "SETTLEMENT_RECEIVABLE", "SETTLEMENT_VARIANCE_CLEARING"),
    ("MISSING_DEBIT", None, "ACCOUNTS_RECEIVABLE", "SUSPENSE_CLEARING"),
    ("MISSING_CREDIT", None, "SUSPENSE_CLEARING", "SETTLEMENT_RECEIVABLE"),
    ("DUPLICATE_POSTING_REVERSAL", None, "SUSPENSE_CLEARING", "BANK_CLEARING"),
    ("FEE_ADJUSTMENT", None, "PAYMENT_PROCESSING_FEES", "SETTLEMENT_RECEIVABLE"),
)
LATENCY_BOUNDS = (5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000)


def judged(entries: DataFrame, events: DataFrame) -> DataFrame:
    """events with effective_net, adjustment_id and what speaks against each (error, else null)."""
    own = entries.select("entry_id", "gross", "net", F.lit(True).alias("there"))
    net = F.col("net") + F.col("amount")
    error = F.when(F.col("there").isNull(), "PARENT_LEDGER_ENTRY_NOT_FOUND").when((net < 0) | (net > F.col("gross")), "INVARIANT_BREACH")
    digest = F.sha2(F.concat_ws("|", "entry_id", "event_id", F.col("amount").cast("string"), "key"), 256)
    return events.join(own, "entry_id", "left").select(*events.columns, net.alias("effective_net"), error.alias("error"), F.concat(F.lit("adj_"), F.substring(digest, 1, 16)).alias("adjustment_id"))


def adjust(entries: DataFrame, events: DataFrame) -> DataFrame:
    """(event_id, status, adjustment_id, effective_net) of late events (seq, event_id, entry_id, key, amount) on entries (entry_id, gross, net).

    Entries never change; an adjustment hangs on one and must leave its net between 0 and its gross. Of the
    events of a key the first that is valid is applied, those after it are duplicates and name its
    adjustment, those before it are rejected.
    """
    told = judged(entries, events)
    first = told.where("error IS NULL").groupBy("key").agg(F.min_by(F.struct("seq", "adjustment_id", "effective_net"), "seq").alias("f"))
    applied, later = F.col("seq") == F.col("f.seq"), F.col("seq") > F.col("f.seq")
    return told.join(first, "key", "left").select(
        "event_id",
        F.when(applied, "APPLIED").when(later, "DUPLICATE").otherwise(F.col("error")).alias("status"),
        F.when(applied | later, F.col("f.adjustment_id")).alias("adjustment_id"),
        F.when(applied | later, F.col("f.effective_net")).alias("effective_net"),
    )


def correction_lines(imbalances: DataFrame) -> DataFrame:
    """(txn_id, side, account, amount): one debit and one credit for each of imbalances (txn_id, type, debit, credit) that a rule covers.

    Equal sides need none, and unknown types get none.
    """
    lacks = F.when(F.col("debit") < F.col("credit"), "DEBIT").otherwise("CREDIT")
    account = lambda i: F.coalesce(*(F.when((F.col("type") == a[0]) & (F.lit(True) if a[1] is None else lacks == a[1]), a[i]) for a in ACCOUNTS))
    lines = F.array(*(F.struct(F.lit(side).alias("side"), account(i).alias("account")) for side, i in (("DEBIT", 2), ("CREDIT", 3))))
    rows = imbalances.where("debit <> credit").select("txn_id", F.abs(F.col("debit") - F.col("credit")).alias("amount"), F.explode(lines).alias("l"))
    return rows.where("l.account IS NOT NULL").select("txn_id", "l.side", "l.account", "amount")


def double_entry(lines: DataFrame, by: str) -> DataFrame:
    """(by, debits, credits, balanced) of journal lines (side, amount)."""
    total = lambda side: F.sum(F.when(F.col("side") == side, F.col("amount")).otherwise(0))
    return lines.groupBy(by).agg(total("DEBIT").alias("debits"), total("CREDIT").alias("credits")).withColumn("balanced", F.col("debits") == F.col("credits"))


def violated(gross: Column, fee: Column, tax: Column, refund: Column, chargeback: Column, settled: Column, variance: Column, debits: Column, credits: Column, allocated: Column, available: Column, tolerance: int = 0) -> Column:
    """The first theorem that does not hold, null if all do: conservation, parity, single use of a credit, no negative amount."""
    net = gross - fee - tax - refund - chargeback
    return (
        F.when(F.abs(net - settled - variance) > tolerance, "CONSERVATION_EQUATION_MISMATCH")
        .when(debits != credits, "DOUBLE_ENTRY_IMBALANCE")
        .when(allocated > available, "CREDIT_OVER_ALLOCATION")
        .when(F.least(gross, fee, tax, refund, chargeback, settled) < 0, "NEGATIVE_DOMAIN_VIOLATION")
    )


def superseded(ledger: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The ledger with new rows (key and values) as the active version of their keys, numbered on; what was active before stays as superseded.

    New rows hold a key once. Keys meet in one aggregate and one join; no row of the ledger is lost.
    """
    last = ledger.groupBy(key).agg(F.max("version").alias("last"))
    fresh = new.join(last, key, "left").withColumn("version", (F.coalesce("last", F.lit(0)) + 1).cast("int")).withColumn("state", F.lit("ACTIVE")).drop("last")
    old = ledger.join(new.select(key, F.lit(True).alias("replaced")), key, "left")
    old = old.withColumn("state", F.when(F.col("replaced") & (F.col("state") == "ACTIVE"), "SUPERSEDED").otherwise(F.col("state"))).drop("replaced")
    return old.unionByName(fresh)


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of old and new by key, a new value over an old one unless it is null; both hold a key once."""
    rest = [c for c in old.columns if c != key]
    n = new.select(key, *(F.col(c).alias(f"new_{c}") for c in rest))
    return old.join(n, key, "full").select(key, *(F.coalesce(f"new_{c}", c).alias(c) for c in rest))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row (n, fingerprint) that equal rows give in any order: the digest of the sums of the rows' digests, in four parts.

    A column counts as text, null as a mark of its own; the order of columns counts.
    """
    body = F.concat_ws("|", *(F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns))
    digest = F.sha2(body, 256)
    part = lambda i: F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).alias(f"p{i}")
    sums = df.agg(F.count("*").alias("n"), *(part(i) for i in range(4)))
    text = lambda i: F.coalesce(F.col(f"p{i}").cast("string"), F.lit("0"))
    return sums.select("n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), *(text(i) for i in range(4))), 256).alias("fingerprint"))


def tenant_rollup(rows: DataFrame, tenant: str) -> DataFrame:
    """(tenant, n, matched, rate, gross, settled, discrepancy, conserved) by tenant and, with a null tenant, in all; rate in tenths of a per cent."""
    s = rows.rollup(tenant).agg(F.count("*").alias("n"), F.count_if("matched").alias("matched"), F.sum("gross").alias("gross"), F.sum("settled").alias("settled"), F.sum("discrepancy").alias("discrepancy"))
    rate = F.floor(F.col("matched") * 1000 / F.col("n") + 0.5).cast("long")
    return s.select(F.col(tenant).alias("tenant"), "n", "matched", rate.alias("rate"), "gross", "settled", "discrepancy", (F.col("gross") - F.col("settled") == F.col("discrepancy")).alias("conserved"))


def histogram(rows: DataFrame, label: str, value: str, bounds: tuple[int, ...] = LATENCY_BOUNDS) -> DataFrame:
    """(label, le, n, total): how many values are at most le, and with a null le how many there are and their sum."""
    counts = rows.groupBy(label).agg(F.sum(value).alias("total"), F.count("*").alias("all"), *(F.count_if(F.col(value) <= b).alias(f"n{b}") for b in bounds))
    none = F.lit(None).cast("long")
    cells = [F.struct(F.lit(b).cast("long").alias("le"), F.col(f"n{b}").alias("n"), none.alias("total")) for b in bounds]
    cells.append(F.struct(none.alias("le"), F.col("all").alias("n"), F.col("total").cast("long").alias("total")))
    return counts.select(label, F.explode(F.array(*cells)).alias("x")).select(label, "x.*")


def partition_invariants(settlements: DataFrame, credits: DataFrame, matches: DataFrame) -> DataFrame:
    """(name, actual, expected, holds) over all partitions: each id used once, each accounted for, money conserved.

    settlements (settlement_id, resolved) and credits (txn_id, resolved) are the inputs; matches (settlement_id, txn_id, settled, credited, difference).
    """
    zero = F.lit(0).cast("long")
    row = lambda name, df, actual, expected: df.select(F.lit(name).alias("name"), actual.cast("long").alias("actual"), expected.cast("long").alias("expected"), (actual == expected).alias("holds"))

    def checks(side: str, inputs: DataFrame, id_: str) -> DataFrame:
        used = matches.groupBy(id_).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("twice"), F.count("*").alias("matched"))
        there = inputs.groupBy(id_).agg(F.count_if(~F.col("resolved")).alias("open")).agg(F.count("*").alias("inputs"), F.coalesce(F.sum("open"), zero).alias("open"))
        both = used.crossJoin(there)  # one row each
        return row(f"{side}_USED_ONCE", both, F.col("twice"), zero).unionByName(row(f"{side}_COMPLETE", both, F.col("matched") + F.col("open"), F.col("inputs")))

    sums = matches.agg(*(F.coalesce(F.sum(c), zero).alias(c) for c in ("settled", "credited", "difference")))
    return checks("SETTLEMENT", settlements, "settlement_id").unionByName(checks("CREDIT", credits, "txn_id")).unionByName(row("MONEY_CONSERVED", sums, F.abs(F.col("settled") - F.col("credited")), F.col("difference")))
