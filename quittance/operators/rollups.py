"""Sums over results, accuracy, restored balances, changed versions and the details of exceptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MONEY = ("order_amount", "payment_amount", "fee", "tax", "refund_amount", "chargeback_amount", "expected_net")


def financial_totals(results: DataFrame, exceptions: DataFrame) -> DataFrame:
    """One row: the sums of MONEY over results, and of exceptions (amount, risk) the sum and the number of each risk."""
    zero = F.lit(0)
    sums = results.agg(*(F.coalesce(F.sum(c), zero).alias(c) for c in MONEY))
    risks = exceptions.agg(F.coalesce(F.sum("amount"), zero).alias("exception_amount"), *(F.count_if(F.col("risk") == r).alias(r.lower()) for r in ("LOW", "MEDIUM", "HIGH", "CRITICAL")))
    return sums.crossJoin(risks)  # one row each


def micro_totals(per_label: DataFrame) -> DataFrame:
    """One row (tp, fp, fn, precision, recall, f1) over all labels of metrics.per_label(); shares of nothing are 0."""
    s = per_label.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    s = s.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    return s.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def pass_accuracy(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """One row (accuracy, auto_matched, exceptions, unresolved, total) of result rows (payment_id, status), orphans among them, and labels (payment_id, expected_label).

    accuracy: per cent of the labelled rows that aren't orphans, to two places; an orphan's label counts as matched. orphans count in total alone.
    """
    truth = labels.select("payment_id", F.when(F.col("expected_label") == "ORPHAN_BANK_CREDIT", "AUTO_MATCHED").otherwise(F.col("expected_label")).alias("truth"))
    real = ~F.col("payment_id").startswith("orphan_")
    told = rows.join(truth, "payment_id", "left").withColumn("judged", real & F.col("truth").isNotNull())
    n = told.agg(
        F.count_if("judged").alias("evaluated"), F.count_if(F.col("judged") & (F.col("status") == F.col("truth"))).alias("correct"), F.count_if(F.col("status") == "AUTO_MATCHED").alias("auto_matched"),
        F.count_if((F.col("status") != "AUTO_MATCHED") & real).alias("exceptions"), F.count_if(F.col("status") == "NEEDS_MANUAL_REVIEW").alias("unresolved"), F.count("*").alias("total"),
    )
    rate = F.when(F.col("evaluated") > 0, F.floor(F.col("correct") * 10000 / F.col("evaluated") + 0.5) / 100).otherwise(0.0)
    return n.select(rate.alias("accuracy"), "auto_matched", "exceptions", "unresolved", "total")


def restorations(cases: DataFrame, lines: DataFrame) -> DataFrame:
    """(tenant, transaction_id, before_difference, after_debit, after_credit, after_difference, result, proof_hash): whether journal lines restore the balance.

    cases (tenant, transaction_id, currency, debit, credit, policy), lines (tenant, transaction_id, side DEBIT or CREDIT, amount): the lower side grows by the
    lines of its kind, both sides if they are equal. VERIFIED needs equal sides, lines, and as much on both sides of the lines.
    """
    side = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("amount"))), F.lit(0))
    sums = lines.groupBy("tenant", "transaction_id").agg(F.count("*").alias("n"), side("DEBIT").alias("d"), side("CREDIT").alias("c"))
    r = cases.join(sums, ["tenant", "transaction_id"], "left").fillna(0, ["n", "d", "c"])
    debit, credit = F.col("debit"), F.col("credit")
    r = r.withColumn("after_debit", debit + F.when(debit <= credit, F.col("d")).otherwise(0)).withColumn("after_credit", credit + F.when(credit <= debit, F.col("c")).otherwise(0))
    r = r.withColumn("before_difference", F.abs(debit - credit)).withColumn("after_difference", F.abs(F.col("after_debit") - F.col("after_credit")))
    r = r.withColumn("result", F.when((F.col("after_difference") == 0) & (F.col("n") > 0) & (F.col("d") == F.col("c")), "VERIFIED").otherwise("FAILED"))
    text = [F.col(c).cast("string") for c in ("tenant", "transaction_id", "currency", "debit", "credit", "before_difference", "d", "c", "after_debit", "after_credit", "after_difference", "result")]
    proof = F.sha2(F.concat_ws(":", *text, F.coalesce("policy", F.lit("correction-policy-v1"))), 256)
    return r.select("tenant", "transaction_id", "before_difference", "after_debit", "after_credit", "after_difference", "result", proof.alias("proof_hash"))


def changed_layers(stored: DataFrame, current: dict[str, str]) -> DataFrame:
    """(run_id, replayable, changed_layers) of stored runs (run_id, versions as a map): the layers whose version isn't the current one, or that lack it."""
    names = F.array(*(F.lit(k) for k in current))
    now = F.create_map(*(x for kv in current.items() for x in map(F.lit, kv)))
    off = F.filter(names, lambda k: ~F.element_at(now, k).eqNullSafe(F.try_element_at(F.col("versions"), k)))
    return stored.select("run_id", (F.size(off) == 0).alias("replayable"), off.alias("changed_layers"))


def exception_details(exceptions: DataFrame, tables: dict[str, DataFrame], results: DataFrame, explanations: DataFrame, audit: DataFrame) -> DataFrame:
    """Each exception (id, payment_id, settlement_id, bank_txn_id) with what a page about it shows.

    Its payment, order, settlement (that named, or if none is named the first of its payment), credit, result and explanation; how many refunds and
    chargebacks its payment has, and of audit (entity_id, at_s) how many entries speak of it or its payment, and the last. The audit's OR is two equi joins:
    an entry names one of them. One shuffle by each key; every other side has a row a key.
    """
    one = lambda df, key, *cols: df.groupBy(key).agg(F.min_by(F.struct(*cols), "seq").alias("x")).select(key, *(F.col(f"x.{c}").alias(f"its_{c}") for c in cols))
    count = lambda df, name: df.groupBy("payment_id").agg(F.count("*").alias(name))
    setl = tables["settlements"]
    first = setl.groupBy("payment_id").agg(F.min_by("settlement_id", "seq").alias("first_settlement"))
    e = exceptions.select("id", "payment_id", "settlement_id", "bank_txn_id").join(first, "payment_id", "left")
    e = e.withColumn("shown_settlement", F.coalesce("settlement_id", "first_settlement")).drop("first_settlement")
    e = e.join(one(tables["payments"].withColumnRenamed("amount", "payment_amount"), "payment_id", "payment_amount", "order_id"), "payment_id", "left")
    e = e.join(one(tables["orders"].withColumnRenamed("amount", "order_amount").withColumnRenamed("order_id", "its_order_id"), "its_order_id", "order_amount"), "its_order_id", "left")
    e = e.join(one(setl.select("seq", F.col("settlement_id").alias("shown_settlement"), F.col("amount").alias("settlement_amount")), "shown_settlement", "settlement_amount"), "shown_settlement", "left")
    e = e.join(one(tables["bank"].select("seq", F.col("txn_id").alias("bank_txn_id"), F.col("amount").alias("bank_amount")), "bank_txn_id", "bank_amount"), "bank_txn_id", "left")
    e = e.join(count(tables["refunds"], "n_refunds"), "payment_id", "left").join(count(tables["chargebacks"], "n_chargebacks"), "payment_id", "left")
    e = e.join(results.select("payment_id", F.col("status").alias("result_status")), "payment_id", "left").join(explanations.select("id", "summary"), "id", "left")
    named = e.select("id", F.explode(F.array_distinct(F.array_compact(F.array("id", "payment_id")))).alias("entity_id"))
    told = named.join(audit.select("entity_id", "at_s"), "entity_id").groupBy("id").agg(F.count("*").alias("n_audit"), F.max("at_s").alias("last_audit_s"))
    return e.join(told, "id", "left").fillna(0, ["n_refunds", "n_chargebacks", "n_audit"])
