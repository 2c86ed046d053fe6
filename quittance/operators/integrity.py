"""Invariants, duplicate consumption, indexed aggregation, ledger rows and hash chains."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quittance.operators.turns import streamed


def tolerance(x: Column) -> Column:
    return F.greatest(F.lit(100), F.floor(F.abs(x) * 0.001 + 0.5).cast("long"))


def invariants(payments: DataFrame, results: DataFrame, settlements: DataFrame, bank: DataFrame, refunds: DataFrame, chargebacks: DataFrame) -> DataFrame:
    """(name, actual, expected, holds) of six checks; each side is a sum over the whole table, one row."""
    missing = payments.join(results.select("payment_id"), "payment_id", "left_anti").agg(F.count("*").alias("x"))
    sums = payments.agg(F.sum(F.expr("amount - fee - tax")).alias("p"))
    total = lambda df: df.agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("s"))
    net = results.agg(F.sum("expected_net").alias("n"))
    r, c, debit = total(refunds), total(chargebacks), total(bank.where("type = 'DEBIT'"))
    attributed = results.where("bank_txn_id IS NOT NULL").select(F.col("bank_txn_id").alias("txn_id"))
    loose = bank.where("type = 'CREDIT'").join(attributed, "txn_id", "left_anti").join(settlements.where("utr IS NOT NULL").select("utr"), "utr", "left_anti")
    twice = attributed.groupBy("txn_id").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("x"))
    unreferenced = settlements.join(results.select(F.explode("settlement_ids").alias("settlement_id")), "settlement_id", "left_anti").agg(F.count("*").alias("x"))
    one = lambda name, df, actual, expected, tol: df.select(F.lit(name).alias("name"), actual.cast("long").alias("actual"), expected.cast("long").alias("expected"), (F.abs(actual - expected) <= tol).alias("holds"))
    zero = F.lit(0)
    due = F.col("p") - F.col("r.s") - F.col("c.s")
    return (
        one("INPUT_COMPLETE", missing, F.col("x"), zero, zero)
        .unionByName(one("NET_CONSERVED", net.crossJoin(sums).crossJoin(r.alias("r")).crossJoin(c.alias("c")), F.col("n"), due, tolerance(due)))
        .unionByName(one("CREDITS_EXPLAINED", total(loose), F.col("s"), zero, F.lit(100)))
        .unionByName(one("DEBITS_EXPLAINED", debit.alias("d").crossJoin(c.alias("c")), F.col("d.s"), F.col("c.s"), tolerance(F.col("c.s"))))
        .unionByName(one("CONSUMED_ONCE", twice, F.col("x"), zero, zero))
        .unionByName(one("SETTLEMENTS_REFERENCED", unreferenced, F.col("x"), zero, zero))
    )


def indexed_aggregation(settlements: DataFrame, bank: DataFrame, bucket_s: int = 96 * 3600, tol: int = 100) -> DataFrame:
    """Per reference and time bucket: settlements that add up to one credit."""
    s = settlements.where("utr IS NOT NULL").groupBy("utr", F.floor(F.col("settled_s") / bucket_s).alias("bucket")).agg(F.count("*").alias("n_settlements"), F.sum("amount").alias("settled"))
    b = bank.where("type = 'CREDIT'").select("utr", F.floor(F.col("txn_s") / bucket_s).alias("bucket"), F.col("amount").alias("credited"), "txn_id")
    return s.join(b, ["utr", "bucket"]).where(F.abs(F.col("settled") - F.col("credited")) <= tol).select("utr", "txn_id", "bucket", "n_settlements", "settled", "credited")


def ledger(results: DataFrame, decisions: DataFrame, version: int = 1) -> DataFrame:
    d = decisions.select("payment_id", "outcome", "risk")
    rows = results.join(d, "payment_id", "left").select("seq", "payment_id", F.lit(version).alias("version"), "expected_net", "settled_amount", "status", "score", "outcome", "risk")
    body = F.concat_ws("|", "payment_id", F.col("version").cast("string"), F.col("expected_net").cast("string"), F.coalesce(F.col("settled_amount").cast("string"), F.lit("")), "status", F.col("score").cast("string"))
    return rows.withColumn("entry_hash", F.sha2(body, 256))


GENESIS = "0" * 64


def chain_link(previous: Column, payload: Column) -> Column:
    return F.sha2(F.concat(previous, payload), 256)


def chained(events: DataFrame, group: str) -> DataFrame:
    """events (group, seq, payload) with previous_hash and hash: each link is the digest of the one before and the payload.

    A chain can only be made in order: each group is streamed through a task, which holds one hash.
    """

    def link(last: list, rows: list[tuple]) -> list[tuple]:
        out = []
        for id_, seq, payload in rows:
            last.append(hashlib.sha256(f"{last[0]}{payload}".encode()).hexdigest())
            out.append((id_, seq, payload, last.pop(0), last[0]))
        return out

    kind = dict(events.dtypes)
    rows = events.select(F.col(group).cast("string").alias("part"), F.col(group).alias("grp"), F.col("seq").cast("long"), "payload")
    made = streamed(rows, "part", "seq", ["payload"], link, f"grp {kind[group]}, seq long, payload string, previous_hash string, hash string", lambda: [GENESIS])
    return made.withColumnRenamed("grp", group)


def verified_chains(chain: DataFrame, group: str) -> DataFrame:
    """(group, n, valid, reason, seq): the first thing wrong with each chain of rows (group, seq, payload, previous_hash, hash), null if nothing is.

    In order of seq: BAD_GENESIS, SEQ_GAP_OR_REORDER (numbers must run from 0 without a gap or repetition), HASH_MISMATCH (the row's own
    digest is recomputed), LINK_BROKEN. A row meets the one before by an equi join on its number, so a long chain is dealt out, not sorted in one task.
    """
    each = chain.groupBy(group, "seq").agg(F.count("*").alias("times"), F.min(F.struct("previous_hash", "hash", "payload")).alias("x")).select(group, "seq", "times", "x.*")
    before = each.select(group, (F.col("seq") + 1).alias("seq"), F.col("hash").alias("due"), F.lit(True).alias("follows"))
    ends = chain.groupBy(group).agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    told = each.join(before, [group, "seq"], "left").join(ends, group)
    start = F.col("seq") == F.col("first")
    reason = (
        F.when(start & ~F.col("previous_hash").eqNullSafe(GENESIS), F.struct(F.lit(0).alias("rank"), F.lit("BAD_GENESIS").alias("reason")))
        .when(F.when(start, F.col("seq") != 0).otherwise(F.col("follows").isNull()), F.struct(F.lit(1).alias("rank"), F.lit("SEQ_GAP_OR_REORDER").alias("reason")))
        .when(~F.col("hash").eqNullSafe(chain_link(F.col("previous_hash"), F.col("payload"))), F.struct(F.lit(2).alias("rank"), F.lit("HASH_MISMATCH").alias("reason")))
        .when(~start & ~F.col("previous_hash").eqNullSafe(F.col("due")), F.struct(F.lit(3).alias("rank"), F.lit("LINK_BROKEN").alias("reason")))
        .when(F.col("times") > 1, F.struct(F.lit(4).alias("rank"), F.lit("SEQ_GAP_OR_REORDER").alias("reason")))
    )
    found = told.withColumn("bad", reason)
    first = F.min(F.when(F.col("bad").isNotNull(), F.struct("seq", "bad.rank", "bad.reason")))
    per = found.groupBy(group).agg(F.max("n").alias("n"), first.alias("at"))
    return per.select(group, "n", F.col("at").isNull().alias("valid"), F.col("at.reason").alias("reason"), F.col("at.seq").alias("seq"))
