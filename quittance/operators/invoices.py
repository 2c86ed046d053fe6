"""Payments against invoices: the invoices that a payment settles, a check of that, and claims of several payments.

A payment names its candidate invoices. Of the eligible ones the CANDIDATES smallest are searched for the least
difference, then the fewest invoices, then the earliest by amount and id; sums of two halves meet in a band, and sums
beyond the payment aren't added to, so the search always ends and needs no time limit. Payments are dealt out;
each is searched in a row that holds CANDIDATES amounts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quittance.operators.groups import best_group
from quittance.operators.turns import in_turns
from quittance.sources.stored import stored

#: Invoices that are searched, that a payment may settle, that a payment may name; weight of the difference.
CANDIDATES, LARGEST, NAMED, WEIGHT = 50, 8, 500, 1000
OPEN = ("NO_FEASIBLE_MATCH", "BLOCKED")


def _same(a: Column, b: Column) -> Column:
    return F.upper(F.trim(a)) == F.upper(F.trim(b))


def faults(payments: DataFrame, invoices: DataFrame) -> DataFrame:
    """(payment_id, reason): the first thing wrong with the invoices that a payment names, in their order: TOO_MANY_INVOICES, DUPLICATE_INVOICE, TENANT_MISMATCH or MIXED_CURRENCY."""
    times = invoices.groupBy("payment_id", "invoice_id").agg(F.count("*").alias("n"), F.get(F.sort_array(F.collect_list("seq")), F.lit(1)).alias("seq"))
    twice = times.where("n > 1").select("payment_id", "seq", F.lit(0).alias("rank"), F.lit("DUPLICATE_INVOICE").alias("reason"))
    own = payments.select("payment_id", F.col("tenant").alias("own"), F.col("currency").alias("money"))
    each = invoices.join(own, "payment_id").withColumn("bad", F.when(~F.col("tenant").eqNullSafe(F.col("own")), F.struct(F.lit(1).alias("rank"), F.lit("TENANT_MISMATCH").alias("reason"))).when(~F.coalesce(_same(F.col("currency"), F.col("money")), F.lit(False)), F.struct(F.lit(2).alias("rank"), F.lit("MIXED_CURRENCY").alias("reason"))))
    wrong = each.where("bad IS NOT NULL").select("payment_id", "seq", "bad.rank", "bad.reason")
    many = invoices.groupBy("payment_id").agg(F.count("*").alias("n")).where(F.col("n") > NAMED).select("payment_id", F.lit(None).cast("long").alias("seq"), F.lit(-1).alias("rank"), F.lit("TOO_MANY_INVOICES").alias("reason"))
    return twice.unionByName(wrong).unionByName(many).groupBy("payment_id").agg(F.min(F.struct("seq", "rank", "reason")).alias("x")).select("payment_id", "x.reason")  # a null seq comes first


FOUND = "payment_id string, status string, solver_status string, invoice_ids array<string>, total long, difference long, objective long, considered int"


def settle(amounts: np.ndarray, ids: list[str], target: int, tolerance: int, most: int, partial: bool, cut: bool) -> tuple:
    """(status, solver_status, invoice_ids, total, difference, objective) of one payment; amounts ascend."""
    exact = np.flatnonzero(amounts == target)
    if len(exact):
        return "EXACT_MATCH", "OPTIMAL", [ids[exact[0]]], target, 0, 1
    found = best_group(amounts[amounts <= target + tolerance], target, tolerance, most, 1)
    if found is not None:
        total = int(amounts[found].sum())
        off = abs(total - target)
        return "SPLIT_MATCH_WITH_TOLERANCE" if off else "SPLIT_MATCH", "FEASIBLE" if cut else "OPTIMAL", [ids[i] for i in found], total, off, off * WEIGHT + len(found)
    larger = np.flatnonzero(amounts > target)
    if partial and len(larger):
        rest = int(amounts[larger[0]]) - target
        return "PARTIAL_PAYMENT", "FEASIBLE", [ids[larger[0]]], int(amounts[larger[0]]), rest, rest
    return "NO_FEASIBLE_MATCH", "INFEASIBLE", [], 0, target, 0


def matched(payments: DataFrame, invoices: DataFrame) -> DataFrame:
    """(payment_id, status, solver_status, invoice_ids, total, difference, objective, considered, reason) of every payment.

    payments (payment_id, tenant, amount, currency, tolerance, partial, most), invoices (payment_id, seq, invoice_id, tenant, amount, currency, status).
    A payment with a fault is BLOCKED, one without an eligible invoice finds nothing. Null payment_ids of invoices name no payment; null amounts aren't
    eligible. FEASIBLE says that larger invoices were left out of the search, or that a payment covers a part of one.
    """
    bad = stored(faults(payments, invoices), "invoice-faults")
    good = invoices.where("status = 'ELIGIBLE' AND amount IS NOT NULL").join(bad, "payment_id", "left_anti")
    whole = Window.partitionBy("payment_id")  # NAMED rows at most
    near = good.withColumn("place", F.row_number().over(whole.orderBy("amount", "invoice_id"))).withColumn("n", F.count("*").over(whole)).where(F.col("place") <= CANDIDATES)
    rows = near.groupBy("payment_id").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("place", "amount", "invoice_id"))).alias("near"))
    asked = payments.join(bad, "payment_id", "left").join(rows, "payment_id", "left")
    tasks = int(payments.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a search takes longer than its bytes tell
    asked = stored(asked.select("payment_id", "amount", "tolerance", "partial", "most", "n", "near", "reason"), "invoices-asked").repartition(tasks, "payment_id")

    def search(frames):
        for frame in frames:
            out = []
            for p in frame.itertuples(index=False):
                listed = [tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in (p.near if p.near is not None else ())]
                amounts, ids = np.array([x[1] for x in listed], np.int64), [x[2] for x in listed]
                out.append((p.payment_id, *settle(amounts, ids, int(p.amount), int(p.tolerance), min(int(p.most), LARGEST), bool(p.partial), len(listed) > 0 and p.n > CANDIDATES), len(listed)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FOUND.split(", ")])

    found = asked.where("reason IS NULL").drop("reason").mapInPandas(search, FOUND).withColumn("reason", F.lit(None).cast("string"))
    none = asked.where("reason IS NOT NULL").select(
        "payment_id", F.lit("BLOCKED").alias("status"), F.lit("MODEL_INVALID").alias("solver_status"), F.array().cast("array<string>").alias("invoice_ids"),
        F.lit(0).cast("long").alias("total"), F.col("amount").alias("difference"), F.lit(0).cast("long").alias("objective"), F.lit(0).alias("considered"), "reason",
    )
    return found.unionByName(none)


def verified(answers: DataFrame, payments: DataFrame, invoices: DataFrame) -> DataFrame:
    """(payment_id, failures): what is wrong with an answer, recomputed from the invoices; an empty array if nothing is.

    Ids chosen twice, not named, of another tenant or not eligible; too many or none chosen; a status that is no match; total, difference
    and objective that differ from those computed anew; a difference beyond the tolerance; a partial payment that isn't one.
    """
    chosen = answers.select("payment_id", F.explode("invoice_ids").alias("invoice_id")).groupBy("payment_id", "invoice_id").agg(F.count("*").alias("times"))
    own = payments.select("payment_id", F.col("tenant").alias("own"))
    named = invoices.groupBy("payment_id", "invoice_id").agg(F.min("amount").alias("amount"), F.min("tenant").alias("tenant"), F.min("status").alias("state"))
    each = chosen.join(named, ["payment_id", "invoice_id"], "left").join(own, "payment_id")
    none = F.lit(False)
    per = each.groupBy("payment_id").agg(
        F.coalesce(F.sum(F.col("amount") * F.col("times")), F.lit(0)).alias("sum"), F.bool_or(F.col("times") > 1).alias("twice"), F.bool_or(F.col("amount").isNull()).alias("unknown"),
        F.coalesce(F.bool_or(F.col("tenant") != F.col("own")), none).alias("foreign"), F.coalesce(F.bool_or(F.col("state") != "ELIGIBLE"), none).alias("closed"),
    )
    r = answers.join(payments.select("payment_id", "amount", "tolerance", "most"), "payment_id").join(per, "payment_id", "left").fillna(0, ["sum"]).fillna(False, ["twice", "unknown", "foreign", "closed"])
    n, part = F.size("invoice_ids"), F.col("status") == "PARTIAL_PAYMENT"
    off = F.when(part, F.col("sum") - F.col("amount")).otherwise(F.abs(F.col("sum") - F.col("amount")))
    tests = {
        "DUPLICATE_ID": F.col("twice"), "UNKNOWN_ID": F.col("unknown"), "OTHER_TENANT": F.col("foreign"), "NOT_ELIGIBLE": F.col("closed"), "TOO_MANY": ~part & (n > F.col("most")), "EMPTY": n == 0,
        "SOLVER_STATUS": ~F.col("solver_status").isin("OPTIMAL", "FEASIBLE"), "TOTAL": F.col("sum") != F.col("total"), "NOT_PARTIAL": part & ((n != 1) | (F.col("amount") >= F.col("sum"))),
        "BEYOND_TOLERANCE": ~part & (off > F.col("tolerance")), "DIFFERENCE": off != F.col("difference"), "OBJECTIVE": F.col("objective") != F.when(part, off).otherwise(off * WEIGHT + n),
    }
    told = F.array_compact(F.array(*(F.when(wrong, name) for name, wrong in tests.items())))
    nothing = F.when(n > 0, F.array(F.lit("CHOSEN_WITHOUT_A_MATCH"))).otherwise(F.array().cast("array<string>"))
    return r.select("payment_id", F.when(F.col("status").isin(*OPEN), nothing).otherwise(told).alias("failures"))


def _claim(taken: set, rows: list[tuple]) -> list[tuple]:
    items = {r[1] for r in rows}
    ok = not items & taken
    if ok:
        taken |= items
    return [(rows[0][0], ok)]


def _round(open_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Payments that come first at all their invoices have them; those that want one of these have none."""
    first = F.min("seq").over(Window.partitionBy("item")) == F.col("seq")
    ready = open_.withColumn("first", first).groupBy("seq").agg(F.bool_and("first").alias("ok")).where("ok")
    won = stored(open_.join(ready.select("seq"), "seq", "left_semi"), "claims-won")
    rest = open_.join(won.select("seq").distinct(), "seq", "left_anti")
    lost = stored(rest.join(won.select("item").distinct(), "item", "left_semi").select("seq").distinct(), "claims-lost")
    left = stored(rest.join(lost, "seq", "left_anti").select("seq", "item"), "claims")
    return won.select("seq").distinct().withColumn("ok", F.lit(True)).unionByName(lost.withColumn("ok", F.lit(False))), left


def allocated(claims: DataFrame, one_pass: int | None = None) -> DataFrame:
    """(seq, ok, conflict): whether the payment seq gets all it claims, in the order of seq, and else the first of its items that an earlier one has.

    claims (seq, place, item): an item is an invoice of a tenant. All or nothing: a payment that loses one takes none.
    """
    done = stored(in_turns(claims.select("seq", "item").distinct(), "seq", "item", ["item"], _claim, "seq long, ok boolean", _round, one_pass), "allocations")
    has = claims.join(done.where("ok"), "seq", "left_semi").select("item", F.col("seq").alias("holder")).distinct()
    clash = claims.join(done.where("NOT ok"), "seq", "left_semi").join(has, "item").where("holder < seq").groupBy("seq").agg(F.min_by("item", "place").alias("conflict"))
    return done.join(clash, "seq", "left")
