"""Queries of sums, accuracy, restored balances, versions and details of exceptions."""

from pyspark.sql import functions as F

from quittance.operators import metrics, rollups
from quittance.plans.base import ORACLE_SQL, query
from quittance.plans.registry import orphans_of, pairs, results, truths
from quittance.plans.review import EXC_SQL, TRUTH_SQL, rows_of
from quittance.sources import fixtures


@query(EXC_SQL + """SELECT *, (SELECT CAST(sum(amount) AS BIGINT) FROM exc) AS exception_amount, (SELECT count(*) FROM exc WHERE risk = 'LOW') AS low, (SELECT count(*) FROM exc WHERE risk = 'MEDIUM') AS medium, (SELECT count(*) FROM exc WHERE risk = 'HIGH') AS high, (SELECT count(*) FROM exc WHERE risk = 'CRITICAL') AS critical
FROM (SELECT """ + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in rollups.MONEY) + " FROM r)")
def financial_totals(spark, sf_dir):
    return rollups.financial_totals(results(spark, sf_dir)[0], rows_of(spark, sf_dir))


@query("SELECT *, CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0.0 END AS f1 FROM (SELECT tp, fp, fn, tp::DOUBLE / (tp + fp) AS p, tp::DOUBLE / (tp + fn) AS q FROM (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM (" + ORACLE_SQL["per_label_metrics"] + ")))", results=False)
def micro_totals(spark, sf_dir):
    return rollups.micro_totals(metrics.per_label(pairs(spark, sf_dir))).withColumnsRenamed({"precision": "p", "recall": "q"})


@query(f""", a AS (SELECT payment_id, status FROM r UNION ALL SELECT payment_id, status FROM orphans), t AS (SELECT a.*, CASE WHEN pay.payment_id IS NOT NULL THEN {TRUTH_SQL} END AS truth FROM a LEFT JOIN pay USING (payment_id))
SELECT floor(count(*) FILTER (status = truth) * 10000.0 / count(truth) + 0.5) / 100 AS accuracy, count(*) FILTER (status = 'AUTO_MATCHED') AS auto_matched, count(*) FILTER (status <> 'AUTO_MATCHED' AND NOT starts_with(payment_id, 'orphan_')) AS exceptions,
  count(*) FILTER (status = 'NEEDS_MANUAL_REVIEW') AS unresolved, count(*) AS total FROM t""")
def pass_accuracy(spark, sf_dir):
    r, b = results(spark, sf_dir)
    rows = r.select("payment_id", "status").unionByName(orphans_of(r, b).select("payment_id", "status"))
    return rollups.pass_accuracy(rows, truths(b["payments"]))


@query("""WITH o AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS amount FROM orders), c AS (SELECT k, amount AS debit, amount + CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN 500 WHEN 2 THEN -700 ELSE 3 END AS credit,
  CASE k % 4 WHEN 1 THEN 500 WHEN 2 THEN 700 WHEN 3 THEN 2 ELSE 0 END AS d, CASE k % 4 WHEN 1 THEN 500 WHEN 2 THEN 700 WHEN 3 THEN 3 ELSE 0 END AS c, k % 4 <> 0 AS has FROM o),
a AS (SELECT *, abs(debit - credit) AS bd, debit + CASE WHEN debit <= credit THEN d ELSE 0 END AS ad, credit + CASE WHEN credit <= debit THEN c ELSE 0 END AS ac FROM c),
v AS (SELECT *, CASE WHEN ad = ac AND has AND d = c THEN 'VERIFIED' ELSE 'FAILED' END AS result FROM a)
SELECT 't' AS tenant, k AS transaction_id, bd AS before_difference, ad AS after_debit, ac AS after_credit, abs(ad - ac) AS after_difference, result,
  sha256(concat_ws(':', 't', k, 'INR', debit, credit, bd, d, c, ad, ac, abs(ad - ac), result, CASE WHEN k % 3 = 0 THEN 'v2' ELSE 'correction-policy-v1' END)) AS proof_hash FROM v""", results=False)
def restorations(spark, sf_dir):
    k = F.col("transaction_id")
    o = fixtures.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("transaction_id"), fixtures.minor(F.col("o_totalprice")).alias("debit"))
    off = F.when(k % 4 == 0, 0).when(k % 4 == 1, 500).when(k % 4 == 2, -700).otherwise(3)
    cases = o.select(F.lit("t").alias("tenant"), "transaction_id", F.lit("INR").alias("currency"), "debit", (F.col("debit") + off).alias("credit"), F.when(k % 3 == 0, "v2").alias("policy"))
    line = lambda side, amount: F.struct(F.lit(side).alias("side"), amount.cast("long").alias("amount"))
    size = F.abs(off)
    lines = o.where("transaction_id % 4 <> 0").select(F.lit("t").alias("tenant"), "transaction_id", F.explode(F.array(line("DEBIT", F.when(k % 4 == 3, 2).otherwise(size)), line("CREDIT", size))).alias("x")).select("tenant", "transaction_id", "x.*")
    return rollups.restorations(cases, lines)


@query("SELECT o_orderkey AS run_id, o_orderkey % 6 IN (0, 3) AS replayable, CASE o_orderkey % 6 WHEN 1 THEN 'rules' WHEN 2 THEN 'matcher' WHEN 4 THEN 'rules,fx' WHEN 5 THEN 'matcher,rules,fx' ELSE '' END AS changed_layers FROM orders", results=False)
def changed_layers(spark, sf_dir):
    k = F.col("o_orderkey") % 6
    runs = fixtures.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.when(k == 5, F.create_map(F.lit("other"), F.lit("1"))).otherwise(
            F.create_map(F.lit("matcher"), F.when(k == 2, "1").otherwise("2"), F.lit("rules"), F.when(k.isin(1, 4), "6").otherwise("7"), F.lit("fx"), F.when(k == 4, F.lit(None)).otherwise("9"))
        ).alias("versions"),
    )
    return rollups.changed_layers(runs, {"matcher": "2", "rules": "7", "fx": "9"}).withColumn("changed_layers", F.array_join("changed_layers", ","))


@query(EXC_SQL + """SELECT e.id, e.payment_id, coalesce(e.settlement_id, f.s) AS shown_settlement, p.amount AS payment_amount, o.amount AS order_amount, s.amount AS settlement_amount, b.amount AS bank_amount,
  (SELECT count(*) FROM refunds x WHERE x.payment_id = e.payment_id) AS n_refunds, (SELECT count(*) FROM chargebacks x WHERE x.payment_id = e.payment_id) AS n_chargebacks, r.status AS result_status, CASE WHEN length(e.id) % 2 = 0 THEN 'about ' || e.id END AS summary,
  CASE WHEN p.seq % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN p.seq % 3 = 0 THEN 2 ELSE 0 END AS n_audit, CASE WHEN p.seq % 3 = 0 THEN p.seq + 2 WHEN p.seq % 2 = 0 THEN p.seq END AS last_audit_s
FROM exc e LEFT JOIN (SELECT payment_id, arg_min(settlement_id, seq) AS s FROM setl GROUP BY 1) f ON f.payment_id = e.payment_id LEFT JOIN pay p ON p.payment_id = e.payment_id
LEFT JOIN (SELECT order_id, arg_min(amount, seq) AS amount FROM ords GROUP BY 1) o ON o.order_id = p.order_id LEFT JOIN setl s ON s.settlement_id = coalesce(e.settlement_id, f.s) LEFT JOIN bank b ON b.txn_id = e.bank_txn_id LEFT JOIN r ON r.payment_id = e.payment_id""")
def exception_details(spark, sf_dir):
    """Every exception with its records; entries of the audit name the exception or its payment."""
    r, b = results(spark, sf_dir)
    e = rows_of(spark, sf_dir)
    keyed = e.select("id", "payment_id").join(b["payments"].select("payment_id", "seq"), "payment_id")
    audit = keyed.where("seq % 2 = 0").select(F.col("id").alias("entity_id"), F.col("seq").alias("at_s")).unionByName(
        keyed.where("seq % 3 = 0").select(F.col("payment_id").alias("entity_id"), F.explode(F.array(F.col("seq") + 1, F.col("seq") + 2)).alias("at_s"))
    )
    told = e.where("length(id) % 2 = 0").select("id", F.concat(F.lit("about "), "id").alias("summary"))
    d = rollups.exception_details(e, b, r, told, audit)
    return d.select("id", "payment_id", "shown_settlement", *(F.col(f"its_{c}").alias(c) for c in ("payment_amount", "order_amount", "settlement_amount", "bank_amount")), "n_refunds", "n_chargebacks", "result_status", "summary", "n_audit", "last_audit_s")
