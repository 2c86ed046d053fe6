"""Queries of payments against invoices: the lines of an order, and the first of the next one, are what its payment names."""

from pyspark.sql import functions as F

from quittance.operators import invoices
from quittance.plans.base import query
from quittance.plans.cardinality import groups_sql, picked
from quittance.sources import fixtures
from quittance.sources.stored import once


def asked(spark, sf_dir):
    price = fixtures.minor(F.col("price"))
    line = fixtures.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("nr")).agg(F.max("l_extendedprice").alias("price")).select("k", "nr", price.alias("amount"))
    per = line.groupBy("k").agg(F.sum(F.when(F.col("nr") % 2 == 1, F.col("amount"))).alias("odd"), F.min_by("amount", "nr").alias("one"), F.min("amount").alias("least"))
    k = F.col("k")
    amount = F.when(k % 6 == 0, F.col("odd")).when(k % 6 == 1, F.col("odd") - 60).when(k % 6 == 2, F.col("one")).when(k % 6 == 3, F.col("least") - 1).when(k % 6 == 4, 3).otherwise(F.col("odd"))
    pay = per.where("odd IS NOT NULL").select(
        k.alias("seq"), F.concat(F.lit("p"), "k").alias("payment_id"), F.lit("t").alias("tenant"), amount.cast("long").alias("amount"), F.lit("INR").alias("currency"),
        F.when(k % 6 == 1, 100).otherwise(0).alias("tolerance"), (k % 12 != 9).alias("partial"), F.lit(8).alias("most"),
    )
    both = line.select(k.alias("of"), "k", "nr", "amount").unionByName(line.where("nr = 1").select((k - 1).alias("of"), "k", "nr", "amount"))
    both = both.unionByName(both.where("of % 24 = 5 AND nr = 2"))
    of = F.col("of")
    inv = both.select(
        F.concat(F.lit("p"), "of").alias("payment_id"), (k * 10 + F.col("nr")).alias("seq"), F.concat_ws("-", "k", "nr").alias("invoice_id"), F.when((of % 24 == 11) & (F.col("nr") == 1), "u").otherwise("t").alias("tenant"), "amount",
        F.when((of % 24 == 17) & (F.col("nr") == 1), "USD").otherwise(" inr").alias("currency"), F.when((k + F.col("nr")) % 11 == 0, "DISPUTED").otherwise("ELIGIBLE").alias("status"),
    )
    return pay, inv


def found(spark, sf_dir):
    pay, inv = asked(spark, sf_dir)
    return once(spark, "invoices", sf_dir, lambda: invoices.matched(pay, inv)), pay, inv


BEST = f"list_sort(list_filter(list_transform({groups_sql('c', 1, 8)}, lambda z: struct_pack(off := abs(z.sum - amount), n := z.n, neg := z.neg, sum := z.sum)), lambda z: z.off <= tol))[1]"
ASKED_SQL = f"""
WITH RECURSIVE line AS (SELECT l_orderkey AS k, l_linenumber AS nr, CAST(floor(max(l_extendedprice) * 100 + 0.5) AS BIGINT) AS amount FROM lineitem GROUP BY 1, 2),
pay AS (SELECT k, CAST(CASE k % 6 WHEN 1 THEN odd - 60 WHEN 2 THEN one WHEN 3 THEN least_ - 1 WHEN 4 THEN 3 ELSE odd END AS BIGINT) AS amount, CASE WHEN k % 6 = 1 THEN 100 ELSE 0 END AS tol, k % 12 <> 9 AS part FROM (
  SELECT k, sum(amount) FILTER (nr % 2 = 1) AS odd, arg_min(amount, nr) AS one, min(amount) AS least_ FROM line GROUP BY 1) WHERE odd IS NOT NULL),
inv AS (SELECT k AS f, k, nr, amount FROM line UNION ALL SELECT k - 1, k, nr, amount FROM line WHERE nr = 1),
fault AS (SELECT f AS k, arg_min(CASE WHEN f % 24 = 5 THEN 'DUPLICATE_INVOICE' WHEN f % 24 = 11 THEN 'TENANT_MISMATCH' ELSE 'MIXED_CURRENCY' END, k) AS reason FROM inv WHERE (f % 24 = 5 AND nr = 2) OR (f % 24 IN (11, 17) AND nr = 1) GROUP BY 1),
cand AS (SELECT f AS k, list(struct_pack(amount, id := k || '-' || nr) ORDER BY amount, k || '-' || nr) AS c FROM inv WHERE (k + nr) % 11 <> 0 GROUP BY 1),
q AS (SELECT pay.*, CASE WHEN fault.k IS NULL THEN coalesce(c, []) ELSE [] END AS c, reason FROM pay LEFT JOIN cand USING (k) LEFT JOIN fault USING (k)),
q1 AS (SELECT *, list_filter(c, lambda x: x.amount = amount)[1] AS e, list_filter(c, lambda x: x.amount > amount)[1] AS l, {BEST} AS b FROM q),
ans AS MATERIALIZED (SELECT k, amount, reason, len(c) AS considered, e IS NULL AND b IS NULL AND part AND l IS NOT NULL AS is_part,
  CASE WHEN reason IS NOT NULL THEN 'BLOCKED' WHEN e IS NOT NULL THEN 'EXACT_MATCH' WHEN b IS NOT NULL THEN CASE WHEN b.off = 0 THEN 'SPLIT_MATCH' ELSE 'SPLIT_MATCH_WITH_TOLERANCE' END WHEN part AND l IS NOT NULL THEN 'PARTIAL_PAYMENT' ELSE 'NO_FEASIBLE_MATCH' END AS status,
  CASE WHEN reason IS NOT NULL THEN [] WHEN e IS NOT NULL THEN [e] WHEN b IS NOT NULL THEN {picked('c', '-b.neg')} WHEN part AND l IS NOT NULL THEN [l] ELSE [] END AS got FROM q1)"""


@query(ASKED_SQL + """ SELECT 'p' || k AS payment_id, status, CASE status WHEN 'BLOCKED' THEN 'MODEL_INVALID' WHEN 'PARTIAL_PAYMENT' THEN 'FEASIBLE' WHEN 'NO_FEASIBLE_MATCH' THEN 'INFEASIBLE' ELSE 'OPTIMAL' END AS solver_status,
  array_to_string(list_transform(got, lambda x: x.id), ',') AS invoice_ids, coalesce(CAST(list_sum(list_transform(got, lambda x: x.amount)) AS BIGINT), 0) AS total, abs(coalesce(CAST(list_sum(list_transform(got, lambda x: x.amount)) AS BIGINT), 0) - amount) AS difference,
  CASE WHEN len(got) = 0 THEN 0 ELSE abs(CAST(list_sum(list_transform(got, lambda x: x.amount)) AS BIGINT) - amount) * CASE WHEN is_part THEN 1 ELSE 1000 END + CASE WHEN is_part THEN 0 ELSE len(got) END END AS objective, considered, reason FROM ans""", results=False)
def invoice_matches(spark, sf_dir):
    """Every outcome of matching payments with invoices."""
    return found(spark, sf_dir)[0].withColumn("invoice_ids", F.array_join("invoice_ids", ","))


@query(ASKED_SQL + " SELECT status, k % 7 = 0 AS spoiled, CASE WHEN status IN ('BLOCKED', 'NO_FEASIBLE_MATCH') THEN '' WHEN k % 7 = 0 THEN 'TOTAL,OBJECTIVE' ELSE '' END AS failures, count(*) AS n FROM ans GROUP BY ALL", results=False)
def invoice_checks(spark, sf_dir):
    """Answers checked anew; every seventh tells another total and objective."""
    a, pay, inv = found(spark, sf_dir)
    spoiled = F.substring("payment_id", 2, 20).cast("long") % 7 == 0
    told = a.withColumn("total", F.col("total") + spoiled.cast("int")).withColumn("objective", F.col("objective") + spoiled.cast("int"))
    v = invoices.verified(told, pay, inv).join(a.select("payment_id", "status"), "payment_id")
    return v.groupBy("status", spoiled.alias("spoiled"), F.array_join("failures", ",").alias("failures")).agg(F.count("*").alias("n"))


@query(ASKED_SQL + """, claim AS (SELECT k, list_contains(list_transform(got, lambda x: x.id), (k + 1) || '-1') AS forth, list_contains(list_transform(got, lambda x: x.id), k || '-1') AS back FROM ans WHERE len(got) > 0 AND status <> 'PARTIAL_PAYMENT'),
d(k, ok, forth) AS (SELECT k, true, forth FROM claim c WHERE NOT back OR NOT EXISTS (SELECT 1 FROM claim p WHERE p.k = c.k - 1 AND p.forth)
  UNION ALL SELECT c.k, NOT d.ok, c.forth FROM d JOIN claim c ON c.k = d.k + 1 AND c.back AND d.forth)
SELECT k AS seq, ok, CASE WHEN NOT ok THEN k || '-1' END AS conflict FROM d""", results=False)
def invoice_allocations(spark, sf_dir):
    """Which payments get the invoices that they match, where the one before may have taken one."""
    a, _, _ = found(spark, sf_dir)
    claims = a.where("status <> 'PARTIAL_PAYMENT'").select(F.substring("payment_id", 2, 20).cast("long").alias("seq"), F.posexplode("invoice_ids").alias("place", "item"))
    return invoices.allocated(claims)
