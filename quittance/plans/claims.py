"""Queries of claims: every order is a case with a payment, most with a settlement, three items of evidence and two claims."""

from pyspark.sql import functions as F

from quittance.operators import claims
from quittance.plans.base import query
from quittance.plans.records import chosen
from quittance.sources import fixtures

STATEMENTS = ("The refund explains all", "Paid in full", "It is within tolerance", "A VARIANCE by fees", None)
TYPES = ("AMOUNT", "TIMING", "FINANCIAL_EXPLANATION", None, "POLICY")
ACCESS = ("PUBLIC", "INTERNAL", "HIGHLY_RESTRICTED", "CONFIDENTIAL", "INTERNAL", "PUBLIC", "INTERNAL", "RESTRICTED_CLEARANCE_REQUIRED", None)


def asked(spark, sf_dir):
    k = F.col("k")
    o = fixtures.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), fixtures.minor(F.col("o_totalprice")).alias("amount"))
    none = F.lit(None)
    pid, sid = F.when(k % 17 != 0, F.concat(F.lit("p"), k)), F.when(k % 17 > 1, F.concat(F.lit("s"), k))
    fee, refund = F.floor(F.col("amount") / 50), F.when(k % 4 == 0, 500)
    cases = o.select(
        F.concat(F.lit("x"), k).alias("case_id"), pid.alias("payment_id"), sid.alias("settlement_id"), F.concat(F.lit("U"), k).alias("utr"), F.col("amount").alias("gross"), fee.cast("long").alias("fee"), F.lit(7).alias("tax"), refund.alias("refund"),
        none.cast("long").alias("chargeback"), (F.col("amount") - fee - 7 - F.when(k % 3 == 0, 500).otherwise(0)).cast("long").alias("settled"), F.lit(0).alias("created_s"), F.when(k % 17 > 1, (k % 13) * 4 * 3600 + 1).alias("settled_s"),
        F.when(k % 2 == 0, k % 300).alias("discrepancy"), F.when(k % 5 == 0, 200).alias("tolerance"), F.when(k % 6 == 0, 30).alias("window_h"), F.when(k % 19 == 0, 1).otherwise(0).alias("n_contradictions"),
    )
    i = F.col("i")
    ev = o.withColumn("i", F.explode(F.array(*map(F.lit, (0, 1, 2))))).select(
        F.concat(F.lit("x"), k).alias("case_id"), F.concat(F.lit("e"), k, F.lit("."), i).alias("evidence_id"),
        F.when(i == 0, F.concat(F.lit("p"), k)).when((i == 1) & (k % 7 == 0), F.concat(F.lit("x"), k)).otherwise("other").alias("source_id"), chosen(ACCESS, k + i).alias("access"),
        F.when((i == 1) & (k % 7 != 0), F.array(F.concat(F.lit("s"), k))).alias("linked_ids"), F.when(k % 3 == 0, F.concat(F.lit("about U"), k, F.lit(" and more"))).otherwise("nothing").alias("body"),
    )
    ids = F.when(k % 9 == 8, F.array().cast("array<string>")).when(i == 1, F.array(F.concat(F.lit("e"), k, F.lit(".0")), F.concat(F.lit("e"), k, F.lit(".2")))).otherwise(F.array(F.concat(F.lit("e"), k, F.lit("."), F.when(k % 10 == 9, 5).otherwise(1)), F.concat(F.lit("e"), k, F.lit(".0"))))
    part = lambda key, a, b: F.struct(F.lit(key).alias("key"), a.cast("long").alias("expected"), b.cast("long").alias("observed"))
    said = o.withColumn("i", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        F.concat(F.lit("x"), k).alias("case_id"), i.alias("place"), F.concat(F.lit("c"), k, F.lit("."), i).alias("claim_id"), chosen(TYPES, k + i).alias("type"), chosen(STATEMENTS, k * 2 + i).alias("statement"), ids.alias("evidence_ids"),
        F.when(k % 8 == 3, F.array(part("fee", k, k + i), part("tax", F.lit(7), F.lit(7)), part("net", none, k))).alias("asserted"),
    )
    return said, ev, cases


def sql_list(values):
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


CLAIM_SQL = f"""
WITH o AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS amount FROM orders),
ca AS (SELECT k, 'x' || k AS case_id, CASE WHEN k % 17 <> 0 THEN 'p' || k END AS pid, CASE WHEN k % 17 > 1 THEN 's' || k END AS sid, 'U' || k AS utr, amount AS gross, amount // 50 + 7 + CASE WHEN k % 4 = 0 THEN 500 ELSE 0 END AS deducted,
  amount - amount // 50 - 7 - CASE WHEN k % 3 = 0 THEN 500 ELSE 0 END AS settled, CASE WHEN k % 17 > 1 THEN (k % 13) * 14400 + 1 END AS late_s, CASE WHEN k % 2 = 0 THEN k % 300 ELSE 0 END AS disc, CASE WHEN k % 5 = 0 THEN 200 ELSE 100 END AS tol, CASE WHEN k % 6 = 0 THEN 30 ELSE 48 END AS win FROM o),
ev AS (SELECT k, 'e' || k || '.' || i AS id, CASE WHEN i = 0 THEN 'p' || k WHEN i = 1 AND k % 7 = 0 THEN 'x' || k ELSE 'other' END AS src, {sql_list(ACCESS)}[(k + i) % {len(ACCESS)} + 1] AS access, CASE WHEN i = 1 AND k % 7 <> 0 THEN 's' || k END AS link,
  CASE WHEN k % 3 = 0 THEN 'about U' || k || ' and more' ELSE 'nothing' END AS body FROM o, range(3) r(i)),
cl AS (SELECT k, i, 'c' || k || '.' || i AS id, coalesce({sql_list(TYPES)}[(k + i) % {len(TYPES)} + 1], 'FINANCIAL_EXPLANATION') AS type, lower(coalesce({sql_list(STATEMENTS)}[(k * 2 + i) % {len(STATEMENTS)} + 1], '')) AS said,
  CASE WHEN k % 9 = 8 THEN [] WHEN i = 1 THEN ['e' || k || '.0', 'e' || k || '.2'] ELSE ['e' || k || '.' || CASE WHEN k % 10 = 9 THEN 5 ELSE 1 END, 'e' || k || '.0'] END AS ids FROM o, range(2) r(i)),
cited AS (SELECT k, i, unnest(ids) AS eid, unnest(range(len(ids))) AS pos FROM cl),
w AS (SELECT c.k, c.i, CASE WHEN ev.id IS NULL THEN 0 END AS r0, CASE WHEN access IN ('HIGHLY_RESTRICTED', 'RESTRICTED_CLEARANCE_REQUIRED') THEN 1 END AS r1,
  CASE WHEN ev.id IS NOT NULL AND NOT (coalesce(src = pid, false) OR coalesce(src = sid, false) OR coalesce(link = pid, false) OR coalesce(link = sid, false) OR contains(body, utr) OR coalesce(contains(body, pid), false) OR src = case_id) THEN 2 END AS r2, pos, eid
  FROM cited c JOIN ca ON ca.k = c.k LEFT JOIN ev ON ev.k = c.k AND ev.id = c.eid),
wr AS (SELECT k, i, list((['INVENTED_EVIDENCE_ID: ', 'UNAUTHORIZED_EVIDENCE: ', 'UNLINKED_EVIDENCE: '])[r + 1] || eid ORDER BY r, pos) AS rs FROM (SELECT k, i, pos, eid, unnest([r0, r1, r2]) AS r FROM w) WHERE r IS NOT NULL GROUP BY 1, 2),
all_ AS (SELECT cl.*, case_id, list_filter(coalesce(rs, []) || [
    CASE WHEN type IN ('AMOUNT', 'FINANCIAL_EXPLANATION') AND pid IS NULL AND sid IS NULL THEN 'MISSING_FINANCIAL_RECORDS' END,
    CASE WHEN cl.k % 8 = 3 AND cl.i <> 0 THEN 'AMOUNT_MISMATCH: fee (' || cl.k || ' != ' || (cl.k + cl.i) || ')' END,
    CASE WHEN type IN ('AMOUNT', 'FINANCIAL_EXPLANATION') AND (contains(said, 'refund explains') OR contains(said, 'variance')) AND abs(gross - settled) <> deducted THEN 'ARITHMETIC_MISMATCH: Variance ' || abs(gross - settled) || ' != Deductions ' || deducted END,
    CASE WHEN late_s > win * 3600 THEN 'TIMING_WINDOW_VIOLATION' END,
    CASE WHEN disc > tol AND contains(said, 'within tolerance') THEN 'POLICY_TOLERANCE_EXCEEDED' END,
    CASE WHEN cl.k % 19 = 0 THEN 'CONFLICTING_EVIDENCE' END], lambda x: x IS NOT NULL) AS rs
  FROM cl JOIN ca USING (k) LEFT JOIN wr ON wr.k = cl.k AND wr.i = cl.i),
st AS (SELECT *, len(ids) = 0 AND type IN ('AMOUNT', 'FINANCIAL_EXPLANATION') AS uncited, len(list_filter(rs, lambda x: regexp_matches(x, 'INVENTED|UNAUTHORIZED|MISMATCH|VIOLATION'))) > 0 AS bad FROM all_),
v AS (SELECT case_id, i, id, type, CASE WHEN uncited THEN 'INSUFFICIENT_EVIDENCE' WHEN len(rs) = 0 THEN 'VERIFIED' WHEN bad THEN 'DISPUTED' ELSE 'UNSUPPORTED' END AS status, array_to_string(list_sort(ids), ',') AS evidence_ids,
  array_to_string(CASE WHEN uncited THEN rs || ['NO_EVIDENCE_CITED'] ELSE rs END, ';') AS reasons FROM st),
h AS MATERIALIZED (SELECT *, sha256(id || '|' || type || '|' || status || '|' || evidence_ids || '|' || reasons) AS receipt FROM v)"""


@query(CLAIM_SQL + " SELECT case_id, i::INTEGER AS place, id AS claim_id, type, status, evidence_ids, reasons, receipt AS receipt_hash FROM h", results=False)
def claim_validation(spark, sf_dir):
    """Two claims a case against its evidence and records; each status occurs."""
    return claims.validated(*asked(spark, sf_dir)).withColumn("evidence_ids", F.array_join("evidence_ids", ",")).withColumn("reasons", F.array_join("reasons", ";"))


@query(CLAIM_SQL + """ SELECT case_id, count(*) AS n, count(*) FILTER (status = 'VERIFIED') AS verified, count(*) FILTER (status = 'DISPUTED') AS disputed, count(*) FILTER (status = 'UNSUPPORTED') AS unsupported, count(*) FILTER (status = 'INSUFFICIENT_EVIDENCE') AS insufficient,
  count(*) FILTER (status = 'INSUFFICIENT_EVIDENCE') > 0 AND count(*) FILTER (status IN ('VERIFIED', 'DISPUTED')) = 0 AS abstain, sha256('run|' || case_id || '|' || string_agg(receipt, ':' ORDER BY i)) AS canonical_hash FROM h GROUP BY 1""", results=False)
def claim_receipts(spark, sf_dir):
    return claims.case_receipts(claims.validated(*asked(spark, sf_dir)), "run")
