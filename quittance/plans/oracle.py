"""The matching procedure as one SQL statement over the derived tables, for the oracle."""

from quittance.sources.fixtures import FIXTURE_SQL

RESULT_SQL = (
    FIXTURE_SQL
    + """,
rr AS (SELECT payment_id, CAST(sum(amount) AS BIGINT) AS amount FROM refunds WHERE status = 'processed' GROUP BY 1),
cc AS (SELECT payment_id, CAST(sum(amount) AS BIGINT) AS amount FROM chargebacks WHERE status IN ('open', 'under_review', 'accepted') GROUP BY 1),
ss AS (SELECT payment_id, count(*) AS n, CAST(sum(amount) AS BIGINT) AS amount, arg_min(struct_pack(u := utr, s := settled_s, i := settlement_id), seq) AS one FROM setl GROUP BY 1),
oo AS (SELECT order_id, arg_max(amount, seq) AS amount FROM ords GROUP BY 1),
bl AS (SELECT utr, arg_max(struct_pack(txn_id := txn_id, amount := amount, txn_s := txn_s), seq) AS hit FROM bank WHERE type = 'CREDIT' AND utr IS NOT NULL GROUP BY 1),
m0 AS (
  SELECT p.*, coalesce(ss.n, 0) AS n, ss.amount AS settled, CASE WHEN ss.n = 1 THEN ss.one.s END AS settled_s, CASE WHEN ss.n = 1 THEN ss.one.i END AS settlement_id,
         coalesce(rr.amount, 0) AS refund_amount, coalesce(cc.amount, 0) AS chargeback_amount, coalesce(oo.amount, p.amount) AS order_amount,
         p.amount - fee - tax - coalesce(rr.amount, 0) - coalesce(cc.amount, 0) AS net,
         b.hit.txn_id AS hit_id, b.hit.amount AS hit_amount, b.hit.txn_s AS hit_s,
         (SELECT max(captured_s) FROM pay) AS clock
  FROM pay p LEFT JOIN ss USING (payment_id) LEFT JOIN rr ON p.payment_id = rr.payment_id LEFT JOIN cc ON p.payment_id = cc.payment_id
  LEFT JOIN oo ON p.order_id = oo.order_id LEFT JOIN bl b ON ss.n = 1 AND b.utr = ss.one.u WHERE p.status = 'captured'),
cand0 AS (
  SELECT m0.seq, m0.payment_id, m0.settled AS amount, b.txn_id, b.amount AS credit, b.txn_s
  FROM m0 JOIN bank b ON b.type = 'CREDIT' AND abs(b.amount - m0.settled) <= greatest(100, CAST(floor(m0.settled * 0.01 + 0.5) AS BIGINT))
    AND (m0.settled_s IS NULL OR b.txn_s BETWEEN m0.settled_s - 3600 AND m0.settled_s + 259200)
  WHERE m0.n = 1 AND m0.hit_id IS NULL),
cand AS (SELECT * FROM cand0 c WHERE NOT EXISTS (SELECT 1 FROM m0 WHERE m0.hit_id = c.txn_id AND m0.seq < c.seq)),
turn AS (SELECT seq, row_number() OVER (ORDER BY seq) AS i, list(struct_pack(id := txn_id, credit := credit, s := txn_s)) AS c FROM cand GROUP BY 1),
fz(i, seq, nf, one, used) AS (
  SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS STRUCT(id VARCHAR, credit BIGINT, s BIGINT)), CAST([] AS VARCHAR[])
  UNION ALL
  SELECT i, seq, len(o), CASE WHEN len(o) = 1 THEN o[1] END, CASE WHEN len(o) = 1 THEN list_append(used, o[1].id) ELSE used END
  FROM (SELECT turn.i, turn.seq, used, list_filter(turn.c, lambda x: NOT list_contains(used, x.id)) AS o FROM fz JOIN turn ON turn.i = fz.i + 1)),
m1 AS (
  SELECT m0.*, coalesce(fz.nf, 0) AS nf, coalesce(hit_id, fz.one.id) AS bank_txn_id, coalesce(hit_amount, fz.one.credit) AS bank_amount, coalesce(hit_s, fz.one.s) AS bank_s,
         CASE WHEN n > 0 THEN abs(net - settled) ELSE 0 END AS delta, captured_s IS NULL OR clock - captured_s < 259200 AS pending
  FROM m0 LEFT JOIN fz USING (seq)),
m1n AS (SELECT m1.*, coalesce(contains(b.narration, m1.settlement_id), false) AS told FROM m1 LEFT JOIN bank b ON b.txn_id = m1.bank_txn_id),
m2 AS (
  SELECT *,
    CASE WHEN n = 0 THEN CASE WHEN pending THEN 'PENDING_SETTLEMENT' ELSE 'MISSING_BANK_CREDIT' END
         WHEN n > 1 THEN 'DUPLICATE_SETTLEMENT'
         WHEN delta > 100 AND refund_amount > 0 THEN CASE WHEN abs(amount - fee - tax - settled) <= 100 THEN 'REFUND_MISMATCH' ELSE 'AMOUNT_MISMATCH' END
         WHEN delta > 100 AND chargeback_amount > 0 THEN 'CHARGEBACK_ADJUSTMENT'
         WHEN delta > 100 OR (hit_id IS NOT NULL AND abs(bank_amount - settled) > 100) THEN 'AMOUNT_MISMATCH'
         WHEN bank_s - settled_s > 86400 THEN 'DELAYED_BANK_CREDIT'
         WHEN nf > 1 THEN 'NEEDS_MANUAL_REVIEW'
         WHEN bank_txn_id IS NULL AND nf <= 1 AND clock - settled_s > 172800 THEN 'MISSING_BANK_CREDIT'
         ELSE 'AUTO_MATCHED' END AS status0,
    CASE WHEN n = 0 AND captured_s IS NULL THEN 'NO_CAPTURE_DATE' WHEN n = 0 THEN CASE WHEN pending THEN 'NO_SETTLEMENT_YET' ELSE 'OVERDUE_NO_SETTLEMENT' END
         WHEN n > 1 THEN 'MULTIPLE_SETTLEMENTS' WHEN hit_id IS NOT NULL THEN 'EXACT_UTR' WHEN nf = 1 THEN 'FUZZY_AMOUNT_DATE'
         WHEN nf > 1 THEN 'AMBIGUOUS_FUZZY' ELSE 'NO_BANK_MATCH' END AS match_method,
    greatest(0, least(100, 25
      + CASE WHEN n = 1 AND hit_id IS NOT NULL THEN 40 ELSE 0 END + CASE WHEN n = 1 AND delta <= 100 THEN 15 ELSE 0 END
      + CASE WHEN (n = 0 AND pending) OR (n = 1 AND coalesce(abs(bank_s - settled_s) < 86400, false)) THEN 10 ELSE 0 END
      + CASE WHEN n = 1 AND told THEN 10 ELSE 0 END + CASE WHEN n <= 1 THEN 5 ELSE 0 END - CASE WHEN n > 1 OR (n = 1 AND nf > 1) THEN 30 ELSE 0 END
      - CASE WHEN n = 0 OR (n = 1 AND bank_txn_id IS NULL) THEN 20 ELSE 0 END - CASE WHEN n = 0 THEN 15 ELSE 0 END
      - CASE WHEN delta = 0 THEN 0 WHEN delta <= 100 THEN 5 WHEN delta <= 1000 THEN 15 WHEN delta <= 10000 THEN 25 ELSE 40 END
      - CASE WHEN n = 1 AND refund_amount > 0 THEN 3 ELSE 0 END - CASE WHEN n = 1 AND chargeback_amount > 0 THEN 8 ELSE 0 END)) AS score
  FROM m1n),
r AS MATERIALIZED (
  SELECT seq, payment_id, order_id, method, class, amount AS payment_amount, order_amount, fee, tax, refund_amount, chargeback_amount, net AS expected_net, captured_s,
         settled AS settled_amount, bank_amount, bank_txn_id, settlement_id, nf,
         CASE WHEN n = 1 AND delta > 100 THEN delta WHEN n = 1 AND hit_id IS NOT NULL AND abs(bank_amount - settled) > 100 THEN abs(bank_amount - settled) END AS mismatch,
         CASE WHEN n = 1 AND status0 = 'AUTO_MATCHED' AND score < 50 THEN 'NEEDS_MANUAL_REVIEW' ELSE status0 END AS status,
         CAST(score AS INTEGER) AS score, match_method
  FROM m2),
orphans AS (
  SELECT txn_id, 'orphan_' || txn_id AS payment_id, utr, amount, 25 AS score, 'ORPHAN_BANK_CREDIT' AS status FROM bank
  WHERE type = 'CREDIT' AND txn_id NOT IN (SELECT bank_txn_id FROM r WHERE bank_txn_id IS NOT NULL)
    AND utr NOT IN (SELECT utr FROM setl WHERE utr IS NOT NULL)),
truth AS (
  SELECT payment_id, CASE class WHEN 9 THEN 'MISSING_BANK_CREDIT' WHEN 10 THEN 'MISSING_BANK_CREDIT' WHEN 11 THEN 'AMOUNT_MISMATCH' WHEN 12 THEN 'REFUND_MISMATCH'
    WHEN 13 THEN 'CHARGEBACK_ADJUSTMENT' WHEN 14 THEN 'DUPLICATE_SETTLEMENT' WHEN 15 THEN 'DELAYED_BANK_CREDIT' WHEN 17 THEN 'NEEDS_MANUAL_REVIEW' ELSE 'AUTO_MATCHED' END AS truth FROM pay),
pairs AS (SELECT r.*, truth FROM r JOIN truth USING (payment_id)),
d0 AS (
  SELECT *, abs(expected_net) >= 1000000 AS material, score < 40 AS low, false AS first_seen,
    method IN ('card', 'netbanking') AND abs(expected_net) >= 1000000 AS provider,
    (expected_net <> 0 AND coalesce(mismatch, 0) > greatest(1000, CAST(floor(abs(expected_net) * 0.05 + 0.5) AS BIGINT)))
      OR (status IN ('DELAYED_BANK_CREDIT', 'MISSING_BANK_CREDIT') AND abs(expected_net) >= 1000000) AS unusual FROM r),
d1 AS (
  SELECT *, CASE status WHEN 'AUTO_MATCHED' THEN 'AUTO_MATCH' WHEN 'NEEDS_MANUAL_REVIEW' THEN 'SUGGESTED' ELSE 'EXCEPTION' END AS outcome,
    CASE WHEN status = 'AUTO_MATCHED' THEN 'LOW' WHEN status = 'NEEDS_MANUAL_REVIEW' THEN CASE WHEN material OR low THEN 'HIGH' ELSE 'MEDIUM' END
         WHEN (low AND material) OR unusual OR provider THEN 'HIGH' WHEN material OR low THEN 'MEDIUM' ELSE 'LOW' END AS own_risk,
    CASE WHEN status = 'AUTO_MATCHED' THEN 0 ELSE coalesce(nullif(mismatch, 0), abs(expected_net)) END AS at_risk,
    CASE WHEN status = 'AUTO_MATCHED' THEN '' ELSE concat_ws(',', CASE WHEN material THEN 'MATERIAL' END, CASE WHEN low THEN 'LOW_CONFIDENCE' END,
      CASE WHEN provider THEN 'PROVIDER_RISK' END, CASE WHEN unusual THEN 'UNUSUAL_PATTERN' END) END AS trig FROM d0),
d AS MATERIALIZED (
  SELECT payment_id, status, method, expected_net, score, outcome, own_risk, at_risk,
    CASE WHEN outcome <> 'AUTO_MATCH' AND sum(at_risk) OVER () >= 5000000 THEN 'HIGH' ELSE own_risk END AS risk,
    CASE WHEN outcome <> 'AUTO_MATCH' AND sum(at_risk) OVER () >= 5000000 THEN concat_ws(',', nullif(trig, ''), 'AGGREGATE') ELSE trig END AS triggers FROM d1)
"""
)
