"""Every registered query with the SQL that it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quittance.functions import currency
from quittance.operators import entities, integrity, matching, metrics, risk
from quittance.plans.base import ORACLE_SQL, QUERIES, query
from quittance.sources import fixtures
from quittance.sources.stored import once

def results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The results of the batch, matched once in an application and then read."""
    b = fixtures.batch(spark, sf_dir)
    match = lambda: matching.match(b["payments"], b["settlements"], b["bank"], b["refunds"], b["chargebacks"], b["orders"])
    return once(spark, "results", sf_dir, match), b


def truths(pay: DataFrame) -> DataFrame:
    names = {9: "MISSING_BANK_CREDIT", 10: "MISSING_BANK_CREDIT", 11: "AMOUNT_MISMATCH", 12: "REFUND_MISMATCH", 13: "CHARGEBACK_ADJUSTMENT", 14: "DUPLICATE_SETTLEMENT", 15: "DELAYED_BANK_CREDIT", 16: "ORPHAN_BANK_CREDIT", 17: "NEEDS_MANUAL_REVIEW"}
    label = F.lit("AUTO_MATCHED")
    for c, name in names.items():
        label = F.when(F.col("class") == c, name).otherwise(label)
    return pay.select("payment_id", label.alias("expected_label"))


def pairs(spark, sf_dir) -> DataFrame:
    r, b = results(spark, sf_dir)
    return metrics.labelled(r, truths(b["payments"]))


@query("SELECT status, count(*) AS n, CAST(sum(payment_amount) AS BIGINT) AS amount FROM r GROUP BY 1")
def match_status_summary(spark, sf_dir):
    return results(spark, sf_dir)[0].groupBy("status").agg(F.count("*").alias("n"), F.sum("payment_amount").alias("amount"))


CORE = ["payment_id", "order_id", "order_amount", "payment_amount", "fee", "tax", "expected_net", "settled_amount", "bank_amount", "bank_txn_id", "mismatch", "status", "score", "match_method"]


@query(f"SELECT {', '.join(CORE)} FROM r")
def match_results_core(spark, sf_dir):
    return results(spark, sf_dir)[0].select(*CORE)


@query("SELECT payment_id, CAST(sum(amount) AS BIGINT) AS refund_amount, string_agg(refund_id, ',' ORDER BY refund_id) AS refund_ids FROM refunds WHERE status = 'processed' GROUP BY 1")
def refund_rollup(spark, sf_dir):
    return matching.refund_rollup(fixtures.batch(spark, sf_dir)["refunds"]).withColumn("refund_ids", F.array_join("refund_ids", ","))


@query("SELECT payment_id, CAST(sum(amount) AS BIGINT) AS chargeback_amount, string_agg(chargeback_id, ',' ORDER BY chargeback_id) AS chargeback_ids FROM chargebacks WHERE status IN ('open', 'under_review', 'accepted') GROUP BY 1")
def chargeback_rollup(spark, sf_dir):
    return matching.chargeback_rollup(fixtures.batch(spark, sf_dir)["chargebacks"]).withColumn("chargeback_ids", F.array_join("chargeback_ids", ","))


@query("SELECT payment_id, count(*) AS n_settlements, CAST(sum(amount) AS BIGINT) AS settled_amount, string_agg(settlement_id, ',' ORDER BY settlement_id) AS settlement_ids FROM setl GROUP BY 1 HAVING count(*) > 1")
def duplicate_settlements(spark, sf_dir):
    s = matching.settlement_rollup(fixtures.batch(spark, sf_dir)["settlements"]).where("n_settlements > 1")
    return s.select("payment_id", "n_settlements", "settled_amount", F.array_join("settlement_ids", ",").alias("settlement_ids"))


@query("SELECT payment_id, expected_net, match_method, score FROM r WHERE status = 'MISSING_BANK_CREDIT'")
def missing_credit(spark, sf_dir):
    return results(spark, sf_dir)[0].where("status = 'MISSING_BANK_CREDIT'").select("payment_id", "expected_net", "match_method", "score")


@query("SELECT payment_id, bank_txn_id, bank_amount FROM r WHERE status = 'DELAYED_BANK_CREDIT'")
def delayed_credit(spark, sf_dir):
    return results(spark, sf_dir)[0].where("status = 'DELAYED_BANK_CREDIT'").select("payment_id", "bank_txn_id", "bank_amount")


def orphans_of(r, b):
    return matching.orphan_credits(r, b["settlements"], b["bank"])


@query("SELECT txn_id, payment_id, utr, amount, score, status FROM orphans")
def orphan_credits(spark, sf_dir):
    return orphans_of(*results(spark, sf_dir))


@query("SELECT seq, payment_id, amount, txn_id, credit, txn_s FROM cand0")
def fuzzy_candidates(spark, sf_dir):
    b = fixtures.batch(spark, sf_dir)
    credited = matching.bank_by_utr(b["bank"]).select("utr")
    single = matching.settlement_rollup(b["settlements"]).where("n_settlements = 1").select("payment_id", F.col("settled_amount").alias("amount"), "one.utr", "one.settled_s")
    open_ = single.join(credited, "utr", "left_anti").join(b["payments"].where("status = 'captured'").select("payment_id", "seq"), "payment_id").drop("utr")
    return matching.fuzzy_candidates(open_, b["bank"]).drop("narration")


@query("SELECT score, match_method, count(*) AS n FROM r GROUP BY 1, 2")
def confidence_scores(spark, sf_dir):
    return results(spark, sf_dir)[0].groupBy("score", "match_method").agg(F.count("*").alias("n"))


BUCKET_SQL = "CASE WHEN score <= 20 THEN '0-20' WHEN score <= 40 THEN '21-40' WHEN score <= 60 THEN '41-60' WHEN score <= 80 THEN '61-80' ELSE '81-100' END"


@query(f"SELECT {BUCKET_SQL} AS bucket, count(*) AS total, count(*) FILTER (status = truth) AS correct, CAST(floor(count(*) FILTER (status = truth) * 100.0 / count(*) + 0.5) AS BIGINT) AS accuracy FROM pairs GROUP BY 1")
def calibration_buckets(spark, sf_dir):
    return metrics.calibration(pairs(spark, sf_dir))


@query(f"""SELECT CAST(sum(abs(100 * ok - s)) AS DOUBLE) / (100 * sum(n)) AS ece, CAST(sum(sq) AS DOUBLE) / (10000 * sum(n)) AS brier, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT {BUCKET_SQL} AS b, count(*) AS n, count(*) FILTER (status = truth) AS ok, sum(score) AS s,
         sum((score - CASE WHEN status = truth THEN 100 ELSE 0 END) * (score - CASE WHEN status = truth THEN 100 ELSE 0 END)) AS sq FROM pairs GROUP BY 1)""")
def ece_brier(spark, sf_dir):
    return metrics.calibration_error(pairs(spark, sf_dir))


LABELS_SQL = ", ".join(f"('{x}')" for x in metrics.LABELS)


@query(f"SELECT a.l AS truth, b.l AS predicted, count(p.payment_id) AS n FROM (VALUES {LABELS_SQL}) a(l) CROSS JOIN (VALUES {LABELS_SQL}) b(l) LEFT JOIN pairs p ON p.truth = a.l AND p.status = b.l GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(pairs(spark, sf_dir))


@query("""SELECT label, tp, fp, fn, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM (
  SELECT label, tp, p - tp AS fp, t - tp AS fn, CASE WHEN p > 0 THEN tp::DOUBLE / p ELSE 0.0 END AS precision, CASE WHEN t > 0 THEN tp::DOUBLE / t ELSE 0.0 END AS recall FROM (
    SELECT label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(p) AS BIGINT) AS p, CAST(sum(t) AS BIGINT) AS t FROM (
      SELECT truth AS label, CASE WHEN truth = status THEN 1 ELSE 0 END AS tp, 0 AS p, 1 AS t FROM pairs UNION ALL SELECT status, 0, 1, 0 FROM pairs) GROUP BY 1))""")
def per_label_metrics(spark, sf_dir):
    return metrics.per_label(pairs(spark, sf_dir))


@query("""SELECT count(*) AS n_payments, count(*) FILTER (status = 'AUTO_MATCHED') AS n_matched, count(*) FILTER (status <> 'AUTO_MATCHED') AS n_exceptions,
  CAST(sum(payment_amount) AS BIGINT) AS gross, CAST(sum(expected_net) AS BIGINT) AS expected, CAST(sum(bank_amount) AS BIGINT) AS credited, CAST(sum(refund_amount) AS BIGINT) AS refunded,
  CAST(sum(chargeback_amount) AS BIGINT) AS charged_back, CAST(sum(CASE WHEN status <> 'AUTO_MATCHED' THEN coalesce(nullif(mismatch, 0), abs(expected_net)) ELSE 0 END) AS BIGINT) AS at_risk,
  (SELECT count(*) FROM orphans) AS n_orphans, (SELECT CAST(coalesce(sum(amount), 0) AS BIGINT) FROM orphans) AS orphan_credits FROM r""")
def batch_metrics(spark, sf_dir):
    r, b = results(spark, sf_dir)
    return metrics.batch_metrics(r, orphans_of(r, b))


@query("SELECT payment_id, status, method, expected_net, score, outcome, risk, own_risk, triggers, at_risk FROM d")
def decision_risk(spark, sf_dir):
    return risk.decide(results(spark, sf_dir)[0])


@query("SELECT outcome, risk, count(*) AS n, CAST(sum(at_risk) AS BIGINT) AS at_risk FROM d GROUP BY 1, 2")
def decision_aggregate(spark, sf_dir):
    return risk.decide(results(spark, sf_dir)[0]).groupBy("outcome", "risk").agg(F.count("*").alias("n"), F.sum("at_risk").alias("at_risk"))


@query("SELECT payment_id, status, at_risk FROM d WHERE outcome <> 'AUTO_MATCH' ORDER BY at_risk DESC, payment_id LIMIT 10")
def top_exceptions(spark, sf_dir):
    return risk.top_exceptions(risk.decide(results(spark, sf_dir)[0]))


@query("""SELECT *, CASE WHEN exposure_score >= 75 THEN 'CRITICAL' WHEN exposure_score >= 50 THEN 'HIGH' WHEN exposure_score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM (
  SELECT high, medium, total, n, n_small, small_sum, n_small >= 25 OR small_sum >= 1000000 AS stacking_breach,
    CAST(least(100, least(40, 8 * high + 3 * medium) + least(30, total * 30 // 10000000) + least(15, n * 15 // 30)
      + CASE WHEN n_small >= 25 OR small_sum >= 1000000 THEN 15 ELSE least(15, small_sum * 15 // 1000000) END) AS BIGINT) AS exposure_score FROM (
    SELECT count(*) FILTER (v > 5000000) AS high, count(*) FILTER (v BETWEEN 1000000 AND 5000000) AS medium, CAST(coalesce(sum(v), 0) AS BIGINT) AS total, count(*) AS n,
      count(*) FILTER (v <= 100000) AS n_small, CAST(coalesce(sum(v) FILTER (v <= 100000), 0) AS BIGINT) AS small_sum
    FROM (SELECT abs(at_risk) AS v FROM d) WHERE v > 0))""")
def risk_exposure(spark, sf_dir):
    return risk.exposure(risk.decide(results(spark, sf_dir)[0]).select(F.col("at_risk").alias("variance")))


@query("""WITH g AS (
  SELECT 'merchant' AS level, 'm' || l_suppkey AS name, d, gross FROM t UNION ALL SELECT 'provider', l_linestatus, d, gross FROM t UNION ALL SELECT 'batch', 'all', d, gross FROM t)
SELECT level, name, CAST(sum(d) AS BIGINT) AS discrepancy, CAST(sum(gross) AS BIGINT) AS gross,
  sum(d) > CASE level WHEN 'merchant' THEN 10000 WHEN 'provider' THEN 25000 ELSE 50000 END OR (level = 'batch' AND sum(d) * 1000 > sum(gross) * 5) AS breach FROM g GROUP BY level, name""".replace("WITH g AS", """WITH t AS (
  SELECT l_suppkey, l_linestatus, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS gross,
         abs(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) - CAST(floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) AS BIGINT)) AS d FROM lineitem),
g AS"""), results=False)  # fmt: skip
def tolerance_stacking(spark, sf_dir):
    li = fixtures.table(spark, sf_dir, "lineitem")
    rows = li.select(
        F.concat(F.lit("m"), "l_suppkey").alias("merchant"), F.col("l_linestatus").alias("provider"),
        fixtures.minor(F.col("l_extendedprice")).alias("gross"), fixtures.minor(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("settled"),
    )
    return risk.tolerance_stacking(rows)


def policy_inputs(spark, sf_dir):
    r, b = results(spark, sf_dir)
    return r.select("payment_id", F.col("payment_amount").alias("amount"), F.coalesce("mismatch", F.lit(0)).alias("discrepancy"), F.when(F.col("status") == "DELAYED_BANK_CREDIT", 88).otherwise(54).alias("raw_hours"), "method").withColumn(
        "hours", F.col("raw_hours") - 48
    )


POLICY_SQL = """
i AS (SELECT payment_id, payment_amount AS amount, coalesce(mismatch, 0) AS disc, CASE WHEN status = 'DELAYED_BANK_CREDIT' THEN 40 ELSE 6 END AS hours, method <> 'wallet' AS allowed FROM r),
p AS (SELECT *, 100 - CASE WHEN disc > 0 AND disc <= {tol} THEN 5 WHEN disc > {tol} THEN 35 ELSE 0 END - CASE WHEN hours > {win} THEN 25 ELSE 0 END - CASE WHEN allowed THEN 0 ELSE 20 END AS score FROM i),
{name} AS (SELECT payment_id, score, CASE WHEN disc > {tol} OR hours > {win} OR disc >= 500000 THEN 'EXCEPTION' WHEN score >= 90 THEN 'AUTO_MATCH' WHEN score >= 70 THEN 'SUGGESTED' ELSE 'EXCEPTION' END AS outcome,
  CASE WHEN amount >= 5000000 THEN 'CRITICAL' WHEN disc >= 500000 THEN 'HIGH' WHEN disc > {tol} OR hours > {win} THEN 'MEDIUM' ELSE 'LOW' END AS risk, amount >= 1000000 AS maker_checker, amount >= 5000000 AS escalated FROM p)"""
BASE_POLICY, NEW_POLICY = risk.BASELINE, risk.BASELINE | {"tolerance": 60_000, "window_h": 24}


@query("," + POLICY_SQL.format(tol=100, win=48, name="x") + " SELECT payment_id, score, outcome, risk, maker_checker, escalated FROM x")
def policy_eval(spark, sf_dir):
    i = policy_inputs(spark, sf_dir)
    p = risk.policy(F.col("amount"), F.col("discrepancy"), F.col("hours"), F.col("method") != "wallet", BASE_POLICY)
    return i.select("payment_id", *(c.alias(n) for n, c in p.items()))


@query("," + POLICY_SQL.format(tol=100, win=48, name="x") + "," + POLICY_SQL.format(tol=60000, win=24, name="y").replace("i AS", "i2 AS").replace("p AS", "p2 AS").replace("FROM i)", "FROM i2)").replace("FROM p)", "FROM p2)")
       + """ SELECT count(*) AS n, count(*) FILTER (x.outcome <> y.outcome) AS reclassified, count(*) FILTER (x.outcome <> 'AUTO_MATCH' AND y.outcome = 'AUTO_MATCH') AS newly_matched,
  count(*) FILTER (x.outcome = 'AUTO_MATCH' AND y.outcome <> 'AUTO_MATCH') AS newly_unmatched, count(*) FILTER (NOT x.escalated AND y.escalated) AS newly_escalated FROM x JOIN y USING (payment_id)""")  # fmt: skip
def policy_shadow_delta(spark, sf_dir):
    """Both policies on the same row: no join."""
    i = policy_inputs(spark, sf_dir)
    args = (F.col("amount"), F.col("discrepancy"), F.col("hours"), F.col("method") != "wallet")
    x, y = risk.policy(*args, BASE_POLICY), risk.policy(*args, NEW_POLICY)
    both = i.select(x["outcome"].alias("x"), y["outcome"].alias("y"), x["escalated"].alias("xe"), y["escalated"].alias("ye"))
    return both.agg(
        F.count("*").alias("n"), F.count_if(F.col("x") != F.col("y")).alias("reclassified"),
        F.count_if((F.col("x") != "AUTO_MATCH") & (F.col("y") == "AUTO_MATCH")).alias("newly_matched"),
        F.count_if((F.col("x") == "AUTO_MATCH") & (F.col("y") != "AUTO_MATCH")).alias("newly_unmatched"),
        F.count_if(~F.col("xe") & F.col("ye")).alias("newly_escalated"),
    )


RATES_SQL = ", ".join(f"('{c}', {n}, {d}, {i})" for i, (c, (n, d)) in enumerate(currency.RATES.items()))
FX_SQL = f"""WITH fx AS (SELECT * FROM (VALUES {RATES_SQL}) v(currency, num, den, i)),
c AS (SELECT c_custkey, fx.currency, CAST(floor(c_acctbal * 100 + 0.5) AS BIGINT) AS minor, num, den FROM customer JOIN fx ON c_nationkey % 9 = fx.i),
x AS (SELECT c_custkey, currency, minor, CAST(CAST(greatest(minor, 0) AS HUGEINT) * num // den AS BIGINT) AS inr_minor FROM c) """


def converted(spark, sf_dir):
    names = F.array(*map(F.lit, currency.RATES))
    c = fixtures.table(spark, sf_dir, "customer").select("c_custkey", F.element_at(names, (F.col("c_nationkey") % 9 + 1).cast("int")).alias("currency"), fixtures.minor(F.col("c_acctbal")).alias("minor"))
    return currency.to_inr(c, "minor")


@query(FX_SQL + "SELECT c_custkey, currency, minor, inr_minor FROM x", results=False)
def fx_conversion(spark, sf_dir):
    return converted(spark, sf_dir)


@query(FX_SQL + "SELECT currency, count(*) AS n, CAST(sum(minor) AS BIGINT) AS minor, CAST(sum(inr_minor) AS BIGINT) AS inr_minor FROM x GROUP BY 1", results=False)
def currency_breakdown(spark, sf_dir):
    return converted(spark, sf_dir).groupBy("currency").agg(F.count("*").alias("n"), F.sum("minor").alias("minor"), F.sum("inr_minor").alias("inr_minor"))


@query(""", s AS (SELECT CAST((SELECT sum(amount - fee - tax) FROM pay) - (SELECT coalesce(sum(amount), 0) FROM refunds) - (SELECT coalesce(sum(amount), 0) FROM chargebacks) AS BIGINT) AS due,
  CAST((SELECT coalesce(sum(amount), 0) FROM chargebacks) AS BIGINT) AS cb, CAST((SELECT sum(expected_net) FROM r) AS BIGINT) AS net,
  CAST((SELECT coalesce(sum(amount), 0) FROM bank WHERE type = 'CREDIT' AND txn_id NOT IN (SELECT bank_txn_id FROM r WHERE bank_txn_id IS NOT NULL) AND utr NOT IN (SELECT utr FROM setl WHERE utr IS NOT NULL)) AS BIGINT) AS loose, CAST((SELECT coalesce(sum(amount), 0) FROM bank WHERE type = 'DEBIT') AS BIGINT) AS debit)
SELECT 'INPUT_COMPLETE' AS name, actual, 0::BIGINT AS expected, actual = 0 AS holds FROM (SELECT count(*) AS actual FROM pay WHERE payment_id NOT IN (SELECT payment_id FROM r))
UNION ALL SELECT 'NET_CONSERVED', net, due, abs(net - due) <= greatest(100, CAST(floor(abs(due) * 0.001 + 0.5) AS BIGINT)) FROM s
UNION ALL SELECT 'CREDITS_EXPLAINED', loose, 0, loose <= 100 FROM s
UNION ALL SELECT 'DEBITS_EXPLAINED', debit, cb, abs(debit - cb) <= greatest(100, CAST(floor(abs(cb) * 0.001 + 0.5) AS BIGINT)) FROM s
UNION ALL SELECT 'CONSUMED_ONCE', n, 0, n = 0 FROM (SELECT count(*) AS n FROM (SELECT bank_txn_id FROM r WHERE bank_txn_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'SETTLEMENTS_REFERENCED', n, 0, n = 0 FROM (SELECT count(*) AS n FROM setl WHERE payment_id NOT IN (SELECT payment_id FROM r))""")
def invariant_checks(spark, sf_dir):
    r, b = results(spark, sf_dir)
    return integrity.invariants(b["payments"], r, b["settlements"], b["bank"], b["refunds"], b["chargebacks"])


@query(""" SELECT s.utr, b.txn_id, s.bucket, s.n_settlements, s.settled, b.amount AS credited FROM (
  SELECT utr, CAST(floor(settled_s / 345600.0) AS BIGINT) AS bucket, count(*) AS n_settlements, CAST(sum(amount) AS BIGINT) AS settled FROM setl WHERE utr IS NOT NULL GROUP BY 1, 2) s
  JOIN bank b ON b.type = 'CREDIT' AND b.utr = s.utr AND CAST(floor(b.txn_s / 345600.0) AS BIGINT) = s.bucket WHERE abs(s.settled - b.amount) <= 100""")
def indexed_aggregation(spark, sf_dir):
    b = fixtures.batch(spark, sf_dir)
    return integrity.indexed_aggregation(b["settlements"], b["bank"])


@query("""SELECT r.seq, r.payment_id, 1 AS version, r.expected_net, r.settled_amount, r.status, r.score, d.outcome, d.risk,
  sha256(concat_ws('|', r.payment_id, '1', r.expected_net::VARCHAR, coalesce(r.settled_amount::VARCHAR, ''), r.status, r.score::VARCHAR)) AS entry_hash FROM r JOIN d USING (payment_id)""")
def ledger_entries(spark, sf_dir):
    r, _ = results(spark, sf_dir)
    return integrity.ledger(r, risk.decide(r))


@query("""SELECT payment_id, floor((0.4::DOUBLE * (1 - score / 100.0::DOUBLE) + 0.6::DOUBLE * f) * 10000 + 0.5) / 10000 AS routing_risk FROM (
  SELECT payment_id, score, floor(CASE WHEN payment_amount <= 10000 THEN 0.05::DOUBLE WHEN payment_amount >= 100000000 THEN 1.0::DOUBLE
    ELSE 0.05::DOUBLE + 0.95::DOUBLE * (log10(payment_amount::DOUBLE) - 4) / 4 END * 10000 + 0.5) / 10000 AS f FROM r)""")
def routing_risk(spark, sf_dir):
    r, _ = results(spark, sf_dir)
    return r.select("payment_id", risk.routing_risk(F.col("score") / 100, F.col("payment_amount")).alias("routing_risk"))


@query("""SELECT c_custkey AS left_id, s_suppkey AS right_id, round(1.0::DOUBLE - levenshtein(c_name, s_name)::DOUBLE / greatest(length(c_name), length(s_name)), 6) AS similarity
FROM customer JOIN supplier ON c_nationkey = s_nationkey
WHERE round(1.0::DOUBLE - levenshtein(c_name, s_name)::DOUBLE / greatest(length(c_name), length(s_name)), 6) >= 0.6""", results=False)
def entity_similarity(spark, sf_dir):
    """All pairs of a nation that are alike by 0.6; entity_similarity_by_nation goes down to 0.5."""
    c = fixtures.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("left_id"), F.col("c_name").alias("l_name"), F.col("c_nationkey").alias("block"))
    s = fixtures.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("right_id"), F.col("s_name").alias("r_name"), F.col("s_nationkey").alias("block"))
    return entities.similar(c, s, "block", 0.6).select("left_id", "right_id", "similarity")


@query("""SELECT c_custkey AS left_id, s_suppkey AS right_id, round(1.0::DOUBLE - levenshtein(c_name, s_name)::DOUBLE / greatest(length(c_name), length(s_name)), 6) AS similarity
FROM customer JOIN supplier ON c_nationkey = s_nationkey
WHERE round(1.0::DOUBLE - levenshtein(c_name, s_name)::DOUBLE / greatest(length(c_name), length(s_name)), 6) >= 0.5""", results=False)
def entity_similarity_by_nation(spark, sf_dir):
    """All pairs of a nation that are alike by 0.5."""
    c = fixtures.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("left_id"), F.col("c_name").alias("l_name"), F.col("c_nationkey").alias("block"))
    s = fixtures.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("right_id"), F.col("s_name").alias("r_name"), F.col("s_nationkey").alias("block"))
    return entities.similar(c, s, "block", 0.5).select("left_id", "right_id", "similarity")


EVENT_S = "CAST(floor(epoch(ts)) AS BIGINT)"


def events(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "events").withColumn("ts_s", F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"))


@query(f"SELECT user_id, event_type, {EVENT_S} // 345600 AS bucket, count(*) AS n, CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS BIGINT) AS amount FROM events GROUP BY 1, 2, 3", results=False)
def event_partition_keys(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.groupBy("user_id", "event_type", F.floor(F.col("ts_s") / 345600).alias("bucket")).agg(F.count("*").alias("n"), F.sum(fixtures.minor(F.col("value"))).alias("amount"))


@query(f"SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY {EVENT_S} RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS recent FROM events", results=False)
def sliding_rate(spark, sf_dir):
    return risk.merged_window_rate(events(spark, sf_dir), 3600).select("event_id", "user_id", "recent")


@query("""WITH RECURSIVE h AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, event_id || '|' || event_type AS payload FROM events),
c AS (SELECT user_id, seq, event_id, payload, repeat('0', 64) AS prev, sha256(repeat('0', 64) || payload) AS hash FROM h WHERE seq = 0
  UNION ALL SELECT h.user_id, h.seq, h.event_id, h.payload, c.hash, sha256(c.hash || h.payload) FROM c JOIN h ON h.user_id = c.user_id AND h.seq = c.seq + 1),
x AS (SELECT user_id, seq, CASE WHEN event_id % 797 = 0 THEN payload || '!' ELSE payload END AS payload, CASE WHEN event_id % 499 = 0 THEN 'moved' ELSE prev END AS prev,
  CASE WHEN event_id % 499 = 0 THEN sha256('moved' || payload) ELSE hash END AS hash FROM c WHERE event_id % 397 <> 0),
y AS (SELECT *, row_number() OVER w - 1 AS i, lag(hash) OVER w AS due FROM x WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
z AS (SELECT *, CASE WHEN i = 0 AND prev <> repeat('0', 64) THEN 'BAD_GENESIS' WHEN seq <> i THEN 'SEQ_GAP_OR_REORDER' WHEN hash <> sha256(prev || payload) THEN 'HASH_MISMATCH' WHEN i > 0 AND prev <> due THEN 'LINK_BROKEN' END AS reason FROM y)
SELECT user_id, count(*) AS n, count(reason) = 0 AS valid, arg_min(reason, seq) FILTER (reason IS NOT NULL) AS reason, min(seq) FILTER (reason IS NOT NULL) AS seq FROM z GROUP BY 1""", results=False)
def audit_chain_verify(spark, sf_dir):
    """A chain of events per user; some payloads are changed, some rows gone, some linked elsewhere: the first fault of each chain."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    e = events(spark, sf_dir).select("user_id", (F.row_number().over(w) - 1).alias("seq"), F.concat_ws("|", F.col("event_id").cast("string"), "event_type").alias("payload"))
    chain = integrity.chained(e, "user_id").withColumn("id", F.substring_index("payload", "|", 1).cast("long"))
    moved = F.col("id") % 499 == 0
    spoiled = chain.where("id % 397 <> 0").select(
        "user_id", "seq", F.when(F.col("id") % 797 == 0, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")).alias("payload"),
        F.when(moved, "moved").otherwise(F.col("previous_hash")).alias("previous_hash"), F.when(moved, integrity.chain_link(F.lit("moved"), F.col("payload"))).otherwise(F.col("hash")).alias("hash"),
    )
    return integrity.verified_chains(spoiled, "user_id")


from quittance.plans import cardinality as _cardinality, claims as _claims, edges as _edges, ingest as _ingest, invoices as _invoices, records as _records, review as _review, rollups as _rollups, states as _states, stores as _stores  # noqa: E402, F401
