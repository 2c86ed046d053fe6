"""Queries of exceptions, gates, states, keys, groups and roots."""

from __future__ import annotations

from pyspark.sql import functions as F

from quittance.functions import currency
from quittance.operators import exceptions, groups, metrics, risk, windows
from quittance.plans.base import query
from quittance.plans.registry import EVENT_S, FX_SQL, converted, events, orphans_of, pairs, results, truths
from quittance.sources import fixtures

ACTION_SQL = ", ".join("('{}', '{}')".format(k, v) for k, v in exceptions.ACTIONS.items())
EDGE_SQL = ", ".join(f"('{a}', '{b}')" for a, bs in exceptions.TRANSITIONS.items() for b in bs)
STATE_SQL = ", ".join(f"({i}, '{a}')" for i, a in enumerate(exceptions.TRANSITIONS))

EXC_SQL = f""", act AS (SELECT * FROM (VALUES {ACTION_SQL}) v(k, action)),
one AS (SELECT payment_id, min(settlement_id) AS settlement_id, string_agg(settlement_id, ',' ORDER BY settlement_id) AS settlements FROM setl GROUP BY 1),
e0 AS (
  SELECT r.payment_id, r.order_id, one.settlement_id, one.settlements, r.bank_txn_id, coalesce(nullif(r.expected_net, 0), nullif(r.bank_amount, 0), r.payment_amount) AS amount, r.mismatch, r.score, r.status AS exception_type, d.risk
  FROM r LEFT JOIN d USING (payment_id) LEFT JOIN one ON r.payment_id = one.payment_id WHERE r.status <> 'AUTO_MATCHED'
  UNION ALL SELECT NULL, NULL, NULL, NULL, txn_id, amount, NULL, score, status, CASE WHEN score < 30 THEN 'HIGH' WHEN score < 60 THEN 'MEDIUM' ELSE 'LOW' END FROM orphans),
exc AS (SELECT e0.*, act.action, 'exc_' || coalesce(payment_id, bank_txn_id) AS id FROM e0 LEFT JOIN act ON exception_type = k)
"""
ROWS = ["id", "payment_id", "order_id", "settlement_id", "settlements", "bank_txn_id", "amount", "mismatch", "score", "exception_type", "risk", "action"]
SHOWN = ["id", "amount", "score", "exception_type", "risk"]


def rows_of(spark, sf_dir):
    r, b = results(spark, sf_dir)
    return exceptions.exception_rows(r, orphans_of(r, b), risk.decide(r))


@query(EXC_SQL + f"SELECT {', '.join(ROWS)} FROM exc")
def exception_rows(spark, sf_dir):
    return rows_of(spark, sf_dir).select(*ROWS)


@query(EXC_SQL + f"SELECT {', '.join(SHOWN)} FROM exc WHERE score BETWEEN 0 AND 60 ORDER BY amount DESC, id LIMIT 20 OFFSET 20")
def exceptions_by_amount(spark, sf_dir):
    return exceptions.page(rows_of(spark, sf_dir), sort="amount", number=2, size=20, most=60).select(*SHOWN)


@query(EXC_SQL + f"SELECT {', '.join(SHOWN)} FROM exc WHERE contains(coalesce(payment_id, ''), '_1') OR contains(coalesce(order_id, ''), '_1') OR contains(coalesce(settlement_id, ''), '_1') OR contains(exception_type, '_1') OR contains(id, '_1') ORDER BY risk DESC, score, id LIMIT 50")
def exceptions_search(spark, sf_dir):
    return exceptions.page(rows_of(spark, sf_dir), search=" _1 ").select(*SHOWN)


@query(EXC_SQL + f"SELECT {', '.join(SHOWN)} FROM exc WHERE score < 70 AND exception_type NOT IN ('AUTO_MATCHED', 'PENDING_SETTLEMENT') ORDER BY score, id LIMIT 5")
def least_sure_exceptions(spark, sf_dir):
    return exceptions.least_sure(rows_of(spark, sf_dir)).select(*SHOWN)


@query(EXC_SQL + f"SELECT {', '.join(SHOWN)} FROM exc WHERE exception_type NOT IN ('AUTO_MATCHED', 'PENDING_SETTLEMENT', 'DELAYED_BANK_CREDIT') ORDER BY amount DESC, id LIMIT 5")
def exceptions_to_resolve(spark, sf_dir):
    return exceptions.to_resolve(rows_of(spark, sf_dir)).select(*SHOWN)


TRUTH_SQL = """CASE pay.class WHEN 9 THEN 'MISSING_BANK_CREDIT' WHEN 10 THEN 'MISSING_BANK_CREDIT' WHEN 11 THEN 'AMOUNT_MISMATCH' WHEN 12 THEN 'REFUND_MISMATCH' WHEN 13 THEN 'CHARGEBACK_ADJUSTMENT'
  WHEN 14 THEN 'DUPLICATE_SETTLEMENT' WHEN 15 THEN 'DELAYED_BANK_CREDIT' WHEN 17 THEN 'NEEDS_MANUAL_REVIEW' ELSE 'AUTO_MATCHED' END"""


@query(f""", t AS (SELECT count(*) AS n, count(*) FILTER (r.status = {TRUTH_SQL}) AS ok FROM r JOIN pay USING (payment_id)),
o AS (SELECT (SELECT count(*) FROM orphans) AS found, (SELECT count(*) FROM pay WHERE class = 16) AS labelled)
SELECT ok + CASE WHEN found > 0 AND labelled > 0 THEN least(found, labelled) ELSE 0 END AS correct, n + CASE WHEN found > 0 AND labelled > 0 THEN labelled ELSE 0 END AS evaluated FROM t, o""")
def accuracy_with_orphans(spark, sf_dir):
    r, b = results(spark, sf_dir)
    return metrics.accuracy(pairs(spark, sf_dir), orphans_of(r, b), truths(b["payments"]))


@query("""SELECT r.payment_id, CASE WHEN r.settled_amount IS NOT NULL AND r.bank_txn_id IS NOT NULL THEN 'NOT_YET_SETTLED' WHEN pay.captured_s IS NULL THEN NULL
  WHEN clock - pay.captured_s > 172800 THEN 'DELAYED_SETTLEMENT' WHEN clock - pay.captured_s < 43200 THEN 'NOT_YET_SETTLED' ELSE 'PENDING_SETTLEMENT' END AS state
FROM r JOIN pay USING (payment_id), (SELECT max(captured_s) AS clock FROM pay)""")
def temporal_states(spark, sf_dir):
    r, b = results(spark, sf_dir)
    clock = b["payments"].agg(F.max("captured_s").alias("clock"))  # one row
    state = exceptions.temporal_state(F.col("captured_s"), F.col("clock"), F.col("settled_amount").isNotNull(), F.col("bank_txn_id").isNotNull())
    return r.crossJoin(clock).select("payment_id", state.alias("state"))


@query(""", g AS (SELECT method, length(method) AS attempts, count(*) FILTER (own_risk = 'HIGH' AND method <> 'upi' AND method <> 'wallet') AS high, count(*) FILTER (own_risk = 'MEDIUM' AND method <> 'wallet') AS medium,
  count(*) FILTER (method = 'netbanking' AND outcome = 'EXCEPTION') AS failures FROM d GROUP BY 1)
SELECT method, CASE WHEN failures > 0 THEN 'CRITICAL_BLOCKED' WHEN high > 0 THEN 'MAKER_CHECKER_REQUIRED' WHEN medium > 0 THEN 'CONTROLLED_REVIEW' ELSE 'STRAIGHT_THROUGH' END AS routing,
  CASE WHEN failures > 0 THEN 'CRITICAL' WHEN high > 0 THEN 'HIGH' WHEN medium > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk, failures > 0 AND attempts >= 3 AS escalated,
  CASE WHEN failures > 0 AND attempts > 3 THEN 'ESCALATED_TO_CONTROLLER' END AS end_state FROM g""")
def risk_gates(spark, sf_dir):
    """A gate for each payment method; what counts as a failure and as risky is set so that all four routes are taken."""
    m = F.col("method")
    g = risk.decide(results(spark, sf_dir)[0]).groupBy("method").agg(
        F.count_if((F.col("own_risk") == "HIGH") & ~m.isin("upi", "wallet")).alias("high"),
        F.count_if((F.col("own_risk") == "MEDIUM") & (m != "wallet")).alias("medium"),
        F.count_if((m == "netbanking") & (F.col("outcome") == "EXCEPTION")).alias("failures"),
    )
    verdict = exceptions.gate(F.col("failures"), F.col("high"), F.col("medium"), F.length("method"))
    return g.select("method", *(c.alias(n) for n, c in verdict.items()))


@query("SELECT o_orderkey, CASE WHEN a > 3 THEN CASE WHEN risk IN ('CRITICAL', 'HIGH') THEN 'ESCALATED_TO_CONTROLLER' ELSE 'PERMANENTLY_BLOCKED_PENDING_REVIEW' END END AS end_state, CASE WHEN p <= 500000 THEN 'LOW' WHEN p <= 5000000 THEN 'MEDIUM' WHEN p <= 50000000 THEN 'HIGH' ELSE 'CRITICAL' END AS band FROM (SELECT o_orderkey, o_orderkey % 6 AS a, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) * CASE WHEN o_orderkey % 9 = 0 THEN 10 ELSE 1 END AS p, CASE (o_orderkey // 6) % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END AS risk FROM orders)", results=False)
def end_states_and_bands(spark, sf_dir):
    k = F.col("o_orderkey")
    level = F.element_at(F.array(*map(F.lit, ("LOW", "MEDIUM", "HIGH", "CRITICAL"))), (F.floor(k / 6) % 4 + 1).cast("int"))
    amount = fixtures.minor(F.col("o_totalprice")) * F.when(k % 9 == 0, 10).otherwise(1)
    return fixtures.table(spark, sf_dir, "orders").select("o_orderkey", exceptions.end_state(k % 6, level).alias("end_state"), exceptions.exposure_band(amount).alias("band"))


KINDS = ("Refund_late", "fee", "CHARGEBACK", "DELAYED_BANK_CREDIT", "dup_x", "FX", "MISSING_BANK_CREDIT", "AMOUNT_MISMATCH", "other", "")
FAMILIES = ("REFUND_VARIANCE", "FEE_MISMATCH", "CHARGEBACK_RISK", "SLA_BREACH", "DUPLICATE_CREDIT", "CROSS_CURRENCY", "MISSING_CREDIT", "AMOUNT_VARIANCE", "UNCLASSIFIED", "UNCLASSIFIED")
FAMILY_SQL = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(FAMILIES))


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'CROSS_CURRENCY' WHEN o_orderkey % 3 = 0 AND o_orderkey % 10 > 2 THEN 'SLA_BREACH' ELSE CASE o_orderkey % 10 {FAMILY_SQL} END END AS family FROM orders", results=False)
def risk_families(spark, sf_dir):
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (k % 10 + 1).cast("int"))
    money = F.when(k % 7 == 0, " usd ").when(k % 2 == 0, "inr")
    return fixtures.table(spark, sf_dir, "orders").select("o_orderkey", exceptions.risk_family(F.when(k % 3 == 0, " sla_breach "), kind, money).alias("family"))


@query(f"WITH s AS (SELECT * FROM (VALUES {STATE_SQL}) v(i, s)), e AS (SELECT * FROM (VALUES {EDGE_SQL}) v(a, b)) SELECT o_orderkey, x.s AS source, y.s AS target, e.a IS NOT NULL AS allowed FROM orders JOIN s x ON x.i = o_orderkey % 13 JOIN s y ON y.i = (o_orderkey // 13) % 13 LEFT JOIN e ON e.a = x.s AND e.b = y.s", results=False)
def workflow_transitions(spark, sf_dir):
    states = F.array(*map(F.lit, exceptions.TRANSITIONS))
    at = lambda i: F.element_at(states, (i % 13 + 1).cast("int"))
    o = fixtures.table(spark, sf_dir, "orders").select("o_orderkey", at(F.col("o_orderkey")).alias("source"), at(F.floor(F.col("o_orderkey") / 13)).alias("target"))
    return o.withColumn("allowed", exceptions.transition_allowed(F.col("source"), F.col("target")))


@query(FX_SQL + "SELECT c_custkey, x.currency, inr_minor, inr_minor * den // num AS back FROM x JOIN fx USING (currency)", results=False)
def fx_inverse(spark, sf_dir):
    return currency.from_inr(converted(spark, sf_dir), "inr_minor").select("c_custkey", "currency", "inr_minor", F.col("foreign_minor").alias("back"))


@query(f"SELECT event_id, concat_ws(':', user_id, event_type, 'INR', 'w' || ({EVENT_S} // 3600), 's' || (CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 4) AS BIGINT) % 64)) AS key FROM events", results=False)
def event_routing_keys(spark, sf_dir):
    key = windows.partition_key(F.col("user_id").cast("string"), F.col("event_type"), F.lit("INR"), F.col("ts_s"), F.col("event_id").cast("string"))
    return events(spark, sf_dir).select("event_id", key.alias("key"))


def apart(spark, sf_dir):
    """Settlements and credits of which every reference is shared by up to three, in windows up to four apart."""
    k = F.col("o_orderkey")
    o = fixtures.table(spark, sf_dir, "orders").select(k.alias("k"), F.concat(F.lit("U"), F.floor(k / 3)).alias("utr"), (F.floor(k / 3) * 7 + (k % 5 == 0).cast("int")).alias("amount"))
    s = o.where("k % 11 <> 0").select(F.concat(F.lit("s"), "k").alias("settlement_id"), "utr", "amount", (F.col("k") % 4).alias("window"))
    c = o.select(F.concat(F.lit("c"), "k").alias("txn_id"), F.when(F.col("k") % 13 != 0, F.col("utr")).alias("utr"), "amount", (F.col("k") % 5).alias("window"))
    return s, c


@query("""WITH RECURSIVE o AS (SELECT o_orderkey AS k, 'U' || (o_orderkey // 3) AS utr, (o_orderkey // 3) * 7 + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS amount FROM orders),
p AS (SELECT 'c' || c.k AS c, 's' || s.k AS s, c.utr FROM o c JOIN o s ON c.utr = s.utr AND c.amount = s.amount AND abs(c.k % 5 - s.k % 4) <= 2 WHERE c.k % 13 <> 0 AND s.k % 11 <> 0),
q AS (SELECT utr, list(c || '>' || s ORDER BY c, s) AS l FROM p GROUP BY 1),
w AS (SELECT utr, l, 1 AS i, []::VARCHAR[] AS got FROM q
  UNION ALL SELECT utr, l, i + 1, CASE WHEN list_has_any(got, string_split(l[i], '>')) THEN got ELSE got || string_split(l[i], '>') END FROM w WHERE i <= len(l))
SELECT utr, got[2 * j - 1] AS txn_id, got[2 * j] AS settlement_id, 0::BIGINT AS difference FROM (SELECT utr, got, unnest(range(1, len(got) // 2 + 1)) AS j FROM w WHERE i = len(l) + 1)""", results=False)
def cross_window_matches(spark, sf_dir):
    return windows.cross_window_matches(*apart(spark, sf_dir))


@query("""WITH RECURSIVE lv AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n, sha256(CAST(event_id AS VARCHAR)) AS h FROM events
  UNION ALL SELECT user_id, pos // 2, (any_value(n) + 1) // 2, sha256(arg_min(h, pos) || arg_max(h, pos)) FROM lv WHERE n > 1 GROUP BY user_id, pos // 2)
SELECT user_id, h AS root FROM lv WHERE n = 1""", results=False)
def merkle_roots(spark, sf_dir):
    """The root over the events of each user."""
    from pyspark.sql import Window

    e = events(spark, sf_dir).select(F.col("user_id").alias("grp"), (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("pos"), F.sha2(F.col("event_id").cast("string"), 256).alias("hash"))
    return windows.merkle_roots(e).withColumnRenamed("grp", "user_id")


@query("""WITH RECURSIVE lv AS (SELECT user_id, 0 AS d, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n, sha256(CAST(event_id AS VARCHAR)) AS h FROM events
  UNION ALL SELECT user_id, any_value(d) + 1, pos // 2, (any_value(n) + 1) // 2, sha256(arg_min(h, pos) || arg_max(h, pos)) FROM lv WHERE n > 1 GROUP BY user_id, pos // 2),
leaf AS (SELECT user_id, pos, h FROM lv WHERE d = 0),
step AS (SELECT leaf.user_id, leaf.pos, lv.d, CASE WHEN (leaf.pos >> lv.d) % 2 = 1 THEN 'L' || lv.h ELSE 'R' || coalesce(nx.h, lv.h) END AS s FROM leaf
  JOIN lv own ON own.user_id = leaf.user_id AND own.n > 1 AND own.pos = leaf.pos >> own.d
  JOIN lv ON lv.user_id = own.user_id AND lv.d = own.d AND lv.pos = own.pos - own.pos % 2
  LEFT JOIN lv nx ON nx.user_id = own.user_id AND nx.d = own.d AND nx.pos = own.pos + 1)
SELECT leaf.user_id, leaf.pos, count(s) AS n_steps, sha256(coalesce(string_agg(s, ',' ORDER BY d), '')) AS path, true AS holds, false AS changed_holds FROM leaf LEFT JOIN step ON step.user_id = leaf.user_id AND step.pos = leaf.pos GROUP BY 1, 2""", results=False)
def merkle_proofs(spark, sf_dir):
    """The proof of every event of a user: it leads to the root, and that of a changed leaf doesn't."""
    from pyspark.sql import Window

    e = events(spark, sf_dir).select(F.col("user_id").alias("grp"), (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long").alias("pos"), F.sha2(F.col("event_id").cast("string"), 256).alias("hash"))
    p = windows.merkle_proofs(e)
    path = F.sha2(F.array_join(F.transform("steps", lambda s: F.concat(F.when(s["left"], "L").otherwise("R"), s["hash"])), ","), 256)
    holds = lambda leaf: windows.proof_holds(leaf, F.col("steps"), F.col("root"))
    return p.select(F.col("grp").alias("user_id"), "pos", F.size("steps").cast("long").alias("n_steps"), path.alias("path"), holds(F.col("hash")).alias("holds"), holds(F.sha2("hash", 256)).alias("changed_holds"))


@query("""WITH i AS (SELECT l_orderkey AS k, l_orderkey || '-' || l_linenumber AS id, CAST(floor(max(l_extendedprice) * 100 + 0.5) AS BIGINT) AS amount, l_linenumber AS nr FROM lineitem GROUP BY l_orderkey, l_linenumber),
c AS (SELECT k, CAST(sum(amount) + CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN 60 WHEN 2 THEN 100 ELSE 5000 END AS BIGINT) AS credited FROM i WHERE nr % 3 <> 0 GROUP BY 1),
t AS (SELECT i.k, id, amount, credited, row_number() OVER (PARTITION BY i.k ORDER BY abs(amount - credited), id) AS place, count(*) OVER (PARTITION BY i.k) AS n FROM i JOIN c USING (k)),
m AS (SELECT t.k, mask, any_value(credited) AS credited, CAST(sum(amount) AS BIGINT) AS settled, count(*) AS n, string_agg(CAST(place AS VARCHAR), '' ORDER BY place) AS tuple, string_agg(id, ',' ORDER BY id) AS ids
  FROM t JOIN range(1, 128) g(mask) ON (mask >> (place - 1)) & 1 = 1 AND mask < (1 << t.n) GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT 'c' || k AS txn_id, ids AS settlement_ids, n, settled, credited, abs(settled - credited) AS difference, CASE WHEN settled = credited THEN 96 ELSE 90 END AS confidence
FROM m WHERE abs(settled - credited) <= 100 QUALIFY row_number() OVER (PARTITION BY k ORDER BY abs(settled - credited), n, tuple) = 1""", results=False)
def settlement_groups(spark, sf_dir):
    """The numbered lines of an order as settlements, and a credit of some of them, exact, near or off."""
    numbered = fixtures.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("price"))
    line = numbered.select(F.col("l_orderkey").alias("cluster"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("settlement_id"), fixtures.minor(F.col("price")).alias("amount"), "l_linenumber")
    shift = F.element_at(F.array(*map(F.lit, (0, 60, 100, 5000))), (F.col("cluster") % 4 + 1).cast("int"))
    credit = line.where("l_linenumber % 3 <> 0").groupBy("cluster").agg(F.sum("amount").alias("amount")).select("cluster", F.concat(F.lit("c"), "cluster").alias("txn_id"), (F.col("amount") + shift).alias("amount"))
    return groups.settlement_groups(line, credit).withColumn("settlement_ids", F.array_join("settlement_ids", ","))
