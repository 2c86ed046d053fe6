"""Queries of evidence, late adjustments, corrections, versions, exports and totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from quittance.operators import cardinality, evidence, groups, ledgers, windows
from quittance.plans.base import ORACLE_SQL, query
from quittance.plans.registry import events, results
from quittance.plans.review import apart
from quittance.sources import exports, fixtures

MINOR_SQL = "CAST(floor({} * 100 + 0.5) AS BIGINT)"


def chosen(values, i):
    return F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))


def lines(spark, sf_dir):
    """The numbered lines of orders, each once."""
    numbered = fixtures.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("price"))
    return numbered.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("nr"), fixtures.minor(F.col("price")).alias("amount"))


LINES_SQL = "i AS (SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS nr, CAST(floor(max(l_extendedprice) * 100 + 0.5) AS BIGINT) AS amount FROM lineitem GROUP BY 1, 2)"

NORM_SQL = "CASE WHEN len(regexp_split_to_array({0}, '[-_:]')) > 1 THEN regexp_split_to_array({0}, '[-_:]')[1] || '-' || translate(array_to_string(regexp_split_to_array({0}, '[-_:]')[2:], '-'), 'OIL|', '0111') ELSE {0} END"
CLEAN_SQL = "regexp_replace(upper(trim({})), '^[#:_-]+|[#:_-]+$', '', 'g')"


@query(f"""WITH known AS (SELECT 'Cus-' || lpad(CAST(c_custkey * 7 AS VARCHAR), 7, '0') AS id, c_custkey AS k FROM customer),
t0 AS (SELECT k, id, CASE k % 9 WHEN 0 THEN ' ' || upper(id) || ' ' WHEN 1 THEN '#' || replace(id, '0', 'O') || ':' WHEN 2 THEN replace(id, '1', 'l') WHEN 3 THEN left(id, 5) || right(id, 5)
  WHEN 4 THEN id || 'x' WHEN 5 THEN left(id, length(id) - 1) || 'Q' WHEN 6 THEN 'ref ' || k WHEN 7 THEN left(id, length(id) - 1) END AS token FROM known),
t AS (SELECT k, trim(token) AS token, lower(trim(token)) AS low, {CLEAN_SQL.format('token')} AS c FROM t0),
kn AS (SELECT id, {CLEAN_SQL.format('id')} AS c FROM known),
ex AS (SELECT t.k, min(id) AS id FROM t JOIN known ON lower(id) = low GROUP BY 1),
no AS (SELECT t.k, min(kn.id) AS id FROM t JOIN kn ON {NORM_SQL.format('kn.c')} = {NORM_SQL.format('t.c')} GROUP BY 1),
ne AS (SELECT t.k, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM t JOIN known ON abs(length(low) - length(id)) <= 1 AND levenshtein(low, lower(id)) <= 1 GROUP BY 1)
SELECT t.k AS token_id, CASE WHEN ex.id IS NOT NULL THEN 'VERIFIED_EXACT' WHEN no.id IS NOT NULL OR n = 1 THEN 'VERIFIED_FUZZY_NORMALIZED' WHEN n > 1 THEN 'AMBIGUOUS_MULTIPLE_CANDIDATES' ELSE 'UNRESOLVED_NO_MATCH' END AS status,
  coalesce(ex.id, no.id, CASE WHEN n = 1 THEN ids END) AS matched_id,
  CAST(CASE WHEN ex.id IS NOT NULL THEN 0 WHEN no.id IS NOT NULL THEN levenshtein(t.token, no.id) WHEN n > 0 THEN 1 END AS INTEGER) AS distance,
  CASE WHEN ex.id IS NULL AND no.id IS NULL AND n > 1 THEN ids END AS candidates
FROM t LEFT JOIN ex USING (k) LEFT JOIN no USING (k) LEFT JOIN ne USING (k)""", results=False)
def resolved_ids(spark, sf_dir):
    k = F.col("k")
    known = fixtures.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("Cus-"), F.lpad((F.col("c_custkey") * 7).cast("string"), 7, "0")).alias("id"))
    i = F.col("id")
    cut = F.left(i, F.length(i) - 1)
    forms = (F.concat(F.lit(" "), F.upper(i), F.lit(" ")), F.concat(F.lit("#"), F.replace(i, F.lit("0"), F.lit("O")), F.lit(":")), F.replace(i, F.lit("1"), F.lit("l")), F.concat(F.left(i, F.lit(5)), F.right(i, F.lit(5))), F.concat(i, F.lit("x")), F.concat(cut, F.lit("Q")), F.concat(F.lit("ref "), "k"), cut)
    token = F.coalesce(*(F.when(k % 9 == n, f) for n, f in enumerate(forms)))
    found = evidence.resolve_ids(known.select(k.alias("token_id"), token.alias("token")), known)
    return found.withColumn("candidates", F.array_join("candidates", ","))


STATES = ("settled", "reversed", "captured", "failed", "paid", "cancelled")
ITEM_SQL = f"""WITH {LINES_SQL},
e AS (SELECT k AS record_id, k || '-' || nr AS evidence_id, nr * 7 % 5 AS "at", CASE WHEN nr % 4 > 0 THEN nr % 3 * 30000 END AS amount, CASE (k + nr) % 4 WHEN 0 THEN 'INR' WHEN 1 THEN 'INR' WHEN 2 THEN 'USD' ELSE '' END AS currency,
  ({list(STATES)})[(k + nr * nr) % 6 + 1] AS status, (k + nr) % 4 + 1 AS level, CASE nr % 2 WHEN 0 THEN 'EMAIL' ELSE 'PAYMENT' END AS kind FROM i)"""


def items(spark, sf_dir):
    k, nr = F.col("k"), F.col("nr")
    return lines(spark, sf_dir).select(
        k.alias("record_id"), F.concat_ws("-", "k", "nr").alias("evidence_id"), (nr * 7 % 5).alias("at"), F.when(nr % 4 > 0, nr % 3 * 30000).alias("amount"), chosen(("INR", "INR", "USD", ""), k + nr).alias("currency"),
        chosen(STATES, k + nr * nr).alias("status"), ((k + nr) % 4 + 1).alias("level"), F.when(nr % 2 == 0, "EMAIL").otherwise("PAYMENT").alias("kind"),
    )


@query(ITEM_SQL + """, s AS (SELECT * FROM e WHERE level <= 3),
p AS (SELECT x.record_id, x AS x, y AS y FROM s x JOIN s y ON x.record_id = y.record_id AND (x."at", x.evidence_id) < (y."at", y.evidence_id)),
v AS (SELECT record_id, 'AMOUNT_MISMATCH' AS type, least(x.amount, y.amount)::VARCHAR AS value_a, greatest(x.amount, y.amount)::VARCHAR AS value_b, CASE WHEN abs(x.amount - y.amount) > 50000 THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM p WHERE x.amount <> y.amount
  UNION SELECT record_id, 'CURRENCY_MISMATCH', least(x.currency, y.currency), greatest(x.currency, y.currency), 'HIGH' FROM p WHERE x.currency <> y.currency AND x.currency <> '' AND y.currency <> ''
  UNION SELECT record_id, 'STATUS_MISMATCH', x.status, y.status, 'CRITICAL' FROM p WHERE (x.status, y.status) IN (('settled', 'reversed'), ('captured', 'failed'), ('paid', 'cancelled')))
SELECT v.*, (SELECT arg_min(evidence_id, ("at", evidence_id)) FROM s WHERE s.record_id = v.record_id AND CASE type WHEN 'AMOUNT_MISMATCH' THEN amount::VARCHAR WHEN 'CURRENCY_MISMATCH' THEN currency ELSE status END = value_a) AS evidence_a,
  CASE type WHEN 'STATUS_MISMATCH' THEN (SELECT arg_max(evidence_id, ("at", evidence_id)) FROM s WHERE s.record_id = v.record_id AND status = value_b)
    ELSE (SELECT arg_min(evidence_id, ("at", evidence_id)) FROM s WHERE s.record_id = v.record_id AND CASE type WHEN 'AMOUNT_MISMATCH' THEN amount::VARCHAR ELSE currency END = value_b) END AS evidence_b FROM v""", results=False)
def evidence_contradictions(spark, sf_dir):
    return evidence.contradictions(evidence.visible(items(spark, sf_dir), "RESTRICTED"))


@query(ITEM_SQL + " SELECT record_id, count(*) AS n, string_agg(evidence_id, ',' ORDER BY \"at\", evidence_id) AS timeline FROM e WHERE level <= 2 AND kind IN ('EMAIL') GROUP BY 1", results=False)
def evidence_timelines(spark, sf_dir):
    seen = evidence.visible(items(spark, sf_dir), "CONFIDENTIAL", ["EMAIL"])
    order = F.sort_array(F.collect_list(F.struct("at", "evidence_id")))
    return seen.groupBy("record_id").agg(F.count("*").alias("n"), F.array_join(order["evidence_id"], ",").alias("timeline"))


@query("""WITH e AS (SELECT DISTINCT 'c' || o_custkey AS a, 'o' || o_orderkey AS b, 'placed' AS kind FROM orders UNION SELECT 'o' || l_orderkey, 's' || l_suppkey, 'supplied' FROM lineitem),
v AS (SELECT DISTINCT node FROM (SELECT a AS node FROM e UNION SELECT b FROM e) WHERE CAST(substr(node, 2) AS BIGINT) % 4 < 3),
w AS (SELECT a AS node, b AS t FROM e UNION SELECT b, a FROM e),
r0 AS (SELECT node AS root, node FROM v WHERE node LIKE 'c%'),
r1 AS (SELECT DISTINCT root, t AS node FROM r0 JOIN w USING (node) WHERE t IN (FROM v)),
i AS (SELECT * FROM r0 UNION SELECT * FROM r1),
n AS (SELECT * FROM i UNION SELECT DISTINCT root, t FROM r1 JOIN w USING (node) WHERE t IN (FROM v)),
g AS (SELECT root, a, b, kind FROM i JOIN e ON a = node UNION SELECT root, a, b, kind FROM i JOIN e ON b = node),
m AS (SELECT root, count(*) AS n_edges FROM g WHERE (root, a) IN (FROM n) AND (root, b) IN (FROM n) GROUP BY 1)
SELECT root, count(*) AS n_nodes, coalesce(any_value(n_edges), 0) AS n_edges FROM n LEFT JOIN m USING (root) GROUP BY 1""", results=False)
def evidence_neighbourhoods(spark, sf_dir):
    """What lies within two steps of each customer in the graph of customers, orders and suppliers."""
    name = lambda x, c: F.concat(F.lit(x), F.col(c))
    o = fixtures.table(spark, sf_dir, "orders").select(name("c", "o_custkey").alias("a"), name("o", "o_orderkey").alias("b"), F.lit("placed").alias("kind"))
    s = fixtures.table(spark, sf_dir, "lineitem").select(name("o", "l_orderkey").alias("a"), name("s", "l_suppkey").alias("b"), F.lit("supplied").alias("kind"))
    edges = o.unionByName(s).distinct()
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct().withColumn("level", (F.substring("node", 2, 20).cast("long") % 4 + 1).cast("int"))
    seen, ways = evidence.neighbourhoods(nodes, edges, nodes.where("node LIKE 'c%'").select(F.col("node").alias("root")), 2, "RESTRICTED")
    n = seen.groupBy("root").agg(F.count("*").alias("n_nodes"))
    return n.join(ways.groupBy("root").agg(F.count("*").alias("n_edges")), "root", "left").fillna(0, ["n_edges"])


@query(f"""WITH {LINES_SQL}, x AS (SELECT k, list(DISTINCT (['PAYMENT', 'SETTLEMENT', 'INVOICE', 'BANK_RECORD', 'EMAIL'])[amount % 5 + 1]) AS s FROM i GROUP BY 1)
SELECT k AS record_id, CASE WHEN k % 11 = 0 THEN 'CONFLICTING' WHEN NOT list_contains(s, 'PAYMENT') OR NOT list_has_any(s, ['SETTLEMENT', 'BANK_RECORD']) THEN 'MISSING_CRITICAL_SOURCE'
  WHEN NOT list_contains(s, 'INVOICE') AND len(s) < 3 THEN 'PARTIAL' ELSE 'COMPLETE' END AS state FROM x""", results=False)
def evidence_completeness(spark, sf_dir):
    kinds = lines(spark, sf_dir).groupBy("k").agg(F.collect_set(chosen(("PAYMENT", "SETTLEMENT", "INVOICE", "BANK_RECORD", "EMAIL"), F.col("amount"))).alias("kinds"))
    return kinds.select(F.col("k").alias("record_id"), evidence.completeness(F.col("kinds"), F.col("k") % 11 == 0).alias("state"))


def late(spark, sf_dir):
    """Entries of orders, and an event of each line that moves their net by parts of the line, some without an entry, three keys an order."""
    o = fixtures.table(spark, sf_dir, "orders").select(F.concat(F.lit("L"), "o_orderkey").alias("entry_id"), fixtures.minor(F.col("o_totalprice")).alias("gross"))
    k, nr = F.col("k"), F.col("nr")
    moved = lines(spark, sf_dir).select(
        (k * 10 + nr).alias("seq"), F.concat_ws("-", F.lit("ev"), "k", "nr").alias("event_id"), F.when((k + nr) % 5 == 0, "none").otherwise(F.concat(F.lit("L"), "k")).alias("entry_id"),
        F.concat_ws("-", k, nr % 3).alias("key"), F.floor(F.col("amount") * (nr % 4 - 2) / 4).cast("long").alias("amount"),
    )
    return o.withColumn("net", F.floor(F.col("gross") * 9 / 10).cast("long")), moved


@query(f"""WITH {LINES_SQL}, l AS (SELECT 'L' || o_orderkey AS entry_id, {MINOR_SQL.format('o_totalprice')} AS gross FROM orders),
v AS (SELECT k * 10 + nr AS seq, 'ev-' || k || '-' || nr AS event_id, CASE WHEN (k + nr) % 5 = 0 THEN 'none' ELSE 'L' || k END AS entry_id, k || '-' || nr % 3 AS key, CAST(floor(amount * (nr % 4 - 2) / 4.0) AS BIGINT) AS amount FROM i),
j AS (SELECT v.*, gross, gross * 9 // 10 + amount AS net, gross IS NOT NULL AND gross * 9 // 10 + amount BETWEEN 0 AND gross AS valid, 'adj_' || substr(sha256(concat_ws('|', entry_id, event_id, amount::VARCHAR, key)), 1, 16) AS adj FROM v LEFT JOIN l USING (entry_id)),
f AS (SELECT *, min(CASE WHEN valid THEN seq END) OVER (PARTITION BY key) AS first FROM j)
SELECT f.event_id, CASE WHEN f.seq = f.first THEN 'APPLIED' WHEN f.seq > f.first THEN 'DUPLICATE' WHEN f.gross IS NULL THEN 'PARENT_LEDGER_ENTRY_NOT_FOUND' ELSE 'INVARIANT_BREACH' END AS status,
  CASE WHEN f.seq >= f.first THEN g.adj END AS adjustment_id, CASE WHEN f.seq >= f.first THEN g.net END AS effective_net FROM f LEFT JOIN f g ON g.key = f.key AND g.seq = f.first""", results=False)
def late_adjustments(spark, sf_dir):
    return ledgers.adjust(*late(spark, sf_dir))


KINDS = ("SETTLEMENT_VARIANCE", "MISSING_DEBIT", "MISSING_CREDIT", "DUPLICATE_POSTING_REVERSAL", "FEE_ADJUSTMENT", "UNSUPPORTED_CORRECTION")
ACCOUNT_SQL = ", ".join("('{}', {}, '{}', '{}')".format(t, f"'{x}'" if x else "NULL", a, b) for t, x, a, b in ledgers.ACCOUNTS)
CORRECTION_SQL = f"""WITH b AS (SELECT o_orderkey AS txn_id, ({list(KINDS)})[o_orderkey % 6 + 1] AS type, {MINOR_SQL.format('o_totalprice')} AS debit, {MINOR_SQL.format('o_totalprice')} + (o_orderkey % 5 - 2) * o_orderkey AS credit FROM orders),
m AS (SELECT * FROM (VALUES {ACCOUNT_SQL}) v(type, lacks, dr, cr)),
j AS (SELECT txn_id, abs(debit - credit) AS amount, dr, cr FROM b JOIN m ON b.type = m.type AND (lacks IS NULL OR lacks = CASE WHEN debit < credit THEN 'DEBIT' ELSE 'CREDIT' END) WHERE debit <> credit),
l AS (SELECT txn_id, 'DEBIT' AS side, dr AS account, amount FROM j UNION ALL SELECT txn_id, 'CREDIT', cr, amount FROM j) """


def corrections(spark, sf_dir):
    k = F.col("o_orderkey")
    o = fixtures.table(spark, sf_dir, "orders").select(k.alias("txn_id"), chosen(KINDS, k).alias("type"), fixtures.minor(F.col("o_totalprice")).alias("debit"))
    return ledgers.correction_lines(o.withColumn("credit", F.col("debit") + (F.col("txn_id") % 5 - 2) * F.col("txn_id")))


@query(CORRECTION_SQL + "SELECT * FROM l", results=False)
def correction_journal(spark, sf_dir):
    return corrections(spark, sf_dir)


@query(CORRECTION_SQL + "SELECT account, CAST(sum(CASE side WHEN 'DEBIT' THEN amount ELSE 0 END) AS BIGINT) AS debits, CAST(sum(CASE side WHEN 'CREDIT' THEN amount ELSE 0 END) AS BIGINT) AS credits, debits = credits AS balanced FROM l GROUP BY 1", results=False)
def account_balances(spark, sf_dir):
    return ledgers.double_entry(corrections(spark, sf_dir), "account")


@query(""", x AS (SELECT *, coalesce(settled_amount, 0) AS s, payment_amount - fee - tax - refund_amount - chargeback_amount AS net FROM r)
SELECT payment_id, CASE WHEN abs(net - s - coalesce(mismatch, 0)) > 100 THEN 'CONSERVATION_EQUATION_MISMATCH' WHEN seq % 13 = 0 THEN 'DOUBLE_ENTRY_IMBALANCE' WHEN s > coalesce(bank_amount, 0) THEN 'CREDIT_OVER_ALLOCATION'
  WHEN least(payment_amount, fee, tax, refund_amount, chargeback_amount, s) < 0 THEN 'NEGATIVE_DOMAIN_VIOLATION' END AS violated FROM x""")
def conservation_proofs(spark, sf_dir):
    """Theorems on each result; of every 13th the debits are one too many."""
    r, _ = results(spark, sf_dir)
    c, none = F.col, F.lit(0)
    settled = F.coalesce("settled_amount", none)
    debits = c("payment_amount") + (c("seq") % 13 == 0).cast("int")
    name = ledgers.violated(c("payment_amount"), c("fee"), c("tax"), c("refund_amount"), c("chargeback_amount"), settled, F.coalesce("mismatch", none), debits, c("payment_amount"), settled, F.coalesce("bank_amount", none), 100)
    return r.select("payment_id", name.alias("violated"))


@query(""", x AS (SELECT method, status = 'AUTO_MATCHED' AS matched, payment_amount AS gross, coalesce(settled_amount, 0) AS settled FROM r)
SELECT method AS tenant, count(*) AS n, count(*) FILTER (matched) AS matched, CAST(floor(count(*) FILTER (matched) * 1000 / count(*) + 0.5) AS BIGINT) AS rate, CAST(sum(gross) AS BIGINT) AS gross, CAST(sum(settled) AS BIGINT) AS settled, CAST(sum(gross - settled) AS BIGINT) AS discrepancy, true AS conserved FROM x GROUP BY ROLLUP (method)""")
def tenant_totals(spark, sf_dir):
    settled = F.coalesce("settled_amount", F.lit(0))
    rows = results(spark, sf_dir)[0].select("method", (F.col("status") == "AUTO_MATCHED").alias("matched"), F.col("payment_amount").alias("gross"), settled.alias("settled"), (F.col("payment_amount") - settled).alias("discrepancy"))
    return ledgers.tenant_rollup(rows, "method")


@query(f"""WITH e AS (SELECT event_type, {MINOR_SQL.format('value')} AS v FROM events), b AS (SELECT unnest({list(ledgers.LATENCY_BOUNDS)})::BIGINT AS le)
SELECT event_type, le, count(*) FILTER (v <= le) AS n, NULL::BIGINT AS total FROM e, b GROUP BY 1, 2 UNION ALL SELECT event_type, NULL, count(*), CAST(sum(v) AS BIGINT) FROM e GROUP BY 1""", results=False)
def value_histograms(spark, sf_dir):
    return ledgers.histogram(events(spark, sf_dir).select("event_type", fixtures.minor(F.col("value")).alias("v")), "event_type", "v")


@query("WITH RECURSIVE " + ORACLE_SQL["cross_window_matches"].removeprefix("WITH RECURSIVE ").replace("\nSELECT utr, got[2", ",\nm AS (SELECT utr, got[2") + """),
s AS (SELECT 's' || k AS id, amount FROM o WHERE k % 11 <> 0), c AS (SELECT 'c' || k AS id, amount FROM o),
us AS (SELECT settlement_id AS id, count(*) AS n FROM m GROUP BY 1), uc AS (SELECT txn_id AS id, count(*) AS n FROM m GROUP BY 1),
v AS (SELECT 'SETTLEMENT_USED_ONCE' AS name, (SELECT count(*) FROM us WHERE n > 1) AS actual, 0::BIGINT AS expected
  UNION ALL SELECT 'CREDIT_USED_ONCE', (SELECT count(*) FROM uc WHERE n > 1), 0
  UNION ALL SELECT 'SETTLEMENT_COMPLETE', (SELECT count(*) FROM us) + (SELECT count(*) FROM s ANTI JOIN us USING (id)), (SELECT count(*) FROM s)
  UNION ALL SELECT 'CREDIT_COMPLETE', (SELECT count(*) FROM uc) + (SELECT count(*) FROM c ANTI JOIN uc USING (id)), (SELECT count(*) FROM c)
  UNION ALL SELECT 'MONEY_CONSERVED', CAST(abs((SELECT sum(s.amount) FROM m JOIN s ON s.id = m.settlement_id) - (SELECT sum(c.amount) FROM m JOIN c ON c.id = m.txn_id)) AS BIGINT), (SELECT CAST(sum(difference) AS BIGINT) FROM m))
SELECT name, actual, expected, actual = expected AS holds FROM v""", results=False)
def cross_window_invariants(spark, sf_dir):
    """The matches between windows use each id once, leave the others open and lose no money; tests break each of these."""
    s, c = apart(spark, sf_dir)
    m = windows.cross_window_matches(s, c)
    whole = m.join(s.select("settlement_id", F.col("amount").alias("settled")), "settlement_id").join(c.select("txn_id", F.col("amount").alias("credited")), "txn_id")
    told = lambda x, id_: x.join(m.select(id_, F.lit(True).alias("hit")), id_, "left").select(id_, F.col("hit").isNotNull().alias("resolved"))
    return ledgers.partition_invariants(told(s, "settlement_id"), told(c, "txn_id"), whole)


PART_SQL = ", ".join(f"coalesce(sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT)), 0)::VARCHAR" for i in range(4))


@query(f", h AS (SELECT sha256(concat_ws('|', 'v' || payment_id, 'v' || status, coalesce('v' || expected_net, 'n'), coalesce('v' || bank_amount, 'n'), coalesce('v' || mismatch, 'n'), 'v' || score)) AS h FROM r) SELECT count(*) AS n, sha256(concat_ws('|', count(*)::VARCHAR, {PART_SQL})) AS fingerprint FROM h")
def outcome_fingerprint(spark, sf_dir):
    return ledgers.fingerprint(results(spark, sf_dir)[0], ["payment_id", "status", "expected_net", "bank_amount", "mismatch", "score"])


@query("WITH h AS (SELECT sha256(concat_ws('|', 'v' || o_orderkey, 'v' || o_custkey, 'v' || o_orderstatus)) AS h FROM orders) SELECT count(*) AS n, sha256(concat_ws('|', count(*)::VARCHAR, " + PART_SQL + ")) AS fingerprint FROM h", results=False)
def input_fingerprint(spark, sf_dir):
    return ledgers.fingerprint(fixtures.table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"])


@query(""", old AS (SELECT payment_id, 1 AS version, status AS value FROM r WHERE seq % 4 <> 0), fresh AS (SELECT payment_id, status || '!' AS value FROM r WHERE seq % 3 = 0)
SELECT payment_id, version, value, CASE WHEN payment_id IN (SELECT payment_id FROM fresh) THEN 'SUPERSEDED' ELSE 'ACTIVE' END AS state FROM old
UNION ALL SELECT f.payment_id, CASE WHEN o.version IS NULL THEN 1 ELSE 2 END, f.value, 'ACTIVE' FROM fresh f LEFT JOIN old o USING (payment_id)""")
def superseded_ledger(spark, sf_dir):
    r, _ = results(spark, sf_dir)
    old = r.where("seq % 4 <> 0").select("payment_id", F.lit(1).alias("version"), F.col("status").alias("value"), F.lit("ACTIVE").alias("state"))
    return ledgers.superseded(old, r.where("seq % 3 = 0").select("payment_id", F.concat("status", F.lit("!")).alias("value")), "payment_id")


@query(""", a AS (SELECT payment_id, status, bank_amount AS amount FROM r WHERE seq % 4 <> 0), b AS (SELECT payment_id, CASE WHEN seq % 6 = 0 THEN NULL ELSE 'NEW' END AS status, bank_amount + 1 AS amount FROM r WHERE seq % 3 = 0)
SELECT payment_id, coalesce(b.status, a.status) AS status, coalesce(b.amount, a.amount) AS amount FROM a FULL JOIN b USING (payment_id)""")
def upserted_results(spark, sf_dir):
    r, _ = results(spark, sf_dir)
    old = r.where("seq % 4 <> 0").select("payment_id", "status", F.col("bank_amount").alias("amount"))
    return ledgers.upserted(old, r.where("seq % 3 = 0").select("payment_id", F.when(F.col("seq") % 6 != 0, "NEW").alias("status"), (F.col("bank_amount") + 1).alias("amount")), "payment_id")


@query(" SELECT concat_ws(chr(9), payment_id, status, coalesce(bank_amount::VARCHAR, '\\N'), coalesce(bank_txn_id, '\\N')) AS value FROM r")
def tab_export(spark, sf_dir):
    return exports.tab_lines(results(spark, sf_dir)[0].select("payment_id", "status", "bank_amount", "bank_txn_id"))


@query(" SELECT payment_id, status, bank_amount, bank_txn_id FROM r")
def json_export_read_back(spark, sf_dir):
    r = results(spark, sf_dir)[0].select("payment_id", "status", "bank_amount", "bank_txn_id")
    return exports.from_json_lines(exports.json_lines(r), r.schema)


@query("SELECT txn_id AS settlement_id, settlement_ids AS txn_ids, n, settled AS credited, credited AS settled, difference, confidence FROM (" + ORACLE_SQL["settlement_groups"] + ")", results=False)
def credit_groups(spark, sf_dir):
    """The lines of an order as credits of one settlement, exact, near or off."""
    line = lines(spark, sf_dir).select(F.col("k").alias("cluster"), F.concat_ws("-", "k", "nr").alias("txn_id"), "amount", "nr")
    due = line.where("nr % 3 <> 0").groupBy("cluster").agg(F.sum("amount").alias("amount")).select("cluster", F.concat(F.lit("c"), "cluster").alias("settlement_id"), (F.col("amount") + chosen((0, 60, 100, 5000), F.col("cluster"))).alias("amount"))
    return groups.credit_groups(due, line).withColumn("txn_ids", F.array_join("txn_ids", ","))


@query(""", b AS (SELECT seq // 800 AS k, settlement_id, settled_amount FROM r WHERE match_method = 'NO_BANK_MATCH'),
n AS (SELECT seq // 800 AS k, count(*) * 2 AS n FROM r GROUP BY 1),
g AS (SELECT k, list(settlement_id) AS ids, CAST(sum(settled_amount) AS BIGINT) AS settled, CAST(sum(settled_amount) + (k % 4) * 40 AS BIGINT) AS credited FROM b GROUP BY 1),
f AS (SELECT * FROM g JOIN n USING (k) WHERE n.n >= 1000 AND credited - settled <= 100 AND len(ids) >= 2),
x AS (SELECT unnest(ids) AS settlement_id, 'bulk' || k AS txn_id, credited, CASE WHEN settled = credited THEN 96 ELSE 90 END AS confidence FROM f)
SELECT payment_id, status, coalesce(x.txn_id, bank_txn_id) AS bank_txn_id, coalesce(x.credited, bank_amount) AS bank_amount, greatest(score, coalesce(x.confidence, 0)) AS score, CASE WHEN x.txn_id IS NOT NULL THEN 'N:1' END AS cardinality
FROM r LEFT JOIN x ON r.settlement_id = x.settlement_id""")
def results_with_groups(spark, sf_dir):
    """Settlements without a credit in batches of 800 payments, each with a bulk credit near their sum: the relationships found, and the results with them."""
    r, _ = results(spark, sf_dir)
    k = F.floor(F.col("seq") / 800)
    open_ = r.where("match_method = 'NO_BANK_MATCH'").select(
        k.cast("string").alias("batch"), "seq", F.get("settlement_ids", F.lit(0)).alias("settlement_id"), "payment_id", F.col("settled_amount").alias("amount"), F.lit(0).cast("long").alias("settled_s"), F.lit(None).cast("string").alias("utr")
    )
    off = F.col("batch").cast("long") % 4 * 40
    bulk = open_.groupBy("batch").agg(F.sum("amount").alias("amount")).select(
        "batch", F.lit(0).cast("long").alias("seq"), F.concat(F.lit("bulk"), "batch").alias("txn_id"), (F.col("amount") + off).alias("amount"), F.lit(0).cast("long").alias("txn_s"), F.lit(None).cast("string").alias("utr"), F.lit(True).alias("bulk")
    )
    sizes = r.groupBy(k.cast("string").alias("batch")).agg((F.count("*") * 2).alias("n"))
    own = r.select("payment_id", "status", F.when(F.col("bank_txn_id").isNotNull(), F.array("bank_txn_id")).otherwise(F.array()).alias("txn_ids"), "bank_amount", "score", "match_method")
    done = cardinality.applied(own, *cardinality.relationships(open_, bulk, sizes), open_)
    return done.select("payment_id", "status", F.get("txn_ids", F.lit(0)).alias("bank_txn_id"), "bank_amount", "score", "cardinality")
