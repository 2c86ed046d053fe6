"""Queries over files and feeds whose text is derived from `orders`."""

from __future__ import annotations

from pyspark.sql import functions as F

from quittance.plans.base import query
from quittance.sources import adapters
from quittance.sources.fixtures import table

NOW = "2030-06-01 00:00:00"
GATEWAY_HEADER = ["Payment ID", "Order ID", "Settlement ID", "Amount", "Fee", "Tax", "UTR", "Created At", "Status", "Payment Method"]
BANK_HEADER = ["Txn Date", "Narration", "Ref No", "Credit", "Balance"]
GENERIC_HEADER = ["Txn Id", "Total", "Fee", "RRN", "Time"]


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def base(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long").alias("p"), F.col("o_orderdate").alias("d"))


BASE_SQL = "WITH b AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS p, o_orderdate AS d FROM orders)"


def written_amount():
    """With thousands separators and a point, quoted; or as plain minor units; or not a number."""
    major = F.concat(F.lit('"'), F.format_number(F.floor(F.col("p") / 100), 0), F.lit("."), F.lpad((F.col("p") % 100).cast("string"), 2, "0"), F.lit('"'))
    return F.when(F.col("k") % 7 == 0, "n/a").when(F.col("k") % 2 == 0, major).otherwise(F.col("p").cast("string"))


AMOUNT_SQL = "CASE WHEN k % 7 = 0 THEN 0 ELSE p END"


def written_date():
    """ISO, month first, day first (told by days beyond 12), a year of two digits, or nothing."""
    day = F.dayofmonth("d") > 12
    kind = F.col("k") % 5
    return (
        F.when(kind == 0, F.date_format("d", "yyyy-MM-dd'T'00:00:00'Z'"))
        .when(kind == 1, F.date_format("d", "MM/dd/yyyy"))
        .when((kind == 2) & day, F.date_format("d", "dd-MM-yyyy"))
        .when((kind == 3) & day & (F.year("d") >= 2000), F.date_format("d", "dd/MM/yy"))
        .when(kind == 4, "soon")
        .otherwise(F.date_format("d", "yyyy-MM-dd"))
    )


DATE_SQL = f"CASE WHEN k % 5 = 4 THEN TIMESTAMP '{NOW}' ELSE date_trunc('day', d)::TIMESTAMP END"


def gateway_lines(spark, sf_dir, ids=False):
    """Some lines lack ids (all have a payment's if ids) or a status, some hold two records with an escaped line end, and there are comments."""
    b = base(spark, sf_dir)
    status = F.when(F.col("k") % 6 == 0, "").otherwise(" Captured ")
    line = F.concat_ws(
        ",", F.when((F.col("k") % 9 == 0) & F.lit(not ids), "").otherwise(F.concat(F.lit(" pay_"), "k")), F.when(F.col("k") % 4 == 0, "").otherwise(F.concat(F.lit("ord_"), "k")), F.lit(""),
        written_amount(), F.lit("10.50"), F.lit("189"), F.when(F.col("k") % 3 == 0, "").otherwise(F.concat(F.lit("UTR"), "k")), written_date(), status, F.lit('"Net ""X"" bank"'),
    )
    text = F.when(F.col("k") % 10 == 3, F.concat(line, F.lit("\\n# a comment"))).when(F.col("k") % 10 == 5, F.concat(F.lit("   \\r\\n"), line)).otherwise(line)
    return b.select(F.col("k").alias("line_no"), text.alias("line"))


GATEWAY_SQL = BASE_SQL + f""",
g AS (SELECT k, CASE WHEN k % 9 = 0 THEN 'pay_gw_' || k ELSE 'pay_' || k END AS payment_id, {AMOUNT_SQL} AS amount, {DATE_SQL} AS at_time FROM b)
SELECT k AS line_no, payment_id, CASE WHEN k % 4 = 0 THEN 'order_' || payment_id ELSE 'ord_' || k END AS order_id, 'setl_' || payment_id AS settlement_id, amount, 1050::BIGINT AS fee, 189::BIGINT AS tax,
  CASE WHEN k % 3 <> 0 THEN 'UTR' || k END AS utr, 'captured' AS status, 'NET "X" BANK' AS method, at_time, amount - 1050 - 189 AS net FROM g"""


@query(GATEWAY_SQL, results=False)
def gateway_adapter(spark, sf_dir):
    return adapters.gateway_rows(adapters.clean_lines(gateway_lines(spark, sf_dir)), GATEWAY_HEADER, now())


@query(f"""SELECT 'order' AS kind, order_id AS id, payment_id, amount, 0::BIGINT AS fee, 'paid' AS status FROM ({GATEWAY_SQL})
UNION ALL SELECT 'payment', payment_id, payment_id, amount, fee, status FROM ({GATEWAY_SQL}) UNION ALL SELECT 'settlement', settlement_id, payment_id, net, fee, 'settled' FROM ({GATEWAY_SQL})""", results=False)
def gateway_tables(spark, sf_dir):
    """The three rows of each line, from one scan."""
    g = adapters.gateway_rows(adapters.clean_lines(gateway_lines(spark, sf_dir)), GATEWAY_HEADER, now())
    row = lambda kind, i, amount, fee, status: F.struct(F.lit(kind).alias("kind"), F.col(i).alias("id"), F.col("payment_id"), F.col(amount).alias("amount"), fee.alias("fee"), status.alias("status"))
    rows = F.explode(F.array(row("order", "order_id", "amount", F.lit(0).cast("long"), F.lit("paid")), row("payment", "payment_id", "amount", F.col("fee"), F.col("status")), row("settlement", "settlement_id", "net", F.col("fee"), F.lit("settled"))))
    return g.select(rows.alias("x")).select("x.*")


NARRATION_SQL = "CASE k % 6 WHEN 0 THEN 'NEFT utr' || k || '_A CR' WHEN 1 THEN 'IMPS 123456789012 x' WHEN 2 THEN 'by HDFC' || (10000000 + k) WHEN 3 THEN 'cms' || k || ' PAYOUT BATCH' WHEN 4 THEN '' ELSE 'cash' END"
BANK_LINES_SQL = BASE_SQL + f", n AS (SELECT *, CASE k % 8 WHEN 0 THEN -p WHEN 1 THEN 0 ELSE p END AS amount, {NARRATION_SQL} AS narr, {DATE_SQL} AS at_time FROM b)"


@query(BANK_LINES_SQL + r""" SELECT k AS line_no, CASE WHEN k % 11 = 0 THEN 'bank_txn_' || k ELSE 'R' || k END AS txn_id, amount,
  nullif(regexp_extract(narr, '(?i)\b(UTR[0-9A-Z_]+|[0-9]{12}|[A-Z]{4}[0-9]{8,12}|CMS[0-9]+)\b', 1), '') AS utr, 'CREDIT' AS type, coalesce(nullif(narr, ''), 'BANK CREDIT') AS narration, at_time FROM n WHERE amount > 0""", results=False)
def bank_statement_adapter(spark, sf_dir):
    return adapters.bank_rows(bank_lines(spark, sf_dir), BANK_HEADER, now())


def bank_lines(spark, sf_dir):
    k = F.col("k")
    narration = F.when(k % 6 == 0, F.concat(F.lit("NEFT utr"), k, F.lit("_A CR"))).when(k % 6 == 1, "IMPS 123456789012 x").when(k % 6 == 2, F.concat(F.lit("by HDFC"), k + 10000000)).when(k % 6 == 3, F.concat(F.lit("cms"), k, F.lit(" PAYOUT BATCH"))).when(k % 6 == 4, "").otherwise("cash")
    amount = F.when(k % 8 == 0, F.concat(F.lit("-"), F.col("p"))).when(k % 8 == 1, "").otherwise(F.col("p").cast("string"))
    ref = F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("R"), k))
    return base(spark, sf_dir).select(k.alias("line_no"), F.concat_ws(",", written_date(), narration, ref, amount, F.lit("9")).alias("line"))


@query(BANK_LINES_SQL + " SELECT k AS line_no, amount FROM n WHERE amount > 0 AND k % 6 = 3", results=False)
def bulk_credits(spark, sf_dir):
    rows = adapters.bank_rows(bank_lines(spark, sf_dir), BANK_HEADER, now())
    return rows.where(adapters.bulk_credit(F.col("type"), F.col("narration"))).select("line_no", "amount")


@query(BASE_SQL + f""" SELECT k AS line_no, i AS payment_id, 'order_' || i AS order_id, 'setl_' || i AS settlement_id, {AMOUNT_SQL} AS amount, 200::BIGINT AS fee, 0::BIGINT AS tax, 'N' || k AS utr, 'settled' AS status, 'GENERIC' AS method,
  {DATE_SQL} AS at_time, {AMOUNT_SQL} - 200 AS net FROM (SELECT *, CASE WHEN k % 9 = 0 THEN 'gen_' || k ELSE 't' || k END AS i FROM b)""", results=False)
def generic_adapter(spark, sf_dir):
    ids = F.when(F.col("k") % 9 == 0, "").otherwise(F.concat(F.lit("t"), "k"))
    line = F.concat_ws(",", ids, written_amount(), F.lit("2.00"), F.concat(F.lit("N"), "k"), written_date())
    return adapters.generic_rows(base(spark, sf_dir).select(F.col("k").alias("line_no"), line.alias("line")), GENERIC_HEADER, now())


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'GATEWAY' WHEN 1 THEN 'BANK_STATEMENT' WHEN 2 THEN 'BANK_STATEMENT' ELSE 'GENERIC_CSV' END AS provider FROM orders", results=False)
def provider_detection(spark, sf_dir):
    headers = F.array(*map(F.lit, ("Payment-ID,Settlement ID,Amount", "Date,Narration,Amount", "Date,Credit,Balance", "Id,Total")))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(headers, (F.col("o_orderkey") % 4 + 1).cast("int")).alias("h"))
    return o.select("o_orderkey", adapters.provider_of(F.col("h")).alias("provider"))


GATE_SQL = """WITH x AS (SELECT o_orderkey AS seq, CASE o_orderkey % 10 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN ' PAY_' || (o_orderkey // 20) WHEN 3 THEN 'pay_' || (o_orderkey // 20) ELSE 'pay_x' || o_orderkey END AS id,
  CASE o_orderkey % 7 WHEN 0 THEN 'abc' WHEN 1 THEN '-5' WHEN 2 THEN '0' WHEN 3 THEN '1e300' ELSE '100' END AS amount FROM orders),
r AS (SELECT *, trim(coalesce(id, '')) = '' AS none, row_number() OVER (PARTITION BY lower(trim(id)), trim(coalesce(id, '')) = '' ORDER BY seq) AS nth FROM x)
SELECT seq, CASE WHEN none THEN 'MISSING_ID' WHEN nth > 1 THEN 'DUPLICATE_SOURCE_ID' WHEN amount IN ({bad}) THEN 'INVALID_AMOUNT' END AS reason FROM r"""


def gate_rows(spark, sf_dir):
    k = F.col("o_orderkey")
    ids = F.when(k % 10 == 0, None).when(k % 10 == 1, "  ").when(k % 10 == 2, F.concat(F.lit(" PAY_"), F.floor(k / 20))).when(k % 10 == 3, F.concat(F.lit("pay_"), F.floor(k / 20))).otherwise(F.concat(F.lit("pay_x"), k))
    amount = F.element_at(F.array(*map(F.lit, ("abc", "-5", "0", "1e300", "100", "100", "100"))), (k % 7 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(k.alias("seq"), ids.alias("id"), amount.alias("amount"))


@query(GATE_SQL.format(bad="'abc', '-5', '0', '1e300'"), results=False)
def payment_gate(spark, sf_dir):
    return adapters.gate(gate_rows(spark, sf_dir), "id", positive=True).select("seq", "reason")


@query(GATE_SQL.format(bad="'abc', '-5'"), results=False)
def settlement_gate(spark, sf_dir):
    return adapters.gate(gate_rows(spark, sf_dir), "id", positive=False).select("seq", "reason")


FEED_SQL = """WITH f AS (SELECT o_orderkey AS seq, CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'payment' WHEN 2 THEN 'ORDER' WHEN 3 THEN ' Settlement ' WHEN 4 THEN 'BANK' WHEN 5 THEN 'bank_txn' WHEN 6 THEN 'REFUND' WHEN 7 THEN 'CHARGEBACK' ELSE 'PAYMNT' END AS source,
  CASE o_orderkey % 11 WHEN 0 THEN 'abc' WHEN 1 THEN '-5' WHEN 2 THEN '100000001' WHEN 3 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) || '.25' END AS amount, CASE WHEN o_orderkey % 13 = 0 THEN 'USD' WHEN o_orderkey % 13 = 1 THEN ' inr' END AS currency,
  CASE WHEN o_orderkey % 17 = 0 THEN 'soon' WHEN o_orderkey % 17 = 1 THEN '2024-02-03 04:05:06' END AS date, CASE WHEN o_orderkey % 19 = 0 THEN repeat('x', 129) WHEN o_orderkey % 19 > 1 THEN 'R' || o_orderkey END AS reference_id,
  CASE WHEN o_orderkey % 3 = 0 THEN 'U' || o_orderkey END AS utr, CASE WHEN o_orderkey % 23 = 0 THEN '-1' WHEN o_orderkey % 23 = 1 THEN '1.5' END AS fee, CASE WHEN o_orderkey % 29 = 0 THEN 'x' END AS tax FROM orders),
e AS (SELECT *, concat_ws(',', CASE WHEN source = 'PAYMNT' THEN 'source' END, CASE WHEN amount IS NULL OR amount IN ('abc', '-5', '100000001') THEN 'amount' END, CASE WHEN currency = 'USD' THEN 'currency' END,
  CASE WHEN date = 'soon' THEN 'date' END, CASE WHEN length(reference_id) > 128 THEN 'reference_id' END, CASE WHEN fee = '-1' THEN 'fee' END, CASE WHEN tax = 'x' THEN 'tax' END) AS errors FROM f)"""


def feed(spark, sf_dir):
    k = F.col("o_orderkey")
    pick = lambda n, *values: F.element_at(F.array(*(F.lit(v) for v in values)), (k % n + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        k.alias("seq"), pick(9, None, "payment", "ORDER", " Settlement ", "BANK", "bank_txn", "REFUND", "CHARGEBACK", "PAYMNT").alias("source"),
        F.when(k % 11 == 0, "abc").when(k % 11 == 1, "-5").when(k % 11 == 2, "100000001").when(k % 11 != 3, F.concat(k.cast("string"), F.lit(".25"))).alias("amount"),
        F.when(k % 13 == 0, "USD").when(k % 13 == 1, " inr").alias("currency"), F.when(k % 17 == 0, "soon").when(k % 17 == 1, "2024-02-03 04:05:06").alias("date"),
        F.when(k % 19 == 0, "x" * 129).when(k % 19 > 1, F.concat(F.lit("R"), k)).alias("reference_id"), F.when(k % 3 == 0, F.concat(F.lit("U"), k)).alias("utr"),
        F.when(k % 23 == 0, "-1").when(k % 23 == 1, "1.5").alias("fee"), F.when(k % 29 == 0, "x").alias("tax"),
    )


@query(FEED_SQL + " SELECT seq, errors FROM e", results=False)
def feed_validation(spark, sf_dir):
    return adapters.feed_errors(feed(spark, sf_dir)).select("seq", F.array_join("errors", ",").alias("errors"))


@query(FEED_SQL + f""", v AS (SELECT seq, coalesce(upper(trim(source)), 'PAYMENT') AS kind, coalesce(reference_id, 'TXN_' || (seq + 1)) AS ref, CAST(floor(CAST(amount AS DOUBLE) * 100 + 0.5) AS BIGINT) AS amount,
  CAST(floor(coalesce(CAST(fee AS DOUBLE), 0) * 100 + 0.5) AS BIGINT) AS fee, utr, coalesce(CAST(date AS TIMESTAMP), TIMESTAMP '{NOW}') AS at_time FROM e WHERE errors = '')
SELECT 'payments' AS tbl, seq, ref AS id, amount, fee, CAST(NULL AS VARCHAR) AS utr, at_time FROM v WHERE kind IN ('PAYMENT', 'ORDER') UNION ALL SELECT 'orders', seq, ref, amount, 0, NULL, NULL FROM v WHERE kind IN ('PAYMENT', 'ORDER')
UNION ALL SELECT 'settlements', seq, 'set_' || ref, amount, fee, coalesce(utr, 'UTR_' || ref), at_time FROM v WHERE kind = 'SETTLEMENT' UNION ALL SELECT 'bank', seq, 'bnk_' || ref, amount, 0, coalesce(utr, 'UTR_' || ref), at_time FROM v WHERE kind IN ('BANK', 'BANK_TXN')
UNION ALL SELECT 'refunds', seq, 'ref_' || ref, amount, 0, NULL, NULL FROM v WHERE kind = 'REFUND' UNION ALL SELECT 'chargebacks', seq, 'cb_' || ref, amount, 0, NULL, NULL FROM v WHERE kind = 'CHARGEBACK'""", results=False)
def feed_fan_out(spark, sf_dir):
    """Valid rows of the mixed feed in their six tables, shown as one."""
    valid = adapters.feed_errors(feed(spark, sf_dir)).where("size(errors) = 0")
    ids = {"payments": "payment_id", "orders": "order_id", "settlements": "settlement_id", "bank": "txn_id", "refunds": "refund_id", "chargebacks": "chargeback_id"}
    times = {"payments": "captured_at", "settlements": "settled_at", "bank": "txn_at"}
    out = None
    for name, t in adapters.fan_out(valid, now()).items():
        shown = t.select(
            F.lit(name).alias("tbl"), "seq", F.col(ids[name]).alias("id"), "amount", (F.col("fee") if "fee" in t.columns else F.lit(0)).cast("long").alias("fee"),
            (F.col("utr") if "utr" in t.columns else F.lit(None).cast("string")).alias("utr"), (F.col(times[name]) if name in times else F.lit(None).cast("timestamp_ntz")).alias("at_time"),
        )
        out = shown if out is None else out.unionByName(shown)
    return out


@query("""SELECT o_orderkey AS seq, 'pay_' || o_orderkey AS payment_id, CASE WHEN o_orderkey % 2 = 1 THEN 'UTR' || o_orderkey END AS utr, 'CREDIT' AS type, 'Mixed Case' AS narration FROM orders""", results=False)
def normalized_rows(spark, sf_dir):
    k = F.col("o_orderkey")
    raw = table(spark, sf_dir, "orders").select(k.alias("seq"), F.concat(F.lit("  PAY_"), k, F.lit(" ")).alias("payment_id"), F.when(k % 4 == 0, " ").when(k % 2 == 1, F.concat(F.lit(" utr"), k)).alias("utr"), F.lit("credit ").alias("type"), F.lit(" Mixed Case ").alias("narration"))
    return adapters.normalized(raw, ["payment_id"])


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events", results=False)
def event_properties(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))
