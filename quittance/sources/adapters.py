"""Files of gateways and banks, and mixed feeds, as typed rows.

Lines come as (line_no, line); the header names the columns, whose places are found by keywords. Fields
are split by the CSV functions of Spark. Rows are never dropped silently: the gates give each rejected
row with its reason.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Keywords of the columns of each provider, in the order in which they are looked for.
GATEWAY = {
    "payment_id": (("paymentid", "payid"), ("id",), ()),
    "order_id": (("orderid",), (), ()),
    "settlement_id": (("settlementid", "setlid"), (), ()),
    "amount": (("amount",), (), ("fee", "tax")),
    "fee": (("fee",), (), ()),
    "tax": (("tax",), (), ()),
    "utr": (("utr", "rrn"), (), ()),
    "date": (("createdat", "settledat", "date"), (), ()),
    "status": (("status", "state"), (), ()),
    "method": (("method", "channel"), (), ()),
}
BANK = {
    "date": (("date",), (), ()),
    "txn_id": (("ref", "chq", "txnid"), ("id",), ()),
    "credit": (("credit", "deposit"), ("cr",), ("description", "particulars")),
    "amount": (("amount",), (), ()),
    "narration": (("narration", "description", "particulars"), (), ()),
    "utr": (("utr", "rrn", "urn"), (), ()),
}
GENERIC = {"id": (("id", "ref"), (), ()), "amount": (("amount", "total"), (), ()), "fee": (("fee",), (), ()), "utr": (("utr", "rrn"), (), ()), "date": (("date", "time"), (), ())}
#: Fixed value: references in the narration of a bank statement.
UTR_PATTERN = r"(?i)\b(UTR[0-9A-Z_]+|[0-9]{12}|[A-Z]{4}[0-9]{8,12}|CMS[0-9]+)\b"
BULK_PHRASES = ("BULK SETTLEMENT", "AGGREGATED SETTLEMENT", "PAYOUT BATCH")
SOURCES = ("PAYMENT", "ORDER", "SETTLEMENT", "BANK", "BANK_TXN", "REFUND", "CHARGEBACK")
#: Highest amount of a row of a feed, in major units, and longest identifier.
MAX_AMOUNT, MAX_ID = 100_000_000, 128


def slug(header: str) -> str:
    return re.sub(r"[^a-z0-9]", "", header.lower())


def places(header: list[str], rules: dict) -> dict[str, int | None]:
    """Which column each field is: the first whose name holds a keyword or is one of the whole names, and holds no other."""
    names = [slug(h) for h in header]
    fits = lambda h, rule: (any(k in h for k in rule[0]) or h in rule[1]) and not any(k in h for k in rule[2])
    return {field: next((i for i, h in enumerate(names) if fits(h, rule)), None) for field, rule in rules.items()}


def schema_errors(provider: str, header: list[str]) -> tuple[list[str], list[str]]:
    """(errors, warnings): fields that a provider's file lacks."""
    names = [slug(h) for h in header]
    has = lambda *keys: any(k in h for h in names for k in keys)
    if provider == "GATEWAY":
        return ([] if has("paymentid", "payid", "settlement", "utr", "settledat") or "id" in names else ["payment_id"]) + ([] if has("amount") else ["amount"]), []
    if provider == "BANK_STATEMENT":
        return ([] if has("date") else ["date"]) + ([] if has("amount", "credit", "cr", "deposit") else ["amount"]), ([] if has("narration", "description", "particulars", "remarks") else ["narration"])
    return ([] if has("amount", "total", "sum") else ["amount"]), []


def provider_of(header: Column) -> Column:
    """The provider that a header line's keywords tell."""
    names = F.transform(F.split(header, ","), lambda h: F.regexp_replace(F.lower(h), "[^a-z0-9]", ""))
    text = F.array_join(names, " ")
    has = lambda *keys: F.greatest(*(F.contains(text, F.lit(k)) for k in keys)) if len(keys) > 1 else F.contains(text, F.lit(keys[0]))
    gateway = has("razorpay") | (has("paymentid") & has("settlementid"))
    bank = has("narration", "valuedate") | (has("credit") & has("balance"))
    return F.when(gateway, "GATEWAY").when(bank, "BANK_STATEMENT").otherwise("GENERIC_CSV")


def clean_lines(text: DataFrame) -> DataFrame:
    """(line_no, line) of text (line_no, line): escaped line ends part lines too; blank ones and comments go."""
    parts = F.posexplode(F.split(F.regexp_replace("line", r"\\r\\n|\\n|\r\n|\r", "\n"), "\n")).alias("part", "line")
    out = text.select("line_no", parts).where((F.trim("line") != "") & ~F.trim("line").startswith("#"))
    return out.select("line_no", "part", "line")


def fields(lines: DataFrame, header: list[str], rules: dict) -> DataFrame:
    """lines with a column for each field of rules, trimmed, empty where the file lacks it."""
    at = places(header, rules)
    schema = ", ".join(f"c{i} string" for i in range(len(header)))
    row = lines.withColumn("c", F.from_csv("line", F.lit(schema), {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}))
    text = lambda i: F.lit("") if i is None else F.trim(F.coalesce(F.col(f"c.c{i}"), F.lit("")))
    return row.select(*lines.columns, *(text(i).alias(f) for f, i in at.items()))


def minor_units(text: Column) -> Column:
    """An amount as minor units: with a point it is in major units, without in minor ones; what is no number is 0."""
    found = F.regexp_extract(F.regexp_replace(text, "[^0-9.-]", ""), r"^-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)", 0)
    value = F.coalesce(F.nullif(found, F.lit("")).try_cast("double"), F.lit(0.0))
    return F.floor(F.when(F.contains(text, F.lit(".")), value * 100).otherwise(value) + 0.5).cast("long")


def flexible_time(text: Column, now: Column) -> Column:
    """A time in one of the usual formats: ISO, month first, day first, years of two digits; else now."""
    parts = F.split(text, "[-/ :]")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("int")
    year = F.when(number(2) > 100, number(2)).otherwise(2000 + number(2))
    dmy = F.try_make_timestamp_ntz(year, number(1), number(0), F.lit(0), F.lit(0), F.lit(0))
    mdy = F.try_make_timestamp_ntz(year, number(0), number(1), F.lit(0), F.lit(0), F.lit(0))
    iso = F.when(text.rlike("^[0-9]{4}-"), F.regexp_replace(text, "(Z|[+-]00:?00)$", "").try_cast("timestamp_ntz"))
    return F.coalesce(iso, F.when(~text.rlike("^[0-9]{4}-"), F.coalesce(mdy, dmy)), now)


def gateway_rows(lines: DataFrame, header: list[str], now: Column) -> DataFrame:
    """One row a line with what its order, payment and settlement need; ids that lack are made from the line's number."""
    f = fields(lines, header, GATEWAY)
    pay = F.coalesce(F.nullif("payment_id", F.lit("")), F.concat(F.lit("pay_gw_"), "line_no"))
    got = f.select(
        "line_no", pay.alias("payment_id"), F.coalesce(F.nullif("order_id", F.lit("")), F.concat(F.lit("order_"), pay)).alias("order_id"),
        F.coalesce(F.nullif("settlement_id", F.lit("")), F.concat(F.lit("setl_"), pay)).alias("settlement_id"),
        minor_units(F.col("amount")).alias("amount"), minor_units(F.col("fee")).alias("fee"), minor_units(F.col("tax")).alias("tax"), F.nullif("utr", F.lit("")).alias("utr"),
        F.coalesce(F.nullif(F.lower("status"), F.lit("")), F.lit("captured")).alias("status"), F.coalesce(F.nullif(F.upper("method"), F.lit("")), F.lit("UPI")).alias("method"),
        flexible_time(F.col("date"), now).alias("at_time"),
    )
    return got.withColumn("net", F.expr("amount - fee - tax"))


def generic_rows(lines: DataFrame, header: list[str], now: Column) -> DataFrame:
    """Like gateway_rows, of a file of which only ids and amounts are known; its payments count as settled."""
    f = fields(lines, header, GENERIC)
    i = F.coalesce(F.nullif("id", F.lit("")), F.concat(F.lit("gen_"), "line_no"))
    return f.select(
        "line_no", i.alias("payment_id"), F.concat(F.lit("order_"), i).alias("order_id"), F.concat(F.lit("setl_"), i).alias("settlement_id"),
        minor_units(F.col("amount")).alias("amount"), minor_units(F.col("fee")).alias("fee"), F.lit(0).cast("long").alias("tax"), F.nullif("utr", F.lit("")).alias("utr"),
        F.lit("settled").alias("status"), F.lit("GENERIC").alias("method"), flexible_time(F.col("date"), now).alias("at_time"),
    ).withColumn("net", F.col("amount") - F.col("fee"))


def bank_rows(lines: DataFrame, header: list[str], now: Column) -> DataFrame:
    """Credits of a bank statement; a reference that lacks is looked for in the narration."""
    f = fields(lines, header, BANK)
    amount = minor_units(F.col("credit" if places(header, BANK)["credit"] is not None else "amount"))
    told = F.nullif(F.regexp_extract("narration", UTR_PATTERN, 1), F.lit(""))
    return f.select(
        "line_no", F.coalesce(F.nullif("txn_id", F.lit("")), F.concat(F.lit("bank_txn_"), "line_no")).alias("txn_id"), amount.alias("amount"),
        F.coalesce(F.nullif("utr", F.lit("")), told).alias("utr"), F.lit("CREDIT").alias("type"), F.coalesce(F.nullif("narration", F.lit("")), F.lit("BANK CREDIT")).alias("narration"), flexible_time(F.col("date"), now).alias("at_time"),
    ).where("amount > 0")


ADAPTERS: dict[str, Callable[[DataFrame, list[str], Column], DataFrame]] = {"GATEWAY": gateway_rows, "BANK_STATEMENT": bank_rows, "GENERIC_CSV": generic_rows}


def register(provider: str, adapter: Callable[[DataFrame, list[str], Column], DataFrame]) -> None:
    ADAPTERS[provider] = adapter


def ingest(spark: SparkSession, path: str, now: Column, provider: str | None = None, strict: bool = False) -> tuple[str, DataFrame]:
    """The provider of the CSV file at path, told by its header unless given, and its rows; strict: an error if columns lack."""
    text = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))
    lines = clean_lines(text)
    first = lines.orderBy("line_no", "part").first()
    if first is None:
        raise ValueError(f"{path} is empty")
    header = [h.strip().strip('"') for h in first.line.split(",")]
    if provider is None:
        provider = spark.createDataFrame([(first.line,)], "h string").select(provider_of(F.col("h"))).first()[0]
    errors, _ = schema_errors(provider, header)
    if strict and errors:
        raise ValueError(f"{path} lacks {', '.join(errors)}")
    body = lines.where((F.col("line_no") != first.line_no) | (F.col("part") != first.part))
    return provider, ADAPTERS.get(provider, generic_rows)(body, header, now)


def bulk_credit(kind: Column, narration: Column) -> Column:
    return (kind == "CREDIT") & F.upper(F.coalesce(narration, F.lit(""))).rlike("|".join(BULK_PHRASES))


def gate(rows: DataFrame, id_column: str, positive: bool) -> DataFrame:
    """rows (seq, id, amount as text) with reason: null if the row may pass. Of equal ids, whatever their case, the first passes."""
    name = F.lower(F.trim(id_column))
    known = F.coalesce(F.trim(id_column) != "", F.lit(False))
    nth = F.row_number().over(Window.partitionBy(F.when(known, name)).orderBy("seq"))
    amount = F.col("amount").try_cast("double")
    bad = amount.isNull() | F.isnan(amount) | (F.abs(amount) == float("inf")) | ((amount <= 0) if positive else (amount < 0))
    if positive:
        bad = bad | (F.abs(amount) > 2**53 - 1)
    # rows without an id are no group: they are told before their number matters
    return rows.withColumn("nth", nth).withColumn("reason", F.when(~known, "MISSING_ID").when(F.col("nth") > 1, "DUPLICATE_SOURCE_ID").when(bad, "INVALID_AMOUNT")).drop("nth")


def feed_errors(row: DataFrame) -> DataFrame:
    """rows of a mixed feed (all text) with the array errors of the fields that are wrong."""
    money = lambda c: F.col(c).try_cast("double")
    wrong = lambda c: F.col(c).isNotNull() & F.coalesce(F.isnan(money(c)) | (money(c) < 0) | (money(c) > MAX_AMOUNT), F.lit(True))
    source, currency = F.upper(F.trim("source")), F.upper(F.trim("currency"))
    rules = [
        ("source", F.col("source").isNotNull() & ~source.isin(*SOURCES)),
        ("amount", F.col("amount").isNull() | wrong("amount")),
        ("currency", F.col("currency").isNotNull() & (currency != "INR")),
        ("date", F.col("date").isNotNull() & F.col("date").try_cast("timestamp_ntz").isNull()),
        ("reference_id", F.col("reference_id").isNotNull() & ((F.length(F.trim("reference_id")) == 0) | (F.length(F.trim("reference_id")) > MAX_ID))),
        ("fee", wrong("fee")),
        ("tax", wrong("tax")),
    ]
    return row.withColumn("errors", F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules))))


def fan_out(feed: DataFrame, now: Column) -> dict[str, DataFrame]:
    """The six tables of a valid feed (seq, source, amount, reference_id, utr, fee, tax, date): one filter and projection each."""
    kind = F.coalesce(F.upper(F.trim("source")), F.lit("PAYMENT"))
    money = lambda c: F.floor(F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) * 100 + 0.5).cast("long")
    ref = F.coalesce(F.nullif(F.trim("reference_id"), F.lit("")), F.concat(F.lit("TXN_"), F.col("seq") + 1))
    f = feed.select("seq", kind.alias("kind"), ref.alias("ref"), money("amount").alias("amount"), money("fee").alias("fee"), money("tax").alias("tax"), F.coalesce("utr", F.concat(F.lit("UTR_"), ref)).alias("utr"), F.coalesce(F.col("date").try_cast("timestamp_ntz"), now).alias("at_time"))
    named = lambda prefix: F.concat(F.lit(prefix), "ref")
    paid = f.where(F.col("kind").isin("PAYMENT", "ORDER"))
    return {
        "payments": paid.select("seq", F.col("ref").alias("payment_id"), F.col("ref").alias("order_id"), "amount", "fee", "tax", F.lit("card").alias("method"), F.lit("captured").alias("status"), F.col("at_time").alias("captured_at")),
        "orders": paid.select("seq", F.col("ref").alias("order_id"), "amount", F.lit("paid").alias("status")),
        "settlements": f.where("kind = 'SETTLEMENT'").select("seq", named("set_").alias("settlement_id"), F.col("ref").alias("payment_id"), "amount", "fee", "tax", "utr", F.col("at_time").alias("settled_at")),
        "bank": f.where(F.col("kind").isin("BANK", "BANK_TXN")).select("seq", named("bnk_").alias("txn_id"), "utr", "amount", F.lit("CREDIT").alias("type"), named("Settlement ").alias("narration"), F.col("at_time").alias("txn_at")),
        "refunds": f.where("kind = 'REFUND'").select("seq", named("ref_").alias("refund_id"), F.col("ref").alias("payment_id"), "amount", F.lit("processed").alias("status")),
        "chargebacks": f.where("kind = 'CHARGEBACK'").select("seq", named("cb_").alias("chargeback_id"), F.col("ref").alias("payment_id"), "amount", F.lit("opened").alias("status")),
    }


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """A feed of JSON rows, all fields as text."""
    return spark.read.schema("seq long, source string, amount string, currency string, date string, reference_id string, utr string, fee string, tax string").json(path)


def normalized(rows: DataFrame, ids: list[str], upper: tuple[str, ...] = ("utr", "type"), trimmed: tuple[str, ...] = ("narration",)) -> DataFrame:
    """Ids trimmed and in lower case, references and types in upper case, texts trimmed; an empty reference is null."""
    out = {c: F.lower(F.trim(c)) for c in ids} | {c: F.nullif(F.upper(F.trim(c)), F.lit("")) for c in upper if c in rows.columns} | {c: F.trim(c) for c in trimmed if c in rows.columns}
    return rows.withColumns(out)
