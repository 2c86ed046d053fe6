"""Reconciliation tables derived from `orders` by integer arithmetic on its keys.

Each order is a payment; its class (key modulo 20) says what goes wrong with it. Money is in minor
units (bigint), times are epoch seconds. Payments of class 17 have no reference and are found by amount
and time; four of them share a time, and by their slot all four credits are there and near each other,
or one is missing so that who comes first decides, or they lie apart and one has no time of settlement.
FIXTURE_SQL is the same derivation for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3600
DAY = 24 * HOUR
#: 1800-01-01: payments whose credits are found by amount and date lie before all others, 4 days apart.
ISOLATED = -5364662400
#: 2030-01-01: later than all orders; payments from then on may still be settled.
RECENT = 1893456000


def minor(c: Column) -> Column:
    """Money as minor units, halves up."""
    return F.floor(c * 100 + 0.5).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, cls, group = F.col("o_orderkey"), F.col("class"), F.floor(F.col("o_orderkey") / 20)
    slot, nth = F.floor(group / 4), group % 4
    ordered = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate)")
    at = (
        F.when(cls == 10, ISOLATED + 8 * DAY * group)
        .when(cls == 17, ISOLATED + (8 * slot + 4) * DAY)
        .when((cls == 9) & (group % 5 == 0), RECENT + (group % 7) * DAY)
        .when((cls == 9) & (group % 5 == 1), F.lit(None))
        .otherwise(ordered)
    )
    like = 1_000_000 + (slot % 40) * 100_000
    alike = like + F.when(slot % 3 == 2, F.floor(nth * like / 2)).otherwise(F.floor(nth * like * 6 / 1000))
    base = table(spark, sf_dir, "orders").withColumn("class", k % 20).select(
        k.alias("seq"),
        F.concat(F.lit("pay_"), k).alias("payment_id"),
        F.concat(F.lit("ord_"), k).alias("order_id"),
        F.when(cls == 17, alike).otherwise(minor(F.col("o_totalprice"))).cast("long").alias("amount"),
        F.element_at(F.array(*map(F.lit, ("upi", "card", "netbanking", "wallet"))), (k % 4 + 1).cast("int")).alias("method"),
        F.when((cls == 8) & (group % 50 == 0), "failed").otherwise("captured").alias("status"),
        at.cast("long").alias("captured_s"),
        cls.cast("int").alias("class"),
    )
    fee = F.floor((F.col("amount") * F.when(F.col("method") == "card", 290).otherwise(200) + 5000) / 10000).cast("long")
    return base.withColumn("fee", fee).withColumn("tax", F.floor((F.col("fee") * 18 + 50) / 100).cast("long"))


def orders(pay: DataFrame) -> DataFrame:
    """An order for every payment but those of class 19; of class 1 a second one, which counts."""
    parts = F.when(F.col("class") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return pay.where("class <> 19").withColumn("part", F.explode(parts)).select(
        (F.col("seq") * 2 + F.col("part")).alias("seq"), "order_id", (F.col("amount") + F.col("part") * 3).alias("amount"), F.lit("paid").alias("status")
    )


def refunds(pay: DataFrame) -> DataFrame:
    """Those of class 3 have failed and don't count."""
    return pay.where("class IN (3, 12)").select(
        "seq", F.concat(F.lit("rf_"), "seq").alias("refund_id"), "payment_id", F.floor(F.col("amount") / 10).cast("long").alias("amount"), F.when(F.col("class") == 3, "failed").otherwise("processed").alias("status")
    )


def chargebacks(pay: DataFrame) -> DataFrame:
    """Those of class 4 are won and don't count."""
    return pay.where("class IN (4, 13)").select("seq", F.concat(F.lit("cb_"), "seq").alias("chargeback_id"), "payment_id", "amount", F.when(F.col("class") == 4, "won").otherwise("open").alias("status"))


def settlements(pay: DataFrame) -> DataFrame:
    parts = F.when(F.col("class") == 14, F.array(F.lit(""), F.lit("B"))).otherwise(F.array(F.lit("")))
    shift = F.when(F.col("class") == 11, -50000).when(F.col("class") == 18, 47).otherwise(0)
    group = F.floor(F.col("seq") / 20)
    due = F.col("captured_s") + 48 * HOUR
    return (
        pay.where("class <> 9")
        .withColumn("part", F.explode(parts))
        .select(
            (F.col("seq") * 2 + (F.col("part") == "B").cast("long")).alias("seq"),
            F.concat(F.lit("setl_"), "seq", F.lower("part")).alias("settlement_id"),
            "payment_id",
            (F.col("amount") - F.col("fee") - F.col("tax") + shift).alias("amount"),
            F.when(F.col("class") != 17, F.concat(F.lit("UTR"), "seq", "part")).alias("utr"),
            F.when((F.col("class") != 17) | (group % 12 != 11), due).alias("settled_s"),
            "class",
            due.alias("due_s"),
        )
    )


def bank(pay: DataFrame, setl: DataFrame) -> DataFrame:
    """Credits of the settlements, orphans, debits of chargebacks, and of class 2 an earlier credit under the same reference."""
    k = F.floor(F.col("seq") / 2)
    narration = F.when(k % 3 == 0, F.concat(F.lit("NEFT "), "settlement_id", F.lit(" CR"))).when(k % 3 == 1, F.upper("settlement_id"))
    plain = setl.where((F.col("class") != 10) & ((F.col("class") != 17) | ~(F.floor(k / 20) % 12).isin(5))).select(
        (F.col("seq") * 4).alias("seq"),
        F.concat(F.lit("txn_"), "seq").alias("txn_id"),
        F.coalesce("utr", F.concat(F.lit("BK"), k)).alias("utr"),
        "amount",
        F.lit("CREDIT").alias("type"),
        (F.col("due_s") + F.when(F.col("class") == 15, 40 * HOUR).otherwise(6 * HOUR)).alias("txn_s"),
        narration.alias("narration"),
    )
    none = F.lit(None).cast("string").alias("narration")
    first = setl.where("class = 2").select(
        (F.col("seq") * 4 - 1).alias("seq"), F.concat(F.lit("xtxn_"), "seq").alias("txn_id"), "utr", (F.col("amount") + 5000).alias("amount"), F.lit("CREDIT").alias("type"), (F.col("due_s") + HOUR).alias("txn_s"), none,
    )
    orphan = pay.where("class = 16").select(
        (F.col("seq") * 8 + 1).alias("seq"), F.concat(F.lit("otxn_"), "seq").alias("txn_id"), F.concat(F.lit("ORPH"), "seq").alias("utr"),
        (F.col("amount") + 777).alias("amount"), F.lit("CREDIT").alias("type"), (F.col("captured_s") + 6 * HOUR).alias("txn_s"), none,
    )
    debit = pay.where("class = 13").select(
        (F.col("seq") * 8 + 2).alias("seq"), F.concat(F.lit("dtxn_"), "seq").alias("txn_id"), F.concat(F.lit("DEB"), "seq").alias("utr"),
        "amount", F.lit("DEBIT").alias("type"), (F.col("captured_s") + 6 * HOUR).alias("txn_s"), none,
    )
    return plain.unionByName(first).unionByName(orphan).unionByName(debit)


def batch(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    pay = payments(spark, sf_dir)
    setl = settlements(pay)
    return {"orders": orders(pay), "payments": pay, "refunds": refunds(pay), "chargebacks": chargebacks(pay), "settlements": setl, "bank": bank(pay, setl)}


FIXTURE_SQL = """
WITH RECURSIVE pay00 AS (
  SELECT o_orderkey AS seq, o_orderkey % 20 AS class, o_orderkey // 20 AS grp, o_orderkey // 80 AS slot, (o_orderkey // 20) % 4 AS nth,
         1000000 + ((o_orderkey // 80) % 40) * 100000 AS alike, o_totalprice, o_orderdate FROM orders),
pay0 AS (
  SELECT seq, 'pay_' || seq AS payment_id, 'ord_' || seq AS order_id,
         CAST(CASE WHEN class = 17 THEN alike + CASE WHEN slot % 3 = 2 THEN nth * alike // 2 ELSE nth * alike * 6 // 1000 END
              ELSE floor(o_totalprice * 100 + 0.5) END AS BIGINT) AS amount,
         CASE seq % 4 WHEN 0 THEN 'upi' WHEN 1 THEN 'card' WHEN 2 THEN 'netbanking' ELSE 'wallet' END AS method,
         CASE WHEN class = 8 AND grp % 50 = 0 THEN 'failed' ELSE 'captured' END AS status,
         CAST(CASE WHEN class = 10 THEN -5364662400 + 8 * 86400 * grp WHEN class = 17 THEN -5364662400 + (8 * slot + 4) * 86400
              WHEN class = 9 AND grp % 5 = 0 THEN 1893456000 + (grp % 7) * 86400 WHEN class = 9 AND grp % 5 = 1 THEN NULL
              ELSE floor(epoch(o_orderdate)) END AS BIGINT) AS captured_s,
         CAST(class AS INTEGER) AS class
  FROM pay00),
pay1 AS (SELECT *, (amount * CASE WHEN method = 'card' THEN 290 ELSE 200 END + 5000) // 10000 AS fee FROM pay0),
pay AS (SELECT *, (fee * 18 + 50) // 100 AS tax FROM pay1),
ords AS (SELECT seq * 2 + part AS seq, order_id, amount + part * 3 AS amount FROM pay, (VALUES (0), (1)) p(part) WHERE class <> 19 AND (part = 0 OR class = 1)),
refunds AS (SELECT payment_id, 'rf_' || seq AS refund_id, amount // 10 AS amount, CASE class WHEN 3 THEN 'failed' ELSE 'processed' END AS status FROM pay WHERE class IN (3, 12)),
chargebacks AS (SELECT payment_id, 'cb_' || seq AS chargeback_id, amount, CASE class WHEN 4 THEN 'won' ELSE 'open' END AS status FROM pay WHERE class IN (4, 13)),
setl AS (
  SELECT seq * 2 + CASE WHEN part = 'B' THEN 1 ELSE 0 END AS seq, 'setl_' || seq || lower(part) AS settlement_id, payment_id,
         amount - fee - tax + CASE class WHEN 11 THEN -50000 WHEN 18 THEN 47 ELSE 0 END AS amount,
         CASE WHEN class <> 17 THEN 'UTR' || seq || part END AS utr,
         CASE WHEN class <> 17 OR (seq // 20) % 12 <> 11 THEN captured_s + 172800 END AS settled_s, class, captured_s + 172800 AS due_s
  FROM pay, (VALUES (''), ('B')) p(part) WHERE class <> 9 AND (part = '' OR class = 14)),
bank AS (
  SELECT seq * 4 AS seq, 'txn_' || seq AS txn_id, coalesce(utr, 'BK' || (seq // 2)) AS utr, amount, 'CREDIT' AS type,
         due_s + CASE WHEN class = 15 THEN 144000 ELSE 21600 END AS txn_s,
         CASE (seq // 2) % 3 WHEN 0 THEN 'NEFT ' || settlement_id || ' CR' WHEN 1 THEN upper(settlement_id) END AS narration
  FROM setl WHERE class <> 10 AND (class <> 17 OR (seq // 40) % 12 <> 5)
  UNION ALL SELECT seq * 4 - 1, 'xtxn_' || seq, utr, amount + 5000, 'CREDIT', due_s + 3600, NULL FROM setl WHERE class = 2
  UNION ALL SELECT seq * 8 + 1, 'otxn_' || seq, 'ORPH' || seq, amount + 777, 'CREDIT', captured_s + 21600, NULL FROM pay WHERE class = 16
  UNION ALL SELECT seq * 8 + 2, 'dtxn_' || seq, 'DEB' || seq, amount, 'DEBIT', captured_s + 21600, NULL FROM pay WHERE class = 13)
"""
