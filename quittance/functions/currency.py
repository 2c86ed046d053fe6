"""Exact conversion of minor units between currencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paise per minor unit as a ratio (numerator, denominator).
RATES = {
    "INR": (1, 1),
    "USD": (8325, 100),
    "EUR": (9010, 100),
    "GBP": (10550, 100),
    "SGD": (6180, 100),
    "AED": (2265, 100),
    "JPY": (55, 1),
    "CAD": (6120, 100),
    "AUD": (5450, 100),
}


def rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, n, d) for c, (n, d) in RATES.items()], "currency string, num long, den long")


def to_inr(df: DataFrame, amount: str, currency: str = "currency") -> DataFrame:
    """df with inr_minor; the table of nine rates is sent to all. An unknown currency is an error."""
    r = rates(df.sparkSession).withColumnRenamed("currency", "fx_currency")
    joined = df.join(F.broadcast(r), F.col(currency) == F.col("fx_currency"), "left")
    wide: Column = F.greatest(F.col(amount), F.lit(0)).cast("decimal(38,0)")
    value = F.floor(wide * F.col("num") / F.col("den")).cast("long")
    known = F.when(F.col("fx_currency").isNull(), F.raise_error(F.concat(F.lit("unknown currency "), F.coalesce(F.col(currency), F.lit("null"))))).otherwise(value)
    return joined.withColumn("inr_minor", known).drop("num", "den", "fx_currency")


def from_inr(df: DataFrame, amount: str, currency: str = "currency") -> DataFrame:
    """df with foreign_minor, rounded down. An unknown currency is an error."""
    r = rates(df.sparkSession).withColumnRenamed("currency", "fx_currency")
    joined = df.join(F.broadcast(r), F.col(currency) == F.col("fx_currency"), "left")
    value = F.expr(f"greatest(`{amount}`, 0L) * den div num")
    known = F.when(F.col("fx_currency").isNull(), F.raise_error(F.concat(F.lit("unknown currency "), F.coalesce(F.col(currency), F.lit("null"))))).otherwise(value)
    return joined.withColumn("foreign_minor", known).drop("num", "den", "fx_currency")
