"""Batch metrics, confusion matrix, per-label scores and calibration of results against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = (
    "AUTO_MATCHED", "PENDING_SETTLEMENT", "MISSING_BANK_CREDIT", "AMOUNT_MISMATCH", "DUPLICATE_SETTLEMENT",
    "ORPHAN_BANK_CREDIT", "REFUND_MISMATCH", "CHARGEBACK_ADJUSTMENT", "DELAYED_BANK_CREDIT", "NEEDS_MANUAL_REVIEW",
)


def labelled(results: DataFrame, truths: DataFrame) -> DataFrame:
    """Results with their truth; an orphan's label counts as matched."""
    t = truths.select("payment_id", F.when(F.col("expected_label") == "ORPHAN_BANK_CREDIT", "AUTO_MATCHED").otherwise(F.col("expected_label")).alias("truth"))
    return results.where(~F.col("payment_id").startswith("orphan_")).join(t, "payment_id")


def confusion_matrix(pairs: DataFrame) -> DataFrame:
    """(truth, predicted, n) of all labels, with the empty cells. The frame of labels is a table of fixed size."""
    spark = pairs.sparkSession
    cells = spark.createDataFrame([(a, b) for a in LABELS for b in LABELS], "truth string, predicted string")
    n = pairs.groupBy("truth", F.col("status").alias("predicted")).agg(F.count("*").alias("n"))
    return cells.join(n, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def per_label(pairs: DataFrame) -> DataFrame:
    side = pairs.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col("truth") == F.col("status")).cast("int").alias("tp")),
                                          F.struct(F.col("status").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("tp")))).alias("x")).select("x.*")
    s = side.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("p").alias("p"), F.sum("t").alias("t"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    s = s.select("label", "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("t") - F.col("tp")).alias("fn"), share(F.col("tp"), F.col("p")).alias("precision"), share(F.col("tp"), F.col("t")).alias("recall"))
    return s.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def batch_metrics(results: DataFrame, orphans: DataFrame) -> DataFrame:
    o = orphans.agg(F.count("*").alias("n_orphans"), F.coalesce(F.sum("amount"), F.lit(0)).alias("orphan_credits"))
    risk = F.coalesce(F.nullif(F.abs(F.col("mismatch")), F.lit(0)), F.abs(F.col("expected_net")))
    return results.agg(
        F.count("*").alias("n_payments"),
        F.count_if(F.col("status") == "AUTO_MATCHED").alias("n_matched"),
        F.count_if(F.col("status") != "AUTO_MATCHED").alias("n_exceptions"),
        F.sum("payment_amount").alias("gross"),
        F.sum("expected_net").alias("expected"),
        F.sum("bank_amount").alias("credited"),
        F.sum("refund_amount").alias("refunded"),
        F.sum("chargeback_amount").alias("charged_back"),
        F.sum(F.when(F.col("status") != "AUTO_MATCHED", risk).otherwise(0)).alias("at_risk"),
    ).crossJoin(o)  # one row each


def bucket(score: Column) -> Column:
    return F.when(score <= 20, "0-20").when(score <= 40, "21-40").when(score <= 60, "41-60").when(score <= 80, "61-80").otherwise("81-100")


def calibration(pairs: DataFrame) -> DataFrame:
    """Per bucket: total, correct and whole per cent, halves up."""
    c = pairs.groupBy(bucket(F.col("score")).alias("bucket")).agg(F.count("*").alias("total"), F.count_if(F.col("status") == F.col("truth")).alias("correct"))
    return c.withColumn("accuracy", F.floor(F.col("correct") * 100 / F.col("total") + 0.5).cast("long"))


def calibration_error(pairs: DataFrame) -> DataFrame:
    """Expected calibration error over the buckets and Brier score."""
    ok = F.col("status") == F.col("truth")
    miss = F.col("score") - F.when(ok, 100).otherwise(0)  # whole points, so that sums don't depend on their order
    per = pairs.groupBy(bucket(F.col("score")).alias("b")).agg(F.count("*").alias("n"), F.count_if(ok).alias("ok"), F.sum("score").alias("s"), F.sum((miss * miss).cast("long")).alias("sq"))
    total = F.sum("n")
    return per.agg((F.sum(F.abs(100 * F.col("ok") - F.col("s"))) / (100 * total)).alias("ece"), (F.sum("sq") / (10000 * total)).alias("brier"), total.alias("n"))


def accuracy(pairs: DataFrame, orphans: DataFrame, truths: DataFrame) -> DataFrame:
    """(correct, evaluated) of results against labels; orphans count as right up to the number of labelled ones, if there are any of both."""
    own = pairs.agg(F.count("*").alias("n"), F.count_if(F.col("status") == F.col("truth")).alias("ok"))
    found = orphans.agg(F.count("*").alias("found"))
    labelled_ = truths.agg(F.count_if(F.col("expected_label") == "ORPHAN_BANK_CREDIT").alias("labelled"))
    both = (F.col("found") > 0) & (F.col("labelled") > 0)
    extra = lambda c: F.when(both, c).otherwise(0)
    return own.crossJoin(found).crossJoin(labelled_).select((F.col("ok") + extra(F.least("found", "labelled"))).alias("correct"), (F.col("n") + extra(F.col("labelled"))).alias("evaluated"))  # one row each
