"""Decisions, policies, exposure, tolerance stacking and routing as row rules and sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the rules, in minor units.
MATERIAL, LOW_CONFIDENCE, AGGREGATE = 1_000_000, 40, 5_000_000
RISKY_METHODS, KNOWN_METHODS = ("card", "netbanking"), ("upi", "card", "netbanking", "wallet")


def decide(results: DataFrame) -> DataFrame:
    """Outcome, risk and triggers of each result, and the batch rule over all that isn't matched."""
    net, score = F.abs(F.col("expected_net")), F.col("score")
    material, low = net >= MATERIAL, score < LOW_CONFIDENCE
    auto, review = F.col("status") == "AUTO_MATCHED", F.col("status") == "NEEDS_MANUAL_REVIEW"
    first = F.col("payment_id").startswith("orphan_") | ~F.col("method").isin(*KNOWN_METHODS)
    off = F.coalesce(F.abs(F.col("mismatch")), F.lit(0)) > F.greatest(F.lit(1000), F.floor(net * 0.05 + 0.5).cast("long"))
    unusual = ((F.col("expected_net") != 0) & off) | (F.col("status").isin("DELAYED_BANK_CREDIT", "MISSING_BANK_CREDIT") & material)
    provider = F.col("method").isin(*RISKY_METHODS) & material
    risk = (
        F.when(auto, "LOW")
        .when(review, F.when(material | low, "HIGH").otherwise("MEDIUM"))
        .when((low & material) | unusual | provider | first, "HIGH")
        .when(material | low, "MEDIUM")
        .otherwise("LOW")
    )
    outcome = F.when(auto, "AUTO_MATCH").when(review, "SUGGESTED").otherwise("EXCEPTION")
    names = [(material, "MATERIAL"), (low, "LOW_CONFIDENCE"), (first, "FIRST_OCCURRENCE"), (provider, "PROVIDER_RISK"), (unusual, "UNUSUAL_PATTERN")]
    triggers = F.when(auto, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*(F.when(c, n) for c, n in names))))
    at_risk = F.when(auto, 0).otherwise(F.coalesce(F.nullif(F.abs(F.col("mismatch")), F.lit(0)), net))
    d = results.select("payment_id", "status", "method", "expected_net", "score", outcome.alias("outcome"), risk.alias("risk"), triggers.alias("triggers"), at_risk.alias("at_risk"))
    total = d.agg(F.coalesce(F.sum("at_risk"), F.lit(0)).alias("batch_risk"))  # one row
    over = (F.col("batch_risk") >= AGGREGATE) & (F.col("outcome") != "AUTO_MATCH")
    return d.crossJoin(total).select(
        "payment_id", "status", "method", "expected_net", "score", "outcome", F.when(over, "HIGH").otherwise(F.col("risk")).alias("risk"), F.col("risk").alias("own_risk"),
        F.array_join(F.when(over, F.array_append("triggers", F.lit("AGGREGATE"))).otherwise(F.col("triggers")), ",").alias("triggers"), "at_risk",
    )


#: Numbers of the baseline policy; a candidate replaces some of them.
BASELINE = {"tolerance": 100, "window_h": 48, "materiality": 500_000, "auto_min": 90, "suggest_min": 70, "maker_checker": 1_000_000, "escalation": 5_000_000}


def policy(amount: Column, discrepancy: Column, hours: Column, allowed: Column, p: dict = BASELINE) -> dict[str, Column]:
    """Columns score, outcome, risk, maker_checker, escalated of a policy."""
    some, large, late = (discrepancy > 0) & (discrepancy <= p["tolerance"]), discrepancy > p["tolerance"], hours > p["window_h"]
    material, escalated = discrepancy >= p["materiality"], amount >= p["escalation"]
    score = 100 - F.when(some, 5).when(large, 35).otherwise(0) - F.when(late, 25).otherwise(0) - F.when(allowed, 0).otherwise(20)
    outcome = F.when(large | late | material, "EXCEPTION").when(score >= p["auto_min"], "AUTO_MATCH").when(score >= p["suggest_min"], "SUGGESTED").otherwise("EXCEPTION")
    risk = F.when(escalated, "CRITICAL").when(material, "HIGH").when(large | late, "MEDIUM").otherwise("LOW")
    return {"score": score, "outcome": outcome, "risk": risk, "maker_checker": amount >= p["maker_checker"], "escalated": escalated}


def exposure(variances: DataFrame) -> DataFrame:
    """0-100 exposure score of variances (variance in minor units) and its parts, in one pass."""
    v = F.abs(F.col("variance"))
    small = (v > 0) & (v <= 100_000)
    s = variances.where(v > 0).agg(
        F.count_if(v > 5_000_000).alias("high"),
        F.count_if((v >= 1_000_000) & (v <= 5_000_000)).alias("medium"),
        F.coalesce(F.sum(v), F.lit(0)).alias("total"),
        F.count("*").alias("n"),
        F.count_if(small).alias("n_small"),
        F.coalesce(F.sum(F.when(small, v)), F.lit(0)).alias("small_sum"),
    )
    breach = (F.col("n_small") >= 25) | (F.col("small_sum") >= 1_000_000)
    parts = [
        F.least(F.lit(40), 8 * F.col("high") + 3 * F.col("medium")),
        F.least(F.lit(30), F.floor(F.col("total") * 30 / 10_000_000)),
        F.least(F.lit(15), F.floor(F.col("n") * 15 / 30)),
        F.when(breach, 15).otherwise(F.least(F.lit(15), F.floor(F.col("small_sum") * 15 / 1_000_000))),
    ]
    score = F.least(F.lit(100), sum(parts[1:], parts[0])).cast("long")
    s = s.withColumn("stacking_breach", breach).withColumn("exposure_score", score)
    return s.withColumn("band", F.when(score >= 75, "CRITICAL").when(score >= 50, "HIGH").when(score >= 25, "MEDIUM").otherwise("LOW"))


def tolerance_stacking(rows: DataFrame) -> DataFrame:
    """(level, name, discrepancy, gross, breach) for merchants, providers and the batch, from one set of grouping sets."""
    limit = F.when(F.col("level") == "merchant", 10_000).when(F.col("level") == "provider", 25_000).otherwise(50_000)
    g = rows.withColumn("d", F.abs(F.col("gross") - F.col("settled")))
    sums = g.groupingSets([[F.col("merchant")], [F.col("provider")], []], F.col("merchant"), F.col("provider")).agg(
        F.grouping_id().alias("gid"), F.sum("d").alias("discrepancy"), F.sum("gross").alias("gross")
    )
    named = sums.select(F.when(F.col("gid") == 1, "merchant").when(F.col("gid") == 2, "provider").otherwise("batch").alias("level"), F.coalesce("merchant", "provider", F.lit("all")).alias("name"), "discrepancy", "gross")
    drift = (F.col("level") == "batch") & (F.col("discrepancy") * 1000 > F.col("gross") * 5)
    return named.withColumn("breach", (F.col("discrepancy") > limit) | drift)


def routing_risk(confidence: Column, exposure_minor: Column) -> Column:
    """0.4 (1 - confidence) + 0.6 exposure factor, which is logarithmic from 0.05 to 1; four decimals."""
    e = F.greatest(exposure_minor, F.lit(1)).cast("double")
    factor = F.when(exposure_minor <= 10_000, 0.05).when(exposure_minor >= 100_000_000, 1.0).otherwise(0.05 + 0.95 * (F.log10(e) - 4) / 4)
    factor = F.floor(factor * 10000 + 0.5) / 10000
    return F.floor((0.4 * (1 - confidence) + 0.6 * factor) * 10000 + 0.5) / 10000


def top_exceptions(decisions: DataFrame, n: int = 10) -> DataFrame:
    """The n largest exceptions: a top-k report."""
    return decisions.where("outcome <> 'AUTO_MATCH'").orderBy(F.desc("at_risk"), "payment_id").limit(n).select("payment_id", "status", "at_risk")


def merged_window_rate(events: DataFrame, seconds: int) -> DataFrame:
    """Events of the same key in the `seconds` before each event, itself included."""
    w = Window.partitionBy("user_id").orderBy("ts_s").rangeBetween(-seconds, 0)
    return events.withColumn("recent", F.count("*").over(w))
