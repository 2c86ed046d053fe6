"""Feeds that arrive in posts: each post is reconciled as it comes, once for its key, whatever is repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quittance.operators import matching
from quittance.sources.adapters import fan_out, feed_errors
from quittance.sources.stored import exists, new_path

ANSWER = "key string, batch long, deduplicated boolean, n_records long, n_rejected long, n_results long, n_matched long, gross long, credited long"


def reconciled(feed: DataFrame, now) -> DataFrame:
    """The results of one post's valid rows: fanned out to the six tables and matched."""
    t = fan_out(feed, now)
    seconds = lambda c: F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {c})").cast("long")
    pay = t["payments"].withColumn("captured_s", seconds("captured_at")).withColumn("class", F.lit(None).cast("int"))
    setl = t["settlements"].withColumn("settled_s", seconds("settled_at"))
    bank = t["bank"].withColumn("txn_s", seconds("txn_at"))
    return matching.match(pay, setl, bank, t["refunds"], t["chargebacks"], t["orders"])


def answer(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The stored answers (ANSWER) to all posts so far, in folders by micro-batch; or only the folders of earlier ones."""
    if not exists(spark, f"{path}/answers"):
        return spark.createDataFrame([], ANSWER)
    held = spark.read.schema(f"{ANSWER}, part long").parquet(f"{path}/answers")
    return (held if before is None else held.where(F.col("part") < before)).drop("part")


def take_posts(rows: DataFrame, batch: int, path: str, now) -> None:
    """Answer the posts of a micro-batch (key, seq, fields of a feed): new keys are matched, known ones get what is stored.

    Each post is a batch of its own, as payments of different posts must not compete for credits; their number is that of the posts that a trigger lets in.
    A post's results go to a folder named by its key's digest, and a repeated micro-batch writes the same folders again.
    """
    spark = rows.sparkSession
    before = answer(spark, path, batch).where("NOT deduplicated")
    # the post's rows may be read several times
    held = new_path(spark, "posts")
    rows.write.parquet(held)
    rows = spark.read.schema(rows.schema).parquet(held)
    keys = rows.groupBy("key").agg(F.count("*").alias("n_records"))
    known = keys.select("key").join(before, "key").select("key", F.lit(batch).cast("long").alias("batch"), F.lit(True).alias("deduplicated"), "n_records", "n_rejected", "n_results", "n_matched", "gross", "credited")
    out = known
    for post in keys.join(before.select("key"), "key", "left_anti").collect():
        told = feed_errors(rows.where(F.col("key") == post.key))
        name = f"{path}/results/key={spark.range(1).select(F.sha2(F.lit(post.key), 256)).first()[0]}"
        reconciled(told.where(F.size("errors") == 0), now).write.mode("overwrite").parquet(name)
        bad = told.where(F.size("errors") > 0).count()
        sums = spark.read.parquet(name).agg(
            F.count("*").alias("n_results"), F.count_if(F.col("status") == "AUTO_MATCHED").alias("n_matched"), F.coalesce(F.sum("payment_amount"), F.lit(0)).alias("gross"), F.coalesce(F.sum("bank_amount"), F.lit(0)).alias("credited")
        )
        head = [F.lit(post.key).alias("key"), F.lit(batch).cast("long").alias("batch"), F.lit(False).alias("deduplicated"), F.lit(post.n_records).cast("long").alias("n_records"), F.lit(bad).cast("long").alias("n_rejected")]
        out = out.unionByName(sums.select(*head, "n_results", "n_matched", "gross", "credited"))
    out.write.mode("overwrite").parquet(f"{path}/answers/part={batch}")


def reconcile_posts(posts: DataFrame, path: str, checkpoint: str, now, **trigger) -> StreamingQuery:
    """Answer a stream of posts into path; see take_posts."""
    return posts.writeStream.foreachBatch(lambda rows, batch: take_posts(rows, batch, path, now)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
