"""Rate windows that start at a client's first request after the one before has ended."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quittance.sources.stored import stored


def _next_starts(points: DataFrame, window: int) -> DataFrame:
    """(client, at, next): the first of the distinct points (client, at, bucket) of a client that is window or more after each.

    It lies in the bucket after the point's own or, if nothing there is late enough, first in the next bucket that holds any: points are
    sorted within a client's bucket, and of a whole client only buckets are.
    """
    none = F.lit(None).cast("long")
    real = points.select("client", "bucket", F.col("at").alias("v"), F.col("at").alias("real"), none.alias("of"))
    asked = points.select("client", (F.col("bucket") + 1).alias("bucket"), (F.col("at") + window).alias("v"), none.alias("real"), F.col("at").alias("of"))
    both = real.unionByName(asked)
    within = Window.partitionBy("client", "bucket").orderBy("v").rangeBetween(0, Window.unboundedFollowing)
    later = Window.partitionBy("client").orderBy("bucket").rowsBetween(1, Window.unboundedFollowing)
    buckets = both.groupBy("client", "bucket").agg(F.min("real").alias("first")).select("client", "bucket", F.min("first").over(later).alias("after"))
    found = both.withColumn("here", F.min("real").over(within)).where("of IS NOT NULL").join(buckets, ["client", "bucket"])
    return found.select("client", F.col("of").alias("at"), F.coalesce("here", "after").alias("next"))


def _window_starts(points: DataFrame, window: int) -> DataFrame:
    """(client, at) of the points at which a window starts.

    One with nothing in the window before it surely does. From those the chain of next starts is followed by doubling: each round adds the points
    that lie as many starts on as all rounds before have reached, and squares the jumps, so a burst of n windows takes log2(n) rounds of joins.
    """
    ends = points.groupBy("client", "bucket").agg(F.max("at").alias("end")).select("client", (F.col("bucket") + 1).alias("bucket"), "end")
    before = F.coalesce(F.lag("at").over(Window.partitionBy("client", "bucket").orderBy("at")), F.col("end"))
    known = stored(points.join(ends, ["client", "bucket"], "left").withColumn("before", before).where((F.col("before").isNull()) | (F.col("before") <= F.col("at") - window)).select("client", "at"), "rate-starts")
    # a jump to a point that is known leads nowhere new
    jumps = _next_starts(points, window).where("next IS NOT NULL").join(known.withColumnRenamed("at", "next"), ["client", "next"], "left_anti")
    jumps, new = stored(jumps, "rate-jumps"), None
    while True:
        new = stored(known.join(jumps, ["client", "at"]).select("client", F.col("next").alias("at")).distinct().join(known, ["client", "at"], "left_anti"), "rate-starts")
        if new.isEmpty():
            return known
        known = stored(known.unionByName(new), "rate-starts")
        onward = jumps.select("client", F.col("at").alias("next"), F.col("next").alias("far"))
        jumps = stored(jumps.join(onward, ["client", "next"]).select("client", "at", F.col("far").alias("next")), "rate-jumps")


def fixed_windows(requests: DataFrame, window: int, most: int) -> DataFrame:
    """(client, id, allowed, remaining, reset): whether each request is one of the first most of its window.

    requests (client, id, at): a window starts at the first request at or after the end of the one before and ends window later; at equal times
    ids decide. Refused requests don't prolong it. Null clients are one client, null times are left out. Requests are ranked within their window.
    """
    asked = requests.where("at IS NOT NULL").select(F.coalesce(F.col("client").cast("string"), F.lit("")).alias("key"), "client", "id", F.col("at").cast("long").alias("at"))
    points = asked.select(F.col("key").alias("client"), "at").distinct().withColumn("bucket", F.floor(F.col("at") / window))
    starts = _window_starts(stored(points, "rate-points"), window).withColumn("bucket", F.floor(F.col("at") / window))
    # a bucket is as long as a window, so one starts in it and one in the bucket before, at most
    own = starts.select(F.col("client").alias("key"), "bucket", F.col("at").alias("start"))
    last = own.select("key", (F.col("bucket") + 1).alias("bucket"), F.col("start").alias("last"))
    placed = asked.withColumn("bucket", F.floor(F.col("at") / window)).join(own, ["key", "bucket"], "left").join(last, ["key", "bucket"], "left")
    placed = placed.withColumn("start", F.when(F.col("start") <= F.col("at"), F.col("start")).otherwise(F.col("last")))
    nth = F.row_number().over(Window.partitionBy("key", "start").orderBy("at", "id"))
    return placed.withColumn("nth", nth).select(
        "client", "id", (F.col("nth") <= most).alias("allowed"), F.greatest(most - F.col("nth"), F.lit(0)).cast("long").alias("remaining"), (F.col("start") + window).alias("reset")
    )
