"""Late events as a stream: each micro-batch is adjusted against what earlier ones have applied."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quittance.operators.ledgers import adjust
from quittance.sources.stored import exists

_STORED = "event_id string, key string, status string, adjustment_id string, effective_net long, batch long"


def judged_batch(events: DataFrame, entries: DataFrame, path: str, batch: int) -> DataFrame:
    """What adjust() says of the events of a micro-batch, where keys that earlier batches in path applied stay theirs."""
    spark = events.sparkSession
    before = spark.read.schema(_STORED).parquet(path) if exists(spark, path) else spark.createDataFrame([], _STORED)
    applied = before.where((F.col("batch") < batch) & (F.col("status") == "APPLIED")).select("key", F.col("adjustment_id").alias("its"), F.col("effective_net").alias("net"), F.lit(True).alias("taken"))
    known = events.select("event_id", "key").join(applied, "key", "left")
    told = adjust(entries, events).join(known, "event_id")
    of = lambda mine, other: F.when(F.col("taken"), other).otherwise(mine)
    return told.select("event_id", "key", of(F.col("status"), "DUPLICATE").alias("status"), of(F.col("adjustment_id"), F.col("its")).alias("adjustment_id"), of(F.col("effective_net"), F.col("net")).alias("effective_net"))


def late_adjustments(events: DataFrame, entries: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write (event_id, key, status, adjustment_id, effective_net) of a stream of late events to path, a folder a micro-batch.

    Events keep the order of seq from batch to batch and event ids are unique. A batch that is repeated after a
    failure replaces its own folder, so that every event is told once. Late events are never dropped, so there is
    no watermark; state is the table of applied keys, read as a join, not held in memory.
    """

    def write(rows: DataFrame, batch: int) -> None:
        judged_batch(rows, entries, path, batch).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
