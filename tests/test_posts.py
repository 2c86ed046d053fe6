"""Posts of a feed, reconciled once for each key."""

from pyspark.sql import functions as F

from quittance.streaming import ingest

POST = "key string, seq long, source string, amount string, currency string, date string, reference_id string, utr string, fee string, tax string"


def post(key, n, bad=0):
    rows = []
    for i in range(n):
        utr, at = f"{key}U{i}", "2024-03-01 10:00:00"
        amount, net = f"{100 + 50 * i}.00", f"{97 + 50 * i}.64"
        rows += [(key, 4 * i, "payment", amount, "INR", at, f"r{i}", None, "2", "0.36"), (key, 4 * i + 1, "settlement", net, "INR", "2024-03-02 10:00:00", f"r{i}", utr, None, None)]
        if i % 2 == 0:
            rows.append((key, 4 * i + 2, "bank", net, "INR", "2024-03-02 12:00:00", f"r{i}", utr, None, None))
    rows += [(key, 1000 + i, "payment", "-1", "INR", None, f"bad{i}", None, None, None) for i in range(bad)]
    return rows


def test_a_key_is_reconciled_once(spark, tmp_path):
    path, folder = str(tmp_path / "out"), str(tmp_path / "in")
    now = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")

    def send(*posts):
        spark.createDataFrame([r for p in posts for r in p], POST).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(POST).option("maxFilesPerTrigger", 1).parquet(folder)
        ingest.reconcile_posts(stream, path, str(tmp_path / "state"), now).awaitTermination()
        return {(r.key, r.batch): tuple(r)[2:] for r in ingest.answer(spark, path).collect()}

    first = send(post("a", 4, bad=1), post("b", 2))
    assert first == {("a", 0): (False, 11, 1, 4, 2, 70000, 29528), ("b", 0): (False, 5, 0, 2, 1, 25000, 9764)}
    again = send(post("a", 9), post("c", 1))  # the key counts, whatever the rows are: the answer is the stored one
    assert {k: v for k, v in again.items() if k[1] == 1} == {("a", 1): (True, 11, 1, 4, 2, 70000, 29528), ("c", 1): (False, 3, 0, 1, 1, 10000, 9764)}
    third = send(post("a", 1))
    assert third["a", 2][0] and third["a", 2][3:] == (4, 2, 70000, 29528)
    results = spark.read.parquet(f"{path}/results")
    assert results.count() == 7 and results.select("key").distinct().count() == 3
    # a micro-batch that is repeated after a failure replaces what it wrote
    ingest.take_posts(spark.createDataFrame(post("a", 4, bad=1) + post("b", 2), POST), 0, path, now)
    assert {(r.key, r.batch): tuple(r)[2:] for r in ingest.answer(spark, path).collect()} == third
    assert spark.read.parquet(f"{path}/results").count() == 7
