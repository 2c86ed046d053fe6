"""Edges of the operators behind the queries of records, and the streaming form of late adjustments."""

from pyspark.sql import functions as F

from quittance.operators import evidence, ledgers
from quittance.sources import exports
from quittance.streaming import late

EVENT = "seq long, event_id string, entry_id string, key string, amount long"
EVENTS = [(1, "e1", "a", "k1", -500), (2, "e2", "a", "k1", 5), (3, "e3", "a", "k1", 6), (4, "e4", "gone", "k2", 1), (5, "e5", "a", "k3", 200), (6, "e6", "a", "k2", -1), (7, "e7", "b", "k2", 3)]
TOLD = {"e1": "INVARIANT_BREACH", "e2": "APPLIED", "e3": "DUPLICATE", "e4": "PARENT_LEDGER_ENTRY_NOT_FOUND", "e5": "INVARIANT_BREACH", "e6": "APPLIED", "e7": "DUPLICATE"}


def entries(spark):
    return spark.createDataFrame([("a", 100, 90), ("b", 50, 50)], "entry_id string, gross long, net long")


def test_late_events(spark):
    got = {r.event_id: r for r in ledgers.adjust(entries(spark), spark.createDataFrame(EVENTS, EVENT)).collect()}
    assert {k: r.status for k, r in got.items()} == TOLD
    assert got["e3"].adjustment_id == got["e2"].adjustment_id and got["e2"].effective_net == got["e3"].effective_net == 95
    assert got["e1"].adjustment_id is None
    assert ledgers.adjust(entries(spark), spark.createDataFrame([], EVENT)).count() == 0


def test_late_events_as_a_stream(spark, tmp_path):
    """Batches one after the other, and one of them again, tell what all at once do."""
    source = tmp_path / "in"
    for cut in ((0, 2), (2, 4), (4, 7)):
        spark.createDataFrame(EVENTS[slice(*cut)], EVENT).coalesce(1).write.mode("append").json(str(source))
        events = spark.readStream.schema(EVENT).json(str(source))
        late.late_adjustments(events, entries(spark), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    again = spark.createDataFrame(EVENTS[2:4], EVENT)
    assert {r.status for r in late.judged_batch(again, entries(spark), str(tmp_path / "out"), 1).collect()} == {"DUPLICATE", "PARENT_LEDGER_ENTRY_NOT_FOUND"}
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.event_id: r.status for r in rows} == TOLD and len(rows) == len(EVENTS)


def test_partition_invariants(spark):
    s = spark.createDataFrame([("s1", True), ("s2", False), ("s3", True)], "settlement_id string, resolved boolean")
    c = spark.createDataFrame([("c1", True), ("c2", False)], "txn_id string, resolved boolean")
    match = "settlement_id string, txn_id string, settled long, credited long, difference long"
    holds = lambda m: {r["name"]: r.holds for r in ledgers.partition_invariants(s, c, spark.createDataFrame(m, match)).collect()}
    assert holds([("s1", "c1", 5, 5, 0)]) == {"SETTLEMENT_USED_ONCE": True, "SETTLEMENT_COMPLETE": False, "CREDIT_USED_ONCE": True, "CREDIT_COMPLETE": True, "MONEY_CONSERVED": True}
    broken = holds([("s1", "c1", 5, 3, 1), ("s3", "c1", 5, 5, 0)])
    assert not broken["CREDIT_USED_ONCE"] and not broken["MONEY_CONSERVED"] and broken["SETTLEMENT_COMPLETE"]
    assert holds([])["MONEY_CONSERVED"]


def test_exports_come_back(spark):
    rows = [(1, "a\tb\\n\nc\r\\", 2.5), (2, None, None), (3, "", 0.0), (4, "\\N", 1.0), (None, "\\\\t", -1.5)]
    df = spark.createDataFrame(rows, "id long, text string, x double")
    assert sorted(exports.from_json_lines(exports.json_lines(df), df.schema).collect(), key=str) == sorted(df.collect(), key=str)
    lines = exports.tab_lines(df)
    assert all("\n" not in r.value and r.value.count("\t") == 2 for r in lines.collect())
    assert sorted(exports.from_tab_lines(lines, df.schema).collect(), key=str) == sorted(df.collect(), key=str)


def test_batches_are_replaced(spark, tmp_path):
    path = str(tmp_path / "b")
    one = lambda b, x: spark.createDataFrame([(b, x)], "batch_id long, x long")
    for df in (one(1, 10), one(2, 20), one(1, 11)):
        exports.write_batch(df, path)
    assert {(r.batch_id, r.x) for r in spark.read.parquet(path).collect()} == {(1, 11), (2, 20)}


def test_identifiers(spark):
    known = spark.createDataFrame([("PAY-1001",), ("PAY-1002",), ("pay-2000",), ("XY",)], "id string")
    asked = [(1, "pay-1001"), (2, "#PAY-l00l:"), (3, "PAY-100"), (4, "PAY-10012"), (5, None), (6, ""), (7, "PAY-2OOO"), (8, "XYZ"), (9, "PAY-9999")]
    got = {r.token_id: r for r in evidence.resolve_ids(spark.createDataFrame(asked, "token_id long, token string"), known).collect()}
    assert [got[i].status[:9] for i in range(1, 10)] == ["VERIFIED_", "VERIFIED_", "AMBIGUOUS", "AMBIGUOUS", "UNRESOLVE", "UNRESOLVE", "VERIFIED_", "VERIFIED_", "UNRESOLVE"]
    assert got[2].matched_id == "PAY-1001" and got[7].matched_id == "pay-2000" and got[8].distance == 1
    assert got[3].candidates == ["PAY-1001", "PAY-1002"] and got[3].matched_id is None


def test_fingerprints_ignore_order_only(spark):
    a = spark.range(100).select("id", F.when(F.col("id") % 7 > 0, F.col("id") * 2).alias("x"))
    of = lambda df: ledgers.fingerprint(df, ["id", "x"]).first().fingerprint
    assert of(a) == of(a.orderBy(F.desc("id")).repartition(5))
    assert len({of(a), of(a.limit(99)), of(a.unionByName(a.limit(1))), of(a.fillna(0)), of(a.limit(0))}) == 5


def test_ids_are_not_broadcast(spark):
    """Small tables of ids are exploded to many texts, which a broadcast would collect on the driver."""
    ids = spark.range(2000).select("id", F.concat(F.lit("Cus-"), F.col("id").cast("string")).alias("text"))
    found = evidence.resolve_ids(ids.select(F.col("id").alias("token_id"), F.concat("text", F.lit("x")).alias("token")), ids.select(F.col("text").alias("id")))
    assert found.where("status <> 'UNRESOLVED_NO_MATCH'").count() == 2000
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
