"""Rate windows, outages and matches between windows, in batch and as streams, against plain versions."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from quittance.operators import outages, rates, windows
from quittance.streaming import stateful


def plain_windows(rows, window, most):
    ends, counts, out = {}, {}, {}
    for client, id_, at in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[1])):
        if client not in ends or ends[client] <= at:
            ends[client], counts[client] = at + window, 0
        counts[client] += 1
        out[id_] = (client, counts[client] <= most, max(most - counts[client], 0), ends[client])
    return out


@pytest.mark.parametrize("window, most", [(10, 2), (7, 1), (1000, 3)])
def test_rate_windows(spark, window, most):
    """Bursts of many windows on end, gaps, equal times, times before zero, a null client."""
    rng = random.Random(window)
    rows = [(c, i * 10 + j, t) for j, c in enumerate(["a", "b", None]) for i, t in enumerate(sorted(rng.randrange(-300, 900) for _ in range(150)))]
    rows += [("burst", 5000 + i, 3 * i) for i in range(400)] + [("same", 9000 + i, 55) for i in range(5)] + [("a", 9999, None)]
    got = rates.fixed_windows(spark.createDataFrame(rows, "client string, id long, at long").repartition(4), window, most)
    assert {r.id: (r.client, r.allowed, r.remaining, r.reset) for r in got.collect()} == plain_windows(rows, window, most)
    assert rates.fixed_windows(spark.createDataFrame([], "client string, id long, at long"), window, most).count() == 0


EVENTS = "source string, event_id long, at_s long, kind string, payload string"


def outage_rows(seed):
    rng = random.Random(seed)
    return [(rng.choice(["x", "y", "z", None]), i, i * 4000, rng.choice(["OUTAGE", "RETRY", "RETRY", "RETRY", "PAYLOAD", "PAYLOAD"]), rng.choice(["p", "q", "r", None])) for i in range(200)]


def folded(rows):
    state, out = {}, []
    for source, id_, at, kind, payload in rows:
        s = state.setdefault(source, {})
        out.append(outages.told(s, id_, outages.advance(s, kind, at, payload)))
    return sorted(out)


def test_steps_of_an_outage():
    s = {}
    assert outages.advance(s, "RETRY", 5, None) == "UNKNOWN_SOURCE" and not s
    assert outages.advance(s, "OUTAGE", 0, None) == "REGISTERED" and s["next"] == 60
    for n, wait in enumerate((120, 240, 480, 960, 1920, 3840, 7680, 14400, 14400), 1):
        assert outages.advance(s, "RETRY", 100, None) == "RETRIED" and (s["retries"], s["next"], s["status"]) == (n, 100 + wait, "PENDING_RETRY")
    outages.advance(s, "RETRY", 48 * 3600, None)
    assert s["status"] == "PENDING_RETRY"
    outages.advance(s, "RETRY", 48 * 3600 + 1, None)
    assert s["status"] == "DELAYED_SLA_BREACHED"
    assert [outages.advance(s, "PAYLOAD", 1, p) for p in "aaba"] == ["RECOVERED_NEW", "IDEMPOTENT_DUPLICATE", "CONFLICTING_PAYLOAD", "IDEMPOTENT_DUPLICATE"]
    assert s["status"] == "CONFLICTING_DATA_RECEIVED"


def test_outages_in_batch(spark):
    rows = outage_rows(1)
    got = outages.source_states(spark.createDataFrame(rows, EVENTS).repartition(5))
    assert sorted(map(tuple, got.collect())) == folded(rows)


def streamed(spark, folder, frames, schema, make):
    """All rows that make() gives of a stream of frames, one file a micro-batch; stopped and started again halfway."""
    out = []
    names = iter(range(100))
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    for part in (frames[: len(frames) // 2], frames[len(frames) // 2 :]):
        for rows in part:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        q = make(source()).writeStream.foreachBatch(lambda df, i: out.extend(map(tuple, df.collect()))).option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start(queryName=None)
        q.awaitTermination()
        next(names)
    return out


def test_outages_as_a_stream(spark, tmp_path):
    """The same rows as the batch form, over several micro-batches and a restart."""
    rows = outage_rows(2)
    got = streamed(spark, tmp_path, [rows[i : i + 50] for i in range(0, 200, 50)], EVENTS, stateful.source_states)
    assert sorted(got) == folded(rows)


@pytest.mark.parametrize("tolerance", [0, 2])
def test_cross_window_stream(spark, tmp_path, tolerance):
    """Both sides in the order of time, a bit mixed, give the rows of the batch form once the watermark has passed them."""
    rng, hour, start = random.Random(tolerance), 3600, datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = []
    for i in range(160):
        w = i // 4
        side = rng.random() < 0.5
        rows.append((side, f"{'c' if side else 's'}{i:03d}", rng.choice([None, "u1", "u2", "u3", f"v{i // 3}"]), rng.choice([100, 101, 300, None]), start + timedelta(seconds=w * hour + rng.randrange(hour))))
    last = [(True, "end", "end", 1, start + timedelta(days=30))]
    schema = "credit boolean, id string, utr string, amount long, at timestamp"
    got = streamed(spark, tmp_path, [rows[i : i + 40] for i in range(0, 160, 40)] + [last, [(True, "end2", "end", 1, start + timedelta(days=60))]], schema, lambda s: stateful.cross_window_matches(s, hour, tolerance))
    window = lambda r: int(r[4].timestamp()) // hour
    s = spark.createDataFrame([(r[1], r[2], r[3], window(r)) for r in rows if not r[0]], "settlement_id string, utr string, amount long, window long")
    c = spark.createDataFrame([(r[1], r[2], r[3], window(r)) for r in rows if r[0]], "txn_id string, utr string, amount long, window long")
    want = sorted(map(tuple, windows.cross_window_matches(s, c, tolerance).select("txn_id", "settlement_id", "utr", "difference").collect()))
    assert sorted(got) == want and len(want) > 5
