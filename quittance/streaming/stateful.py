"""Streams that hold state for each key: outages of sources, and matches between windows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quittance.operators import outages, windows


def source_states(events: DataFrame) -> DataFrame:
    """outages.source_states() of a stream: events of a source keep their order from batch to batch, within a batch at_s and event_id decide.

    The state of a source is its status and the digests of its different payloads; sources stay known for good, as they do in the batch form.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(held.get[0]) if held.exists else {}
        rows = pd.concat(list(frames)).sort_values(["at_s", "event_id"])
        out = [outages.told(state, int(r.event_id), outages.advance(state, r.kind, int(r.at_s), r.payload)) for r in rows.itertuples()]
        if state:
            held.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in outages.TOLD.split(", ")]).astype({c: "Int64" for c in ("retries", "next_retry_s", "deadline_s")})

    keyed = events.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), "event_id", "at_s", "kind", "payload")
    return keyed.groupBy("source").applyInPandasWithState(fold, outages.TOLD, "state string", "append", GroupStateTimeout.NoTimeout)


MATCHED = "txn_id string, settlement_id string, utr string, difference long"


def cross_window_matches(rows: DataFrame, window_s: int, tolerance: int = 0, delta: int = windows.MAX_DELTA, late_s: int = 0) -> DataFrame:
    """windows.cross_window_matches() of a stream of both sides (credit boolean, id, utr, amount, at timestamp), whose window is at / window_s.

    Rows of a reference whose windows follow each other within delta belong together. They are held until the watermark, late_s behind the latest
    row, has passed delta windows beyond their last one; then nothing can come that changes them, they are decided in order and forgotten. So the
    rows are those of the batch form, but for rows that come later than the watermark, which are left out. Nulls match nothing.
    """
    decide = windows.turn(tolerance, delta)

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = json.loads(held.get[0]) if held.exists else []
        if not held.hasTimedOut:
            for f in frames:
                rows += [[int(w), bool(c), i, int(a)] for w, c, i, a in zip(f.window, f.credit, f.id, f.amount, strict=True)]
        rows.sort(key=lambda r: r[0])
        islands: list[list] = []
        for r in rows:
            if not islands or r[0] - islands[-1][-1][0] > delta:
                islands.append([])
            islands[-1].append(r)
        closes = lambda island: (island[-1][0] + delta + 1) * window_s * 1000
        closed = [i for i in islands if closes(i) <= held.getCurrentWatermarkMs()]
        out = []
        for island in closed:
            left = windows.Open()
            for w, credit, id_, amount in sorted(island, key=lambda r: (r[1], r[2])):
                out += decide(left, [(None, id_, credit, key[0], amount, w)])
        open_ = islands[len(closed) :]
        if open_:
            held.update((json.dumps([r for i in open_ for r in i]),))
            held.setTimeoutTimestamp(max(closes(open_[0]), held.getCurrentWatermarkMs() + 1))
        elif held.exists:
            held.remove()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in MATCHED.split(", ")])

    good = rows.where("utr IS NOT NULL AND amount IS NOT NULL AND at IS NOT NULL").withWatermark("at", f"{late_s} seconds")
    keyed = good.select("utr", "credit", "id", F.col("amount").cast("long").alias("amount"), F.floor(F.unix_seconds("at") / window_s).alias("window"), "at")
    return keyed.groupBy("utr").applyInPandasWithState(step, MATCHED, "rows string", "append", GroupStateTimeout.EventTimeTimeout)
