"""Outages of sources: retries that wait twice as long each time, deadlines, and payloads that recover, repeat or contradict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quittance.operators.turns import streamed

#: Seconds of a deadline, of the first wait and of the longest.
SLA_S, WAIT_S, LONGEST_WAIT_S = 48 * 3600, 60, 4 * 3600
TOLD = "event_id long, outcome string, status string, retries long, next_retry_s long, deadline_s long"


def advance(state: dict, kind: str, at: int, payload: str | None) -> str:
    """Change the state of a source by one event; what came of it.

    OUTAGE starts anew and forgets payloads. RETRY of an unknown source is UNKNOWN_SOURCE and changes nothing; after the deadline it breaches.
    The first PAYLOAD (a digest) recovers the source, an equal one is a duplicate, another one a conflict; an unknown source becomes known by it.
    """
    if kind == "OUTAGE":
        state.clear()
        state.update(status="SOURCE_UNAVAILABLE", retries=0, next=at + WAIT_S, deadline=at + SLA_S, payloads=[])
        return "REGISTERED"
    if kind == "RETRY":
        if not state:
            return "UNKNOWN_SOURCE"
        state["retries"] += 1
        state["status"] = "DELAYED_SLA_BREACHED" if at > state["deadline"] else "PENDING_RETRY"
        # twice as long as any wait under the longest is reached after few doublings, so the power stays small
        state["next"] = at + min(WAIT_S << min(state["retries"], 20), LONGEST_WAIT_S)
        return "RETRIED"
    if not state:
        state.update(status="AVAILABLE", retries=0, next=at, deadline=at + SLA_S, payloads=[])
    if payload in state["payloads"]:
        return "IDEMPOTENT_DUPLICATE"
    state["payloads"].append(payload)
    if len(state["payloads"]) > 1:
        state["status"] = "CONFLICTING_DATA_RECEIVED"
        return "CONFLICTING_PAYLOAD"
    state["status"] = "AVAILABLE"
    return "RECOVERED_NEW"


def told(state: dict, event_id: int, outcome: str) -> tuple:
    return event_id, outcome, state.get("status"), state.get("retries"), state.get("next"), state.get("deadline")


def source_states(events: DataFrame) -> DataFrame:
    """(event_id, outcome, status, retries, next_retry_s, deadline_s) after each of events (source, event_id, at_s, kind, payload).

    A source's events are streamed through a task in order of at_s, then event_id; a task holds one source's state, with its different payloads.
    Null sources are one source.
    """

    def fold(state: dict, rows: list[tuple]) -> list[tuple]:
        return [told(state, event_id, advance(state, kind, at, payload)) for event_id, at, kind, payload in rows]

    rows = events.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("event_id").cast("long"), F.col("at_s").cast("long"), "kind", "payload")
    return streamed(rows, "source", "at_s", ["event_id"], fold, TOLD, dict)
