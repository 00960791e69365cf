"""State changes as they come: the last state of each key is kept, invalid changes and due retries are reported."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.queue import TRANSITIONS

#: Seconds of a wait for each attempt after a rate limit, and how many attempts there are.
BACKOFF_SECONDS, MAX_RETRIES = 60, 5

_OUT = "key {key}, at long, seq long, was string, status string, kind string"
_STATE = "status string, at long, seq long, attempts int, due long"


def _forbidden(was: str | None, status: str | None) -> bool:
    return was in TRANSITIONS and status is not None and status != was and status not in TRANSITIONS[was]


def _plain(column: pd.Series) -> list:
    """Its values as plain numbers and texts, missing ones as None; whole numbers beside missing ones come as floats."""
    values = column.tolist()
    return [None if pd.isna(x) else int(x) if isinstance(x, float) else x for x in values] if column.hasnans else values


def follow(events: DataFrame, lateness: str | None = None, backoff_seconds: int = BACKOFF_SECONDS, max_retries: int = MAX_RETRIES) -> DataFrame:
    """A stream of events (key, ts, seq, status, limited) -> rows (key, ts, seq, was, status, kind).

    kind "invalid": an event whose state may not follow the key's one before, across batches and restarts, in the order
    of (ts, seq) inside a batch, without a time last; an event older than what an earlier batch had of its key is compared with that. With ``lateness`` (a watermark
    on ts) rate-limited failures (``limited``) are retried: a timer is set for ts + backoff_seconds * attempt, for at
    most ``max_retries`` attempts in a row; if it fires before another event of the key comes, a row of kind "requeued"
    says so, and the key is queued from then on. A completed event ends the row of attempts.

    The state is one row for each key; a key's events of one batch are sorted in one task, so batches bound what a hot key costs.
    """
    timed = lateness is not None
    kind = events.schema["key"].dataType.simpleString()
    names = ["key", "at", "seq", "was", "status", "kind"]
    # a microsecond count beside ts: states and comparisons are exact
    rows = events.select("key", F.col("ts").cast("timestamp").alias("ts"), "seq", "status", F.coalesce("limited", F.lit(False)).alias("limited"))
    rows = rows.withWatermark("ts", lateness) if timed else rows
    rows = rows.withColumn("at", F.unix_micros("ts"))

    def due_row(key: tuple, due: int) -> pd.DataFrame:
        return pd.DataFrame([(key[0], due, None, "backoff", "queued", "requeued")], columns=names)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        was, at, seq, attempts, due = state.get if state.exists else (None, None, None, 0, None)
        if state.hasTimedOut:
            yield due_row(key, due)
            state.update(("queued", due, seq, attempts, None))
            return
        # one key's rows of one batch, as lists: operations on a frame cost more than all the rows of a usual key
        own = [row for b in batches for row in zip(*[_plain(b[c]) for c in ("at", "seq", "status", "limited")], strict=True)]
        own.sort(key=lambda row: tuple((x is None, x) for x in row[:2]))
        bad = []
        for row in own:
            at, seq, status, failed = row[0], row[1], row[2], row[2] == "failed" and row[3]
            if _forbidden(was, status):
                bad.append((key[0], at, seq, was, status, "invalid"))
            attempts = 0 if status == "completed" else attempts + failed
            was = status
        if bad:
            yield pd.DataFrame(dict(zip(names, map(list, zip(*bad, strict=True)), strict=True)))
        due = at + backoff_seconds * attempts * 1_000_000 if timed and failed and at is not None and attempts <= max_retries else None
        if due is not None and due // 1000 <= state.getCurrentWatermarkMs():  # the wait is over already
            yield due_row(key, due)
            status, due = "queued", None
        state.update((status, at, seq, attempts, due))
        if due is not None:
            state.setTimeoutTimestamp(-(-due // 1000))

    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    found = rows.groupBy("key").applyInPandasWithState(step, _OUT.format(key=kind), _STATE, "append", timeout)
    return found.select("key", F.timestamp_micros("at").alias("ts"), "seq", "was", "status", "kind")
