"""Keyed state over streams: each user's last turns, timers that fire once, and daily limits. Batch twins:
``operators.entities.context_window`` and ``cooldown``, and ``due``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEEP = 10


def _windowed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held: list[str] = list(state.get[0]) if state.exists else []
    for rows in batches:
        rows = rows.sort_values("turn")
        out = []
        for said in rows["text"]:
            out.append(list(held))
            held = [*held, "" if said is None else said][-KEEP:]
        yield pd.DataFrame({"user_id": rows["user_id"].to_numpy(), "turn": rows["turn"].to_numpy(), "context": out})
    state.update((held,))


def context_stream(turns: DataFrame) -> DataFrame:
    """``user_id, turn, text`` -> ``user_id, turn, context``: the texts before each turn, ``KEEP`` at most. The state of a user is
    those texts."""
    return turns.select("user_id", "turn", "text").groupBy("user_id").applyInPandasWithState(_windowed, "user_id long, turn long, context array<string>", "held array<string>", "append", GroupStateTimeout.NoTimeout)


def due(timers: DataFrame, now: Column) -> DataFrame:
    """Timers that fire now: due, and not fired before."""
    return timers.where((F.col("fire_at") <= now) & ~F.coalesce("fired", F.lit(False)))


def fired(timers: DataFrame, now: Column) -> DataFrame:
    return timers.withColumn("fired", F.coalesce("fired", F.lit(False)) | (F.col("fire_at") <= now))


def _timer(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    at, done = state.get if state.exists else (None, False)
    if state.hasTimedOut:
        state.update((at, True))
        yield pd.DataFrame({"user_id": [key[0]], "timer_id": [key[1]], "fire_at": [pd.Timestamp(at, unit="ms")]})
        return
    for rows in batches:
        if not done and len(rows):
            at = int(rows["fire_at"].iloc[-1].timestamp() * 1000)  # set anew: the last time holds
    state.update((at, done))
    if at is not None and not done:
        state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs() + 1))


def timer_stream(timers: DataFrame, late: str = "0 seconds") -> DataFrame:
    """``timers(user_id, timer_id, fire_at timestamp, at timestamp)`` -> the timers, each once, when the watermark over ``at``, the
    stream's own clock, has passed their time. A timer that comes again before it has fired is set anew; after that it is
    ignored."""
    watched = timers.select("user_id", "timer_id", "fire_at", "at").withWatermark("at", late)
    return watched.groupBy("user_id", "timer_id").applyInPandasWithState(_timer, "user_id long, timer_id long, fire_at timestamp", "fire_at long, fired boolean", "append", GroupStateTimeout.EventTimeTimeout)


def cooldown_stream(events: DataFrame, limit: int = 3) -> DataFrame:
    """``event_id, user_id, ts`` -> ``event_id, nth, allowed``: the number of each event in its user's day, which starts anew with the
    day, and whether it is within the limit. Events of a day must not come after those of a later one."""

    def counted(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        day, n = state.get if state.exists else (-1, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for d in rows["day"]:
            day, n = (day, n + 1) if d == day else (d, 1)
            out.append(n)
        state.update((int(day), int(n)))
        yield pd.DataFrame({"event_id": rows["event_id"].to_numpy(), "nth": out, "allowed": [x <= limit for x in out]})

    rows = events.select("event_id", "user_id", "ts", F.unix_date(F.to_date("ts")).alias("day"))
    return rows.groupBy("user_id").applyInPandasWithState(counted, "event_id long, nth long, allowed boolean", "day long, n long", "append", GroupStateTimeout.NoTimeout)
