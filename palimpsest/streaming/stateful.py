"""Keyed state of streams in list and map states of the RocksDB store, with time to live.

Each has a batch twin: ``people_stream`` is ``enrich.with_people``, ``daily_stream`` is ``entities.cooldown``. A key's rows of a batch are
put in order before they are worked on; between batches the stream brings them in order. State is kept by the query's
checkpoint and survives a restart.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from palimpsest.operators.enrich import _THIRD

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Streams started from here on keep their state in RocksDB, which these need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _together(batches: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    return pd.concat(list(batches), ignore_index=True).sort_values(list(order), kind="stable")


class _People(StatefulProcessor):
    def __init__(self, look: int, ttl_ms: int | None) -> None:
        self.look, self.ttl_ms = look, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.said = handle.getListState("said", "names array<string>", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [list(x[0]) for x in self.said.get()] if self.said.exists() else []
        table = _together(rows, "turn")
        subjects, entities = [], []
        for r in table.itertuples(index=False):
            before = [n for names in held[-self.look :] for n in names]
            person = before[-1] if before and isinstance(r.subject, str) and r.subject.lower() in _THIRD else None
            own = [] if r.entities is None else list(r.entities)
            subjects.append(person or r.subject)
            entities.append(list(dict.fromkeys([*own, *(x for x in (person, r.speaker) if isinstance(x, str))])))
            held = [*held, own][-self.look :]
        self.said.put([(x,) for x in held])
        yield pd.DataFrame({"user_id": table["user_id"].to_numpy(), "turn": table["turn"].to_numpy(), "subject": subjects, "entities": entities})

    def close(self) -> None:
        pass


def people_stream(rows: DataFrame, look: int = 10, ttl_ms: int | None = None) -> DataFrame:
    """``rows(user_id, turn, subject, entities, speaker)`` with third-person subjects and entities resolved: the state of a user is the
    names of the last ``look`` sentences, forgotten ``ttl_ms`` after the last one, if given."""
    grouped = rows.select("user_id", "turn", "subject", "entities", "speaker").groupBy("user_id")
    return grouped.transformWithStateInPandas(statefulProcessor=_People(look, ttl_ms), outputStructType="user_id long, turn long, subject string, entities array<string>", outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")


class _Daily(StatefulProcessor):
    def __init__(self, limit: int, ttl_ms: int) -> None:
        self.limit, self.ttl_ms = limit, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "day string", "n long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        table = _together(rows, "ts", "event_id")
        nth = []
        for day in table["ts"].dt.strftime("%Y-%m-%d"):
            n = (self.counts.getValue((day,))[0] if self.counts.containsKey((day,)) else 0) + 1
            self.counts.updateValue((day,), (n,))
            nth.append(n)
        yield pd.DataFrame({"event_id": table["event_id"].to_numpy(), "user_id": table["user_id"].to_numpy(), "nth": nth, "allowed": [n <= self.limit for n in nth]})

    def close(self) -> None:
        pass


def daily_stream(events: DataFrame, limit: int = 3, ttl_ms: int = 3 * 86_400_000) -> DataFrame:
    """``events(event_id, user_id, ts)`` with their number in their user's day and whether it is within the limit; a day's count is
    dropped ``ttl_ms`` after its last event."""
    grouped = events.select("event_id", "user_id", "ts").groupBy("user_id")
    return grouped.transformWithStateInPandas(statefulProcessor=_Daily(limit, ttl_ms), outputStructType="event_id long, user_id long, nth long, allowed boolean", outputMode="Append", timeMode="ProcessingTime")
