"""Keyed state in RocksDB: equal to the batch twins, over restarts, with time to live."""

from __future__ import annotations

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import enrich, entities
from palimpsest.streaming import stateful

TOLD = "user_id long, turn long, subject string, entities array<string>, speaker string"


@pytest.fixture(autouse=True)
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stateful.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def put(spark, tmp_path, rows, schema, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))


def run(spark, tmp_path, made, schema, name, expected):
    """The sink's rows once there are ``expected``; the query is stopped then, and begins anew the next time. (With state that has a
    time to live a query always has another batch to run, so it does not end by itself.)"""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / f"out-{name}")
    rows = made(source)
    read = lambda: spark.read.schema(rows.schema).parquet(out)
    q = rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(processingTime="200 milliseconds").start(out)
    until = time.time() + 60
    while time.time() < until and q.exception() is None:
        time.sleep(0.5)
        if (tmp_path / f"out-{name}" / "_spark_metadata").exists() and read().count() >= expected:
            break
    q.stop()
    return read()


def test_people_equal_the_batch_over_a_restart(spark, tmp_path):
    names = ["Ann", "Bob", "Cy"]
    rows = [(u, t, ["He", "Ann", "she", "Bob"][(t + u) % 4], [names[(t * 7 + u) % 3]] if t % 3 else None, names[u]) for t in range(12) for u in range(3)]
    for lo in (0, 5):
        part = [r for r in rows if lo <= r[1] < lo + 5] if lo == 0 else [r for r in rows if r[1] >= 5]
        put(spark, tmp_path, part, TOLD, "in")
        got = run(spark, tmp_path, lambda s: stateful.people_stream(s, look=4), TOLD, "p", 15 if lo == 0 else 36)  # the query starts anew each time
    key = lambda d: sorted((r["user_id"], r["turn"], r["subject"], list(r["entities"])) for r in d.collect())
    assert key(got) == key(enrich.with_people(spark.createDataFrame(rows, TOLD), look=4))


def test_state_is_forgotten_after_its_time(spark, tmp_path):
    put(spark, tmp_path, [(1, 1, "Ann", ["Bob"], "Ann")], TOLD, "in")
    made = lambda s: stateful.people_stream(s, ttl_ms=1500)
    run(spark, tmp_path, made, TOLD, "t", 1)
    time.sleep(3)
    put(spark, tmp_path, [(1, 2, "He", [], "Ann")], TOLD, "in")
    assert {(r["turn"], r["subject"]) for r in run(spark, tmp_path, made, TOLD, "t", 2).collect()} == {(1, "Ann"), (2, "He")}


def test_daily_counts_equal_the_batch_over_a_restart(spark, tmp_path):
    schema = "event_id long, user_id long, ts timestamp"
    rows = [(i, i % 2, dt.datetime(2024, 1, 1 + i // 9, i % 24)) for i in range(30)]
    for part, expected in ((rows[:14], 14), (rows[14:], 30)):
        put(spark, tmp_path, part, schema, "in")
        got = run(spark, tmp_path, stateful.daily_stream, schema, "d", expected)
    key = lambda d: sorted(tuple(r) for r in d.select("event_id", F.col("nth").cast("long"), "allowed").collect())
    assert key(got) == key(entities.cooldown(spark.createDataFrame(rows, schema)))
