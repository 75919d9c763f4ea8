"""What a store must not lose or put in the wrong order."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from palimpsest import schemas
from palimpsest.operators import graph, search, state, verify
from palimpsest.sources.durable import Written
from palimpsest.sources.store import EdgeStore, numbered
from palimpsest.streaming import context, ingest
from tests.test_plans import plan
from tests.test_state import T0, edges


def moves(spark, rows):
    """rows: (id, day, object); a text each, no place in the order of arrival."""
    return edges(spark, [(i, 1, "Ann", "move_to", o, {"sequence_number": None, "source_timestamp": T0 + dt.timedelta(days=day)}) for i, day, o in rows])


def test_batches_of_two_streams_are_all_kept(spark, tmp_path):
    s = EdgeStore(spark, str(tmp_path / "s"), buckets=2)
    a, b = moves(spark, [(1, 1, "Oslo")]), moves(spark, [(2, 2, "Rome")])
    assert s.append(a, 0, "first") and s.append(b, 0, "second")
    assert not s.append(b, 0, "second")
    assert {r["object"] for r in s.current().collect()} == {"Oslo", "Rome"}


def test_a_batch_that_crashed_before_its_commit_counts_once(spark, tmp_path, monkeypatch):
    s = EdgeStore(spark, str(tmp_path / "s"), buckets=2)
    retired = moves(spark, [(1, 1, "Oslo")]).withColumn("is_current", F.lit(False))
    with monkeypatch.context() as m:
        m.setattr(EdgeStore, "_log", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            s.append(retired, 5, "q")
    assert s.current().count() == 0
    assert s.append(retired, 5, "q")
    (row,) = s.current().collect()
    assert not row["is_current"] and row["sequence_number"] == 1


def test_two_queries_on_one_store_lose_nothing(spark, tmp_path):
    names = [f.name for f in schemas.UTTERANCE.fields]
    for k, city in enumerate(("Oslo", "Rome")):
        (tmp_path / f"in{k}").mkdir()
        (tmp_path / f"in{k}" / "a.json").write_text(json.dumps(dict(zip(names, (k, f"I moved to {city}.", "Ann", "bot", "2024-01-01T10:00:00", "user"), strict=True))))
    store = EdgeStore(spark, str(tmp_path / "store"), buckets=2)
    for k in (0, 1, 0):
        q = ingest.start(ingest.read_utterances(spark, str(tmp_path / f"in{k}")), store, str(tmp_path / f"cp{k}"), available_now=True)
        q.awaitTermination()
    assert sorted(r["object"] for r in store.current().collect()) == ["Oslo", "Rome"]
    assert len(store.current().where("size(pqs) > 0 and pqs[0].embedding is not null").collect()) == 2


def test_state_goes_by_arrival_not_by_id(spark, tmp_path):
    cities = ["Oslo", "Rome", "Bern", "Berlin", "Paris"]
    ids = [77, 3, 91, 50, 12]
    s = EdgeStore(spark, str(tmp_path / "s"), buckets=2)
    s.append(moves(spark, [(i, d, c) for d, (i, c) in enumerate(zip(ids, cities, strict=True))][::-1]))
    got = {r["object"]: r for r in s.current().collect()}
    assert [got[c]["superseded_by"] for c in cities] == [*ids[1:], None]
    assert [got[c]["is_current"] for c in cities] == [False] * 4 + [True]
    assert [r["object"] for r in state.history(s.current(), "Ann", "move_to").collect()] == cities
    # said again, an older value is current again
    s.append(moves(spark, [(200, 30, "Bern")]))
    got = {r["object"]: r for r in s.current().collect()}
    assert got["Bern"]["is_current"] and got["Bern"]["superseded_by"] is None and got["Paris"]["superseded_by"] == 91


def test_compaction_loses_no_confirmation_and_is_read_instead_of_what_it_covers(spark, tmp_path):
    s = EdgeStore(spark, str(tmp_path / "s"), buckets=2)
    users = [(1000 - 7 * u, u) for u in range(40)]
    said = lambda more, day: edges(spark, [(i + more, u, "Ann", "move_to", "Oslo", {"sequence_number": None, "source_timestamp": T0 + dt.timedelta(days=day)}) for i, u in users])
    s.append(said(0, 1))
    s.compact()
    assert s._pending() == []
    s.append(said(-500, 9))
    s.append(said(3000, 12))
    assert len(s._pending()) == 2
    for _ in range(2):
        rows = s.current().collect()
        assert len(rows) == 40 and {r["last_confirmed_at"] for r in rows} == {T0 + dt.timedelta(days=12)}
        assert {r["id"] for r in rows} == {i for i, _ in users}
        s.compact()
    assert s._pending() == []


def test_numbers_follow_time(spark):
    e = moves(spark, [(k * 37 % 101, d, f"c{k}") for k, d in enumerate([5, 3, 9, 1, 1, 4])])
    work = Written(spark)
    rows, n = numbered(work, e, 11)
    got = [(r["sequence_number"], r["source_timestamp"]) for r in rows.orderBy("sequence_number").collect()]
    assert n == 6 and [g[0] for g in got] == list(range(11, 17)) and [g[1] for g in got] == sorted(g[1] for g in got)
    assert numbered(work, e.limit(0), 1)[1] == 0


def test_derived_tables(spark, tmp_path):
    s = EdgeStore(spark, str(tmp_path / "s"), buckets=2)
    e = edges(spark, [(i, 1, "Ann", p, o, {"embedding": [float(i), 1.0], "significance": k}) for i, p, o, k in ((1, "like", "tea", "stative"), (2, "win", "race", "milestone"), (3, "like", "coffee", "stative"))])
    s.append(e)
    s.derive()
    got = {r["id"]: r for r in s.derived("edges").collect()}
    assert {r["cluster_id"] for r in got.values()} == {1} and all(r["arc_id"] is not None for r in got.values())
    assert [r["value"] for r in s.derived("facts").collect()] == ["coffee"]
    assert [r["id"] for r in s.derived("milestones").collect()] == [2]
    assert {r["key"] for r in s.derived("entities").collect()} == {"ann", "tea", "race", "coffee"}
    assert {(r["id"], r["other_id"]) for r in s.derived("ambiguities").collect()} == {(3, 1)}


def test_timers_of_a_stream_fire_once(spark, tmp_path):
    day = lambda d: dt.datetime(2024, 1, d)
    schema = "user_id long, timer_id long, fire_at timestamp, at timestamp"
    batches = [[(1, 1, day(5), day(1)), (1, 2, day(20), day(1))], [(2, 9, day(30), day(6))], [(2, 9, day(8), day(7))], [(3, 1, day(40 - 10), day(25))], [(1, 1, day(9), day(26))]]
    (tmp_path / "in").mkdir()
    q = context.timer_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("timers").option("checkpointLocation", str(tmp_path / "cp")).start()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"b{k}"))
        for f in (tmp_path / f"b{k}").glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{k}.parquet")
        q.processAllAvailable()
    q.stop()
    assert sorted((r["user_id"], r["timer_id"]) for r in spark.table("timers").collect()) == [(1, 1), (1, 2), (2, 9)]


def test_cooldown_of_a_stream_equals_the_batch(spark, tmp_path):
    from palimpsest.operators import entities

    rows = [(i, i % 2, dt.datetime(2024, 1, 1 + i // 9, i % 24)) for i in range(30)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = context.cooldown_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("cool").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda d: sorted(tuple(r) for r in d.select("event_id", F.col("nth").cast("long"), "allowed").collect())
    assert key(spark.table("cool")) == key(entities.cooldown(df))


def test_sql_functions(spark):
    from palimpsest.functions.register import register

    register(spark)
    r = spark.sql("SELECT pal_resolve_date('last monday', timestamp_ntz'2024-01-17 10:30:00') a, pal_proximity(timestamp'2024-01-20 00:00:00', timestamp'2024-01-10 00:00:00') p, pal_humanize(7300D) h, pal_token_f1('the red car', 'a red car') f").first()
    assert (str(r["a"]), r["p"], r["h"], round(r["f"], 4)) == ("2024-01-15 00:00:00", "in 1 week", "2 hours", 0.6667)
    assert [r["object"] for r in spark.sql("SELECT object FROM pal_decompose('I moved to Oslo. She likes tea.', 'Ann', 'bot')").collect()] == ["Oslo", "tea"]


def test_plans_of_search_and_verification(spark, small):
    from palimpsest.plans.answers import _lifted
    from palimpsest.operators import scoring

    e, q = _lifted(spark, small)
    text = plan(scoring.answered(e, q))
    scans = lambda t: sum(line.startswith("(") and "Scan parquet" in line for line in t.split("\n"))
    assert scans(text) <= 5 and text.count("Window") <= 12
    facts = spark.createDataFrame([(1, 1, "a", "p", "")], "fact_id long, user_id long, entity string, predicate string, object string")
    keys = plan(verify.supporting(edges(spark, [(1, 1, "a", "p", "b")]), facts))
    assert "__name" in keys and "CartesianProduct" not in keys
    v = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(50)], "vec_id long, embedding array<double>")
    asked = v.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    top = search.top_k_each(v, asked, 4)
    assert "CartesianProduct" not in plan(top) and "NestedLoop" not in plan(top) and top.count() == 12
    empty = graph.components(edges(spark, [(1, 1, "a", "p", "b")]).limit(0))
    assert empty.count() == 0 and search.top_k_each(v, asked.limit(0), 4).count() == 0
