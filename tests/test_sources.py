from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from palimpsest import schemas
from palimpsest.facade import Answer, Engine, Outcome, Situation, dispatch, plain
from palimpsest.operators import dataset, entities
from palimpsest.sources import files
from palimpsest.sources.store import EdgeStore
from palimpsest.streaming import context, ingest
from tests.test_state import T0, edges


def test_store_appends_forgets_and_compacts(spark, tmp_path):
    s = EdgeStore(spark, str(tmp_path / "store"), buckets=4)
    assert s.current().count() == 0
    assert s.append(edges(spark, [(1, 1, "a", "p", "x"), (2, 1, "a", "p", "y"), (3, 2, "a", "p", "x")]), batch_id=1)
    assert not s.append(edges(spark, [(9, 1, "z", "p", "x")]), batch_id=1)
    assert s.current(1).count() == 2
    now = F.lit("2024-02-01 00:00:00")
    assert s.forget(1, "entity", "x", now) == 1
    assert s.forget(1, "entity", "x", now) == 0
    s.compact()
    s.append(edges(spark, [(20, 1, "a", "p", "y"), (21, 1, "b", "p", "w")]))
    got = {r["id"]: r for r in s.current(1).collect()}
    assert set(got) == {1, 2, 21}
    assert got[1]["tombstoned_at"] is not None and got[1]["tombstone_reason"] == "by_entity:x"
    assert got[2]["last_confirmed_at"] == T0 + dt.timedelta(hours=20)
    assert got[1]["superseded_by"] == 2 and not got[1]["is_current"] and got[2]["is_current"]
    assert s.current(2).count() == 1
    filled = s.backfill({"cluster_id": F.lit(7).cast("long")})
    assert {r["cluster_id"] for r in filled.collect()} == {7}


def test_a_users_read_prunes_to_its_bucket(spark, tmp_path):
    s = EdgeStore(spark, str(tmp_path / "store"), buckets=4)
    s.append(edges(spark, [(i, i % 9, "a", "p", f"o{i}") for i in range(30)]))
    df = s._read(schemas.EDGE, s._pending(), 3)
    assert "PartitionFilters: [isnotnull(user_bucket" in df._jdf.queryExecution().toString()


def test_jsonl_keeps_broken_lines_and_skips_blank_ones(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{broken\n{"a": 2}\n')
    df = files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a long, _corrupt_record string").cache()
    assert sorted(r["a"] for r in df.where("_corrupt_record is null").collect()) == [1, 2]
    assert df.where("_corrupt_record is not null").count() == 1
    files.write_jsonl(df.select("a"), str(tmp_path / "out"))
    files.write_jsonl(df.select("a"), str(tmp_path / "out"), append=True)
    assert files.read_jsonl(spark, str(tmp_path / "out")).count() in (4, 6)


def test_stories(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "s.yaml").write_text("story_id: 7\ntitle: T\nbatches:\n- batch: 1\n  time: now\n  user_input: hi\nquestions:\n- question: who?\n  expected_contains: ann\n")
    (s,) = files.read_stories(spark, str(tmp_path)).collect()
    assert (s["story_id"], s["batches"][0]["user_input"], s["questions"][0]["expected_contains"]) == (7, "hi", ["ann"])
    files.write_report(spark.range(2), spark.range(1), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report/items")).count() == 2


SHAPES = [
    ("messages array<struct<role:string,content:string>>", ([("user", "hello there"), ("assistant", "hi")],)),
    ("conversations array<struct<from:string,value:string>>", ([("human", "hello there"), ("gpt", "hi")],)),
    ("conversation string", (json.dumps([{"role": "user", "content": "hello there"}, {"role": "assistant", "content": "hi"}]),)),
    ("role string, text string", ("user", "hello there")),
    ("dialog array<string>", (["hello there", "hi"],)),
    ("persona array<string>", (["hello there", " "],)),
    ("utterance string", ("hello there",)),
]


@pytest.mark.parametrize(("schema", "row"), SHAPES)
def test_seven_shapes_of_import(spark, schema, row):
    got = dataset.imported(spark.createDataFrame([row], schema)).collect()
    assert "hello there" in {r["source_text_raw"] for r in got}
    assert all(r["candidate_id"].startswith("c_") and len(r["candidate_id"]) == 14 for r in got)


def test_validation_names_what_is_wrong(spark):
    schema = "id string, source_text string, clean_text string, facts array<struct<subject:string,predicate:string,object:string>>"
    rows = spark.createDataFrame([("1", "a", "a", [("u", "likes", "x")]), ("2", None, "a", [("u", "flies", "x")]), ("3", "a", "a", None)], schema)
    good, bad = dataset.quarantined(rows, dataset.PREDICATES)
    assert [r["id"] for r in good.collect()] == ["1"]
    assert {r["id"]: r["problems"] for r in bad.collect()} == {"2": ["missing:source_text", "predicate:flies"], "3": ["missing:facts"]}


def test_samples_do_not_depend_on_partitions(spark):
    rows = spark.range(100).select(F.col("id").cast("string").alias("candidate_id"))
    pick = lambda df: [r[0] for r in dataset.sample(df, 7, 3).collect()]
    assert pick(rows.repartition(1)) == pick(rows.repartition(9))


def test_stream_writes_each_batch_once_and_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    said = [(1, "I moved to Oslo.", "Ann", "bot", "2024-01-01T10:00:00", "user"), (1, "yeah", "Ann", "bot", "2024-01-01T10:01:00", "user"), (2, "My sister works at Acme.", "Bob", "bot", "2024-01-01T10:02:00", "user")]
    names = [f.name for f in schemas.UTTERANCE.fields]
    for k, row in enumerate(said):
        (folder / f"{k}.json").write_text(json.dumps(dict(zip(names, row, strict=True))))
    store = EdgeStore(spark, str(tmp_path / "store"), buckets=2)
    for _ in range(2):
        q = ingest.start(ingest.read_utterances(spark, str(folder), 1), store, str(tmp_path / "cp"), available_now=True)
        q.awaitTermination()
    batch = ingest.edges_of(spark.read.schema(schemas.UTTERANCE).json(str(folder)))
    key = lambda df: sorted((r["user_id"], r["subject"], r["predicate"], r["object"]) for r in df.select("user_id", "subject", "predicate", "object").collect())
    assert key(store.current()) == key(batch)
    assert len(key(batch)) == 2


def test_context_stream_equals_the_batch_window(spark, tmp_path):
    rows = [(u, t, f"said {u} {t}") for u in (1, 2) for t in range(14)]
    df = spark.createDataFrame(rows, "user_id long, turn long, text string")
    df.coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).json(str(tmp_path / "in"))
    q = context.context_stream(stream).writeStream.format("memory").queryName("ctx").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["user_id"], r["turn"]): list(r["context"]) for r in spark.table("ctx").collect()}
    want = {(r["user_id"], r["turn"]): list(r["context"]) for r in entities.context_window(df).collect()}
    assert got == want


def test_timers_fire_once(spark):
    timers = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), None), (2, dt.datetime(2024, 3, 1), None)], "id long, fire_at timestamp_ntz, fired boolean")
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    assert [r["id"] for r in context.due(timers, now).collect()] == [1]
    assert context.due(context.fired(timers, now), now).count() == 0


def test_engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "mem"), 5, clock=dt.datetime(2024, 1, 10))
    assert e.process("  ").status == "skipped"
    assert e.process("yeah").status == "skipped"
    done = e.process("I moved to Oslo.", speaker="Ann")
    assert done == Outcome("stored", 1)
    assert e.ingest("My sister works at Acme.", speaker="Ann", model_response="You like Bergen.", llm_id="m1") >= 1
    assert e.extract("I moved to Oslo.")[0]["predicate"] == "move_to"
    assert {r["object"] for r in e.show("time")} >= {"Oslo"}
    assert "source_text" not in e.show("time")[0].asDict()
    assert [r["object"] for r in e.trace("Ann", "move_to")] == ["Oslo"]
    answer = e.retrieve("I moved to Oslo.")
    assert isinstance(answer.text, str)
    assert "Oslo" in e.situation("Tell me about Oslo").text
    assert e.ingest("I moved to Paris.", speaker="Ann", at=dt.datetime(2024, 1, 11)) == 1
    assert {r["object"]: r["is_current"] for r in e.trace("Ann", "move_to")} == {"Oslo": False, "Paris": True}
    assert e._question("How angry did my sister feel?").first()["match_schema"] == "family"
    asked = e.process("Where did Ann move to?", speaker="Guest")
    assert asked.status in ("answered", "situation")
    quiet = Engine(spark, str(tmp_path / "mem"), 5, explicit_only=True)
    assert isinstance(quiet.retrieve("Describe Oslo"), Answer) and isinstance(quiet.retrieve("Give me a summary of Oslo"), Situation)
    assert e.process("Please forget Oslo", speaker="Ann").status == "forgot"
    assert "Oslo" not in {r["object"] for r in e.show("time")}
    assert all(c["status"] == "ok" for c in e.status())
    p = e.profile()
    assert p["initiative"] == 0.5 and p["warmth"] != 0.5 and abs(p["warmth"] - 0.5) < 0.05 and e.check_proactive() == []
    assert dispatch(e, "tools/list")["tools"]
    assert dispatch(e, "tools/call", {"name": "nothing"})["error"]["code"] == -32601
    assert json.dumps(plain(dispatch(e, "tools/call", {"name": "show", "arguments": {"facet": "time"}})))
    assert e.clear() >= 1 and e.show("time") == []


def test_windowed_activity_of_a_stream_equals_the_batch(spark, tmp_path):
    rows = [(1, "a", "x", "y", dt.datetime(2024, 1, 1, h), "user") for h in (1, 5, 23)] + [(1, "b", "x", "y", dt.datetime(2024, 1, 9), "user")]
    df = spark.createDataFrame(rows, schemas.UTTERANCE)
    df.coalesce(1).write.json(str(tmp_path / "in"))
    q = ingest.activity(ingest.read_utterances(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("act").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda d: sorted((r["user_id"], r["window"]["start"], r["n"]) for r in d.collect())
    assert key(spark.table("act")) == key(ingest.activity(df)) and len(key(ingest.activity(df))) == 2
