"""Texts taken apart, spans of time, taxonomies, and states that replace each other."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import temporal
from palimpsest.operators import grammar, replay, state, taxonomy
from palimpsest.sources.store import EdgeStore
from tests.test_plans import plan
from tests.test_state import T0, edges

SAID = {
    "I can't stand mushrooms.": ("Ann", "stand", "mushrooms", True, "present"),
    "After the concert we grabbed tacos.": ("Ann", "grab", "tacos", False, "past"),
    "She adopted a dog.": ("She", "adopt", "dog", False, "past"),
    "Bob gave Alice his old guitar.": ("Bob", "give", "his old guitar", False, "past"),
    "My boss promoted me in March 2023.": ("Ann's boss", "promote", "Ann", False, "past"),
    "I moved to Oslo last week.": ("Ann", "move_to", "Oslo", False, "past"),
    "When she arrived, I left the party.": ("Ann", "leave", "party", False, "past"),
    "Ann is happy about the trip.": ("Ann", "be", "happy", False, "present"),
    "Bob doesn't like tea and he hates coffee.": ("Bob", "like", "tea", True, "present"),
    "We are going to visit Rome.": ("Ann", "visit", "Rome", False, "future"),
    "The man in the hat smiled at Eve.": ("man", "smile_at", "Eve", False, "past"),
}


def test_sentences_come_out_right(spark):
    df = spark.createDataFrame([(t, "Ann", "bot", 1) for t in SAID] + [("", "Ann", "bot", 1), (None, None, None, 1), ("...", "Ann", "bot", 1)], "text string, speaker string, listener string, row_ int")
    got = {r["source_text"]: (r["subject"], r["predicate"], r["object"], r["negated"], r["tense"]) for r in grammar.decomposed(df).collect()}
    assert got == SAID


def test_a_text_of_several_sentences_and_repeated_rows(spark):
    df = spark.createDataFrame([("I like tea. You sold it! Do they know?", "Ann", "bot")] * 2, "text string, speaker string, listener string")
    rows = grammar.decomposed(df).collect()
    assert sorted((r["sentence"], r["subject"], r["predicate"], r["mood"]) for r in rows) == sorted([(0, "Ann", "like", "indicative"), (1, "bot", "sell", "indicative"), (2, "they", "know", "interrogative")] * 2)
    text = plan(grammar.decomposed(df))
    assert "EvalPython" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_a_lexicon_can_be_given(spark):
    df = spark.createDataFrame([("The zorks glimmed a blarg.", "Ann", "bot")], "text string, speaker string, listener string")
    verbs = spark.createDataFrame([("glim", "motion")], "lemma string, sense string")
    (r,) = grammar.decomposed(df, verbs_=verbs).collect()
    assert (r["subject"], r["predicate"], r["object"], r["verb_class"]) == ("zorks", "glim", "blarg", "EXPERIENCE")


@pytest.mark.parametrize(
    ("said", "spans", "date"),
    [
        ("It was 3 weeks ago, on 5 March 2023.", ["3 weeks ago", "5 March 2023"], dt.datetime(2024, 4, 24)),
        ("It was in June 2022, on 5 March 2023.", ["June 2022", "5 March 2023"], dt.datetime(2023, 3, 5)),
        ("Yesterday and next Monday", ["Yesterday", "next Monday"], dt.datetime(2024, 5, 14)),
        ("We waited for 2 days in 2020.", ["2 days", "2020"], dt.datetime(2020, 1, 1)),
        ("nothing of it", [], None),
        ("", [], None),
        ("2019 May 3rd, 2021", ["2019", "May 3rd, 2021"], dt.datetime(2021, 5, 3)),
    ],
)
def test_spans_of_time(spark, said, spans, date):
    r = spark.createDataFrame([(said,)], "s string").select(temporal.date_spans(F.col("s")).alias("x"), temporal.event_date(F.col("s"), F.lit("2024-05-15 12:00:00").cast("timestamp_ntz")).alias("d")).first()
    assert [x["span"] for x in r["x"]] == spans
    assert all(said[x["start"] : x["end"]] == x["span"] for x in r["x"])
    assert r["d"] == date


def test_closures_have_least_depths(spark):
    dag = spark.createDataFrame([("dog", "pet"), ("dog", "canine"), ("canine", "animal"), ("pet", "animal"), ("animal", "thing"), ("dog", "thing"), ("dog", "dog"), ("dog", None), ("pet", "animal"), ("cat", "pet"), ("a", "b"), ("b", "a")], "child string, parent string")
    closed = taxonomy.closure(dag)
    got = {(r["node"], r["ancestor"]): r["depth"] for r in closed.collect()}
    assert got["dog", "thing"] == 1 and got["dog", "animal"] == 2 and got["cat", "thing"] == 3 and got["a", "b"] == 1 and got["a", "a"] == 0 and ("thing", "dog") not in got
    assert len(got) == closed.count()
    anchors = spark.createDataFrame([("animal", "LIVING"), ("thing", "THING"), ("pet", "FRIEND")], "anchor string, label string")
    assert {r["node"]: r["label"] for r in taxonomy.nearest(closed, anchors).collect()} == {"dog": "FRIEND", "cat": "FRIEND", "pet": "FRIEND", "canine": "LIVING", "animal": "LIVING", "thing": "THING"}
    pairs = spark.createDataFrame([("dog", "cat"), ("dog", "a"), ("cat", "cat"), ("dog", "cat")], "a string, b string")
    assert sorted((r["a"], r["b"], round(r["similarity"], 4)) for r in taxonomy.similarity(closed, pairs).collect()) == [("cat", "cat", 1.0), ("dog", "a", 0.0), ("dog", "cat", 0.3333), ("dog", "cat", 0.3333)]
    assert taxonomy.closure(dag.limit(0)).count() == 0


@pytest.mark.parametrize("row", [8])
def test_a_closure_by_levels_is_that_by_rounds(spark, monkeypatch, row):
    """Leaves over leaves, a chain, a cycle that is not peeled off, and nodes with more wider terms than a row holds."""
    monkeypatch.setattr(taxonomy, "ROW", row)
    wide = [(f"n{i}", f"n{i // k}") for i in range(1, 200) for k in (3, 5)] + [(f"leaf{i}", f"p{j}") for i in range(40) for j in range(12)] + [(f"p{j}", "n120") for j in range(12)]
    odd = [("a", "b"), ("b", "c"), ("c", "a"), ("n3", "a"), ("leaf3", "c"), *[(f"c{i}", f"c{i + 1}") for i in range(4)]]
    dag = spark.createDataFrame(wide + odd, "child string, parent string")
    peeled = taxonomy.Peeled(dag)
    assert peeled.levels and peeled.core.where("node <> ancestor").count() > 0
    links = dag.where("child <> parent").distinct()
    nodes = links.selectExpr("child AS node").union(links.selectExpr("parent AS node")).distinct()
    closed = taxonomy._rounds(nodes, links, 100)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(taxonomy.closure(dag)) == rows(closed)
    assert rows(taxonomy.closure(dag, 3)) == rows(closed.where("depth <= 3"))
    anchors = spark.createDataFrame([(f"n{i}", f"kind {i}") for i in (2, 3, 4, 5, 199)] + [("c", "cycle"), ("c4", "chain")], "anchor string, label string")
    assert rows(taxonomy.nearest_in(peeled, anchors)) == rows(taxonomy.nearest(closed, anchors))
    pairs = spark.createDataFrame([(f"n{i}", f"n{j}") for i in range(0, 200, 7) for j in range(3, 200, 11)] + [("leaf1", "n7"), ("n7", "leaf3"), ("leaf1", "leaf1"), ("none", "none"), (None, "n1"), ("a", "leaf3"), ("c0", "c3"), ("leaf1", "c0"), ("n7", "leaf3")], "a string, b string")
    assert rows(taxonomy.similarity_in(peeled, pairs).select("a", "b", "similarity")) == rows(taxonomy.similarity(closed, pairs).select("a", "b", "similarity"))


def test_a_leaf_goes_through_no_rounds(spark, monkeypatch):
    """Work follows the closure's size: what rounds are given is the few nodes that have narrower ones at every level."""
    given, rounds = [], taxonomy._rounds
    monkeypatch.setattr(taxonomy, "_rounds", lambda nodes, links, depth: given.append(nodes.count()) or rounds(nodes, links, depth))
    dag = spark.range(1, 4000).selectExpr("id AS child", "id div 4 AS parent")
    assert taxonomy.closure(dag).where("depth = 0").count() == 4000 and given == [1]


def test_the_built_in_lists_as_a_taxonomy(spark):
    dag = taxonomy.built_in(spark)
    closed = taxonomy.closure(dag)
    kinds = {r["node"]: r["label"] for r in taxonomy.nearest(closed, taxonomy.anchors_of(dag, "class:")).collect()}
    types = {r["node"]: r["label"] for r in taxonomy.nearest(closed, taxonomy.anchors_of(dag, "type:")).collect()}
    assert kinds["buy"] == "POSSESSION" and kinds["move"] == "LOCATION" and types["river"] == "LOCATION" and types["boss"] == "PERSON"


def test_a_new_residence_replaces_the_old_one(spark, tmp_path):
    store = EdgeStore(spark, str(tmp_path / "s"), buckets=2)
    more = lambda d: {"sequence_number": None, "source_timestamp": T0 + dt.timedelta(days=d)}
    store.append(edges(spark, [(1, 1, "Ann", "move_to", "Oslo", more(1)), (2, 1, "Ann", "like", "tea", more(2)), (3, 1, "Ann", "live_in", "Paris", more(3)), (4, 1, "Ann", "love", "milk", more(4)), (5, 2, "Ann", "live_in", "Rome", more(5))]))
    got = {r["id"]: (r["is_current"], r["superseded_by"]) for r in store.current().collect()}
    assert got == {1: (False, 3), 2: (True, None), 3: (True, None), 4: (True, None), 5: (True, None)}


def test_versions_answer_as_of_a_checkpoint(spark):
    writes = edges(spark, [(1, 1, "Ann", "live_in", "Oslo"), (2, 1, "Ann", "live_in", "Rome"), (3, 1, "Ann", "live_in", "Oslo", {"source_text_hash": "AnnlIve"}), (4, 1, "Ann", "like", "tea", {"tombstoned_at": T0})])
    again = edges(spark, [(9, 1, "Ann", "live_in", "Oslo", {"sequence_number": 9})])
    asked = spark.createDataFrame([(q, 1, q) for q in (0, 1, 2, 3, 9)], "query_id long, user_id long, checkpoint long")
    got: dict[int, dict] = {}
    for r in replay.as_of(replay.versions(writes.unionByName(again)), asked).collect():
        got.setdefault(r["query_id"], {})[r["id"]] = r["current"]
    assert got == {1: {1: True}, 2: {1: False, 2: True}, 3: {1: False, 2: False, 3: True}, 9: {1: True, 2: False, 3: True}}
    rates = replay.pass_rates(spark.createDataFrame([(1, True), (1, False), (2, True)], "checkpoint long, passed boolean")).orderBy("checkpoint").collect()
    assert [(r["n"], r["passed"], round(r["cumulative_rate"], 4)) for r in rates] == [(2, 1, 0.5), (1, 1, 0.6667)]


def test_facts_of_one_state_are_one(spark):
    rows = edges(spark, [(1, 1, "Ann", "move_to", "Oslo", {"schematic": "x"}), (2, 1, "Ann", "live_in", "Rome", {"schematic": "x"})])
    (f,) = state.facts(rows).collect()
    assert (f["value"], f["changes"]) == ("Rome", 1)


def test_assertions_hold_of_a_store_and_find_what_is_planted(spark, tmp_path):
    from palimpsest.operators import assertions

    store = EdgeStore(spark, str(tmp_path / "s"), buckets=2)
    more = lambda d: {"sequence_number": None, "source_timestamp": T0 + dt.timedelta(days=d)}
    store.append(edges(spark, [(i, i % 3, "Ann", "live_in", f"city{i % 4}", more(i)) for i in range(24)]))
    store.forget(1, "entity", "city2", F.lit(T0).cast("timestamp_ntz"))
    assert {r["constraint"]: r["n"] for r in assertions.violations(store.current()).collect()} == {c.name: 0 for c in assertions.EDGES}
    bad = edges(spark, [(1, 1, "Ann", "live_in", "Oslo", {"superseded_by": 99}), (2, 1, "Ann", "live_in", "Rome", {"superseded_by": 3}), (3, 2, "Bob", "", "Rome"), (3, 2, "Bob", "like", "tea", {"is_current": False}), (4, 1, "Ann", "move_to", "Oslo", {"first_learned_at": T0, "last_confirmed_at": T0 - dt.timedelta(days=1)})])
    got = {r["constraint"]: (r["n"], r["examples"]) for r in assertions.violations(bad, examples=2).collect() if r["n"]}
    assert got == {"has_subject_and_predicate": (1, [3]), "confirmed_after_learned": (1, [4]), "retired_has_successor": (1, [3]), "one_row_an_id": (2, [3]), "one_current_value": (3, [1, 2]), "successor_exists": (1, [1]), "successor_of_same_user": (1, [2])}
    assert {r["n"] for r in assertions.violations(bad.limit(0)).collect()} == {0}


def test_tokens_are_not_shuffled(spark):
    df = spark.createDataFrame([("I gave Alice his guitar last week. She sings!", "Ann"), ("He left", "Bob"), (None, "Bob")], "text string, speaker string")
    told = grammar.decomposed(df)
    # only sentences are dealt out, before they are cut: no exchange serves a window, a grouping or a join of tokens
    assert "hashpartitioning(" in plan(told) and not [x for x in plan(told).splitlines() if "hashpartitioning(" in x and "ENSURE_REQUIREMENTS" in x]
    assert [(r["speaker"], r["sentence"], r["source_text"], r["object"]) for r in told.orderBy("speaker", "sentence").collect()][:2] == [("Ann", 0, "I gave Alice his guitar last week.", "his guitar last week")] + [("Ann", 1, "She sings!", "")]
