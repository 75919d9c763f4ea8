"""The engine as its callers use it."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from palimpsest.facade import Engine
from palimpsest.operators import scoring, search
from palimpsest.plans.answers import _lifted
from palimpsest.streaming import ingest
from tests.test_plans import plan

NOW = dt.datetime(2024, 5, 15, 12)


@pytest.fixture
def memory(spark, tmp_path):
    return Engine(spark, str(tmp_path / "memory"), clock=NOW)


def test_the_readme_example_is_answered(memory):
    assert memory.process("I moved to Oslo last week.", speaker="Ann").stored == 1
    out = memory.process("Where did Ann move to?", speaker="Guest")
    assert out.status == "answered" and not out.answer.refused and "Oslo" in out.answer.text


def test_edges_have_dates_and_speakers(memory):
    memory.process("I moved to Oslo last week.", speaker="Ann")
    memory.process("Bob likes tea.", speaker="Ann")
    memory.process("He bought a car yesterday.", speaker="Ann")
    rows = {r["source_text"]: r for r in memory.store.current().collect()}
    moved, likes, bought = (rows[t] for t in ("I moved to Oslo last week.", "Bob likes tea.", "He bought a car yesterday."))
    assert moved["resolved_event_date"] == dt.datetime(2024, 5, 8) and "Ann" in moved["entities"] and moved["subject"] == "Ann"
    assert likes["resolved_event_date"] == NOW and {"Bob", "Ann"} <= set(likes["entities"])
    # named in the turn before, and no place
    assert bought["subject"] == "Bob" and "Bob" in bought["entities"] and bought["resolved_event_date"] == dt.datetime(2024, 5, 14)


def test_what_was_said_before_is_not_stored_again(spark):
    row = lambda text, h: (1, text, "Ann", "bot", dt.datetime(2024, 5, 1, h), "user")
    schema = "user_id long, text string, speaker string, listener string, ts timestamp_ntz, tag string"
    got = ingest.edges_of(spark.createDataFrame([row("She likes tea.", 2)], schema), spark.createDataFrame([row("Mia moved to Oslo.", 1)], schema)).collect()
    assert [(r["subject"], r["object"]) for r in got] == [("Mia", "tea")]


def test_a_date_ahead_is_due(memory):
    memory.process("Mia visits Rome tomorrow.", speaker="Ann")
    assert [r["resolved_event_date"] for r in memory.check_proactive()] == [dt.datetime(2024, 5, 16)]


def test_no_vector_is_shuffled_by_query(spark, small):
    text = plan(scoring.answered(*_lifted(spark, small)))
    dealt = [part for part in text.split("\n\n") if "Exchange" in part.split("\n")[0] and "hashpartitioning(query_id" in part]
    assert dealt and not any("embedding" in part for part in dealt)


def test_exact_search_of_many_queries_in_little_memory(spark):
    draw = lambda n, seed: spark.range(n).select("id", F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.pmod(F.xxhash64("id", i + seed), F.lit(1000)) / 1000.0).alias("v"))
    vectors = draw(3000, 0).select(F.col("id").alias("vec_id"), F.col("v").alias("embedding"))
    asked = draw(20_000, 7).select(F.col("id").alias("query_id"), F.col("v").alias("query"))
    top = search.top_k_each(vectors, asked, 3)
    text = plan(top)
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    got = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("vec_id", F.struct("score", -F.col("vec_id"))).alias("best"))
    assert got.where("n = 3").count() == 20_000
    import numpy as np

    q = {r["query_id"]: np.array(r["query"]) for r in asked.where("query_id < 5").collect()}
    held = vectors.collect()
    m = np.array([r["embedding"] for r in held])
    best = {r["query_id"]: r["best"] for r in got.where("query_id < 5").collect()}
    for i, v in q.items():
        assert m[best[i]] @ v == pytest.approx((m @ v).max())
