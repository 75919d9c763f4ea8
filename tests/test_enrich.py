from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import enrich


def test_third_person_subjects_become_the_last_person_named(spark):
    rows = spark.createDataFrame([(1, 1, "Ann", ["Bob", "Cy"], "Ann"), (1, 2, "He", [], "Ann"), (1, 3, "Ann", None, "Ann"), (2, 1, "she", [], "Dee")], "user_id long, turn long, subject string, entities array<string>, speaker string")
    got = {(r["user_id"], r["turn"]): (r["subject"], r["entities"]) for r in enrich.with_people(rows).collect()}
    assert got[1, 2] == ("Cy", ["Cy", "Ann"])
    assert got[2, 1] == ("she", ["Dee"])
    assert got[1, 1] == ("Ann", ["Bob", "Cy", "Ann"])


def test_entity_types_from_evidence(spark):
    gazetteer = spark.createDataFrame([("oslo", "GPE"), ("oslo university", "ORG"), ("ann", "PERSON"), ("nile", "PERSON")], "entry string, label string")
    names = spark.createDataFrame([("Oslo",), ("Oslo University",), ("Ann",), ("Nile river",), ("green car",), ("zork",), ("",)], "name string")
    got = {r["name"]: (r["entity_type"], r["type_confidence"]) for r in enrich.typed(names, gazetteer).collect()}
    assert got == {"Oslo": ("LOCATION", "high"), "Oslo University": ("ORG", "high"), "Ann": ("PERSON", "high"), "Nile river": ("LOCATION", "high"), "green car": ("PRODUCT", "high"), "zork": ("GENERIC", "low"), "": ("GENERIC", "low")}


def test_questions_by_transformation(spark):
    row = spark.createDataFrame([("Ann", "live_in", "Oslo", "since 2020")], "subject string, predicate string, object string, temporal_expression string")
    assert row.select(enrich.transformed_questions().alias("q")).first()["q"] == ["Who lives in Oslo?", "What does Ann live in?", "When did Ann live in?", "Where does Ann live?", "Does Ann live in Oslo?"]


@pytest.mark.parametrize(("q", "slot"), [("Who came?", "subject"), ("What did he buy?", "object"), ("When was it?", "time"), ("Why?", "fact"), ("Is it so?", "truth")])
def test_slots(spark, q, slot):
    assert spark.range(1).select(enrich.slots(F.lit(q)).alias("s")).first()["s"] == slot
