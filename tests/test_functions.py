from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import embed, temporal, text, vector
from palimpsest.functions.register import register
from palimpsest.operators import analyze, verify


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


NTZ = lambda s: F.lit(s).cast("timestamp_ntz")


@pytest.mark.parametrize(
    ("days", "said"),
    [(0.01, "right now"), (0.5, "today"), (-0.5, "earlier today"), (1.5, "tomorrow"), (-1.5, "yesterday"), (2.5, "in 2 days"), (3.5, "in 4 days"), (-5.2, "5 days ago"), (7.0, "in 1 week"), (-21, "3 weeks ago"), (31, "in 1 month"), (-90, "3 months ago"), (400, "in 1 year"), (-800, "2 years ago")],
)
def test_proximity(spark, days, said):
    at = dt.datetime(2024, 1, 1) + dt.timedelta(days=days)
    assert one(spark, temporal.proximity(F.lit(at).cast("timestamp_ntz"), NTZ("2024-01-01 00:00:00"))) == said


@pytest.mark.parametrize(("seconds", "said"), [(5, "just now"), (61, "1 minute"), (7200, "2 hours"), (86400, "1 day"), (1209600, "2 weeks"), (5184000, "2 months")])
def test_humanize(spark, seconds, said):
    assert one(spark, temporal.humanize(F.lit(float(seconds)))) == said


def test_staleness_of_the_unknown_and_the_future_is_1(spark):
    now = NTZ("2024-01-31 00:00:00")
    assert one(spark, temporal.staleness(F.lit(None).cast("timestamp_ntz"), now)) == 1
    assert one(spark, temporal.staleness(NTZ("2024-02-02 00:00:00"), now)) == 1
    assert one(spark, temporal.staleness(NTZ("2024-01-01 00:00:00"), now)) == pytest.approx(np.exp(-1))


def test_a_day_that_does_not_exist_is_no_date_or_its_month(spark):
    got = one(spark, temporal.resolve_date(F.lit("31 february 2023"), NTZ("2024-01-17 00:00:00")))
    assert got is None or (got.year, got.month) == (2023, 2)


def test_most_specific_date_wins_and_the_first_of_equals(spark):
    dates = F.array(NTZ("2023-01-01 00:00:00"), NTZ("2023-05-01 00:00:00"), NTZ("2023-05-07 00:00:00"), NTZ("2023-06-08 00:00:00"))
    assert one(spark, temporal.most_specific(dates)) == dt.datetime(2023, 5, 7)


def test_session_timestamp(spark):
    assert one(spark, temporal.session_timestamp(F.lit("1:56 pm on 8 May, 2023"))) == dt.datetime(2023, 5, 8, 13, 56)
    assert one(spark, temporal.session_timestamp(F.lit("soon"))) is None


def test_to_datetime(spark):
    now = NTZ("2024-01-17 00:00:00")
    assert one(spark, temporal.to_datetime(F.lit("2024-03-01T10:00:00Z"), now)) == dt.datetime(2024, 3, 1, 10)
    assert one(spark, temporal.to_datetime(F.lit("yesterday"), now)) == dt.datetime(2024, 1, 16)


@pytest.mark.parametrize(("span", "before", "is_length"), [("two weeks", None, True), ("two weeks ago", None, False), ("last week", None, False), ("monday", "for", True), ("hours", None, False)])
def test_durations_are_no_dates(spark, span, before, is_length):
    assert one(spark, temporal.is_duration(F.lit(span), F.lit(before).cast("string") if before else None)) is is_length


def test_dot_uses_the_shorter_length_and_cosine_of_nothing_is_0(spark):
    a, b = F.array(*map(F.lit, [1.0, 2.0, 3.0])), F.array(*map(F.lit, [4.0, 5.0]))
    assert one(spark, vector.dot(a, b)) == 14
    assert one(spark, vector.cosine(a, F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)))) == 0
    assert one(spark, vector.norm(vector.lifted(vector.unit(a)))) == pytest.approx(1)


def test_hash_vector_is_deterministic_and_of_unit_length(spark):
    v = embed.hash_vector("hello")
    assert np.linalg.norm(v) == pytest.approx(1, abs=1e-6)
    df = spark.createDataFrame([("hello",), (None,), ("hello",)], "t string").select(embed.embedder()(F.col("t")).alias("e"))
    rows = [r["e"] for r in df.collect()]
    assert rows[1] is None and np.allclose(rows[0], v) and rows[0] == rows[2]
    assert embed.decode_vector(b"") is None
    assert embed.decode_vector(np.array([1.5, 2.0], dtype="<f4").tobytes()) == [1.5, 2.0]


def test_direction_breaks_ties_in_order(spark):
    s = {k: F.lit(v) for k, v in {"past": 0.5, "future": 0.5, "present": 0.1, "ongoing": 0.2}.items()}
    assert one(spark, embed.direction(s)) == "past"


@pytest.mark.parametrize(("word", "lemma"), [("studied", "study"), ("agreed", "agreed"), ("worked", "work"), ("watches", "watch"), ("runs", "run"), ("miss", "miss")])
def test_verb_lemma(spark, word, lemma):
    assert one(spark, text.verb_lemma(F.lit(word))) == lemma


def test_normalised(spark):
    assert one(spark, text.normalised(F.lit("  The_Big  Dog's!! "))) == "the big dogs"
    assert one(spark, text.normalised(F.lit(None).cast("string"))) == ""


def test_sql_functions(spark):
    names = register(spark)
    assert "pal_cosine" in names
    r = spark.sql("select pal_cosine(array(1D, 0D), array(1D, 1D)) c, pal_normalised('A_b!') n, size(pal_embed('x')) e").first()
    assert r["c"] == pytest.approx(2**-0.5) and r["n"] == "a b" and r["e"] == 384


def test_implied_fact(spark):
    got = one(spark, verify.implied(F.lit("Who went home and who likes green apples?")))
    assert tuple(got) == ("like", "green apples")
    assert one(spark, verify.implied_fact(F.lit("Ann"), F.lit("like"), F.lit(""))) == "Ann like"
    assert one(spark, verify.compound_parts(F.lit("Ann, Bob and Cy"))) == ["Ann", "Bob", "Cy"]


def test_verified_queries_have_two_places(spark):
    have = F.array(F.lit("Who came?"))
    assert one(spark, verify.with_verified_query(have, F.lit("who came"))) == ["Who came?"]
    assert one(spark, verify.with_verified_query(have, F.lit("Who left?"))) == ["Who came?", "Who left?"]
    assert len(one(spark, verify.with_verified_query(F.array(F.lit("a"), F.lit("b")), F.lit("c")))) == 2


@pytest.mark.parametrize(("q", "kind"), [("How many dogs?", "quantity"), ("When was it?", "temporal"), ("Who is he?", "person"), ("Is it so?", "yes_no"), ("Why not?", "reason")])
def test_question_type(spark, q, kind):
    assert one(spark, verify.question_type(F.lit(q))) == kind


def test_cleaning(spark):
    assert one(spark, analyze.stripped(F.lit("Um, well, you know, I bought a car."))) == "I bought a car."
    assert one(spark, analyze.stripped(F.lit("I like it. Never mind."))) == ""
    assert one(spark, analyze.needs_correction(F.lit("I ran."), F.lit("I ran."))) is False


def test_rules_decompose_a_sentence():
    (r,) = analyze.rules("I moved to Oslo last week.", "Ann", "bot")
    assert (r["subject"], r["predicate"], r["object"]) == ("Ann", "move_to", "Oslo")
    assert (r["tense"], r["temporal_expression"], r["entities"], r["negated"]) == ("past", "last week", ["Oslo"], False)
    (n,) = analyze.rules("My sister never works at Acme.", "Ann", "bot")
    assert n["negated"] and n["schematic"] == "family"
    assert analyze.rules("", "a", "b") == []
    (f,) = analyze.rules("I feel sad about Bob.", "Ann", "bot")
    assert (f["emotion"], f["valence"]) == ("sad", -0.7)
    assert len(analyze.rules("I ran. She ate.", "a", "b")) == 2


def test_query_decomposition(spark):
    q = one(spark, analyze.decomposed_query(F.lit("Where does Anna's brother work?")))
    assert (q["wh"], q["return_field"], q["entity"], q["situational"]) == ("where", "episodic", "Anna", False)


@pytest.mark.parametrize(("said", "seconds"), [("I slept for two hours", 7200), ("for 3 days it rained", 259200), ("I have been here since yesterday.", 86400), ("I was there", None)])
def test_named_lengths(spark, said, seconds):
    assert one(spark, temporal.since_seconds(F.lit(said), NTZ("2024-01-17 00:00:00"))) == seconds


def test_keywords_against_distractors(spark):
    from palimpsest.operators import grading

    v = lambda *x: F.array(*map(F.lit, map(float, x)))
    assert one(spark, grading.above_distractors(v(1, 0), v(1, 0.1), F.array(v(0, 1), v(1, 1))))
    assert not one(spark, grading.above_distractors(v(1, 0), v(0, 1), F.array(v(1, 0))))


def test_copy_and_reembed(spark, tmp_path):
    from palimpsest.sources import migrate

    old = spark.createDataFrame([(1, 2, "a", "likes_to", "b", "text")], "id long, user_id long, subject string, predicate string, object string, source_text string")
    new = migrate.copied(old, str(tmp_path / "t"))
    assert new.first()["source_text_hash"] == one(spark, F.sha2(F.lit("text").cast("binary"), 256))
    row = migrate.reembedded(new, embed.embedder()).first()
    assert np.allclose(row["embedding"], embed.hash_vector("a likes to b"))


def test_style_deltas_and_supersession_shape(spark):
    v = lambda *x: F.array(*map(F.lit, map(float, x)))
    anchors = {"vulnerability": v(1, 0), "gratitude": v(0.5, 0), "formal": v(0, 1), "casual": v(0, 0.25)}
    d = one(spark, embed.style_deltas(v(1, 1), anchors, vector.dot))
    assert (d["warmth"], d["formality"]) == (pytest.approx(0.015), pytest.approx(0.0075))
    assert one(spark, embed.has_supersession_shape(F.lit(0.6), [F.lit(0.5), F.lit(0.1)]))
    assert not one(spark, embed.has_supersession_shape(F.lit(0.4), [F.lit(0.5), F.lit(0.1)]))


def test_a_date_from_known_spans_is_the_same(spark):
    rows = spark.createDataFrame([("we met last week, then on 5 May 2023",), ("nothing",), (None,)], "said string")
    at = F.lit("2024-01-17 10:30:00").cast("timestamp_ntz")
    got = rows.select("said", temporal.date_spans(F.col("said")).alias("s")).select(F.size("s").alias("n"), F.col("s").isNull().alias("no"), temporal.event_date(F.col("said"), at).cast("string").alias("a"), temporal.event_date(F.col("said"), at, F.col("s")).cast("string").alias("b")).collect()
    assert [(r["n"], r["no"], r["a"], r["b"]) for r in got] == [(2, False, "2024-01-10 00:00:00", "2024-01-10 00:00:00"), (0, False, None, None), (None, True, None, None)]
