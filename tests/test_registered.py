"""Every registered query against its SQL."""

from __future__ import annotations

import pytest

from palimpsest.plans import answers, maintained, memory, offline
from palimpsest.plans.registered import ORACLES, QUERIES
from tests.compare import agree

assert answers and maintained and memory and offline


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, small, name):
    agree(QUERIES[name](spark, small), small, ORACLES[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_query_without_sql(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_both_outcomes_occur(spark, medium):
    refused = {r["refused"] for r in QUERIES["answer_questions"](spark, medium).select("refused").distinct().collect()}
    assert refused == {True, False}


def test_entry_point(spark, small):
    import __spark_entry__ as e

    names = e.queries()
    assert set(QUERIES) <= set(names)
    assert set(e.oracle_sql()) <= set(names)
