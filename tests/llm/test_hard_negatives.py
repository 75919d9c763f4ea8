from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import hard_negatives as hn
from palimpsest.llm import registry
from tests.compare import agree

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows: list[tuple], every: int = 50, positives: int = 5, negatives: int = 3) -> list[tuple]:
    """Hard negatives by scoring every anchor against every row."""
    fine = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    kept = sorted({(i, lab, tuple(math.floor(256 * x) for x in v)) for i, v, lab in rows if i is not None and lab is not None and fine(v)})
    asking = {}
    for i, lab, v in kept:
        if i % every == 0:
            asking.setdefault(i, (lab, v))
    out = []
    for a, (lab, q) in asking.items():
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), i, other) for i, other, v in kept if i != a)
        for s, p, _ in [x for x in scored if x[2] == lab][:positives]:
            hard = [(n, t) for t, n, other in scored if other != lab and 50 * -s <= 100 * -t <= 95 * -s][:negatives]
            out += [(a, p, r + 1, n, -s, -t) for r, (n, t) in enumerate(hard)]
    return sorted(out)


def run(spark, rows: list[tuple], **more) -> list[tuple]:
    return sorted(tuple(r) for r in hn.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 50 == 0, **more).collect())


def clustered(n: int, seed: int = 0, labels: int = 4, width: int = 8) -> list[tuple]:
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(labels * 2, width))
    return [(i, (centres[i % len(centres)] + 0.2 * draw.normal(size=width)).tolist(), int(draw.integers(labels))) for i in range(n)]


def test_the_query_equals_its_sql(spark, medium):
    assert agree(registry.op12_pivot_table(spark, medium), medium, registry.OP12_SQL) > 50


@pytest.mark.parametrize("shard_rows", [None, 40])
def test_whole_result_in_one_shard_and_in_many(spark, shard_rows):
    rows = clustered(600)
    assert run(spark, rows, shard_rows=shard_rows) == brute(rows)


def test_copies_ties_and_a_hot_label(spark):
    base = clustered(300, seed=2)
    rows = base + [(1000 + i, base[0][1], 1) for i in range(120)] + [(2000 + i, base[50][1], 0) for i in range(60)] + [(3000 + i, [1.0] * 8, 2) for i in range(30)]
    assert run(spark, rows, shard_rows=50) == brute(rows)


def test_rows_that_take_no_part_and_repeated_ids(spark):
    rows = clustered(200, seed=3)
    odd = [(None, [1.0] * 8, 1), (50, None, 1), (100, [1.0] * 7 + [None], 1), (150, [float("nan")] * 8, 0), (200, [float("inf")] * 8, 0), (250, [0.5] * 8, None), (300, [], 1), (400, [1e300] * 8, 1)]
    more = [(0, [0.0] * 8, 3), rows[7], rows[7], (rows[50][0], [0.3] * 8, 0)]
    kept = [r for r in odd if r[0] not in (300, 400)]
    assert run(spark, rows + odd + more) == brute(rows + kept + more)


def test_empty_and_single(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0, 2.0], 1)]) == []
    assert run(spark, [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [0.5, 1.2], 2)]) == brute([(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [0.5, 1.2], 2)])


def test_other_columns_and_large_numbers(spark):
    rows = [(i, [float(x) * 2.0**21 for x in v], lab) for i, v, lab in clustered(150, seed=5)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit(1)).withColumn("vec", F.lit("x")).withColumn("far", F.lit(2))
    assert sorted(tuple(r) for r in hn.hard_negatives(df, F.col("vec_id") % 50 == 0).collect()) == brute(rows)


def test_brackets_hold_and_leave_little():
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(12, 16)) * 300
    x = np.floor(np.repeat(centres, 200, axis=0) + draw.normal(size=(2400, 16)) * 15)
    most = float((x * x).sum(1).max())
    pivots = hn.spread_out(x[:: len(x) // 500], most, hn.PIVOTS)
    dx = hn.distances(x, pivots, most, False)
    order = np.lexsort((dx.min(1), dx.argmin(1)))
    x, dx = x[order], dx[order]
    q = x[::97]
    dq, q2 = hn.distances(q, pivots, most, True), (q * q).sum(1)
    exact = hn.scores(q, x, most)
    for p in range(len(pivots)):
        least, largest = hn.bracket(np.abs(dq[:, p, None] - dx[None, :, p]), dq[:, p, None] + dx[None, :, p], q2[:, None], most)
        assert (least <= exact).all() and (exact <= largest).all()
    fifth = np.partition(exact, -5, axis=1)[:, -5]
    left = hn.survivors(q2, dq, dx, fifth, np.full(len(q), hn._MOST), most)
    assert left[exact >= fifth[:, None]].all()
    assert left.mean() < 0.5
