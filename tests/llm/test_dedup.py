from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import exact_dedup, near_dedup
from tests.compare import agree
from tests.llm import helpers

DOCS = "doc_id long, text string"


def test_exact_against_sql(spark, medium):
    from palimpsest.llm import registry

    agree(registry.op7_grace_dedup(spark, medium), medium, registry.OP7_SQL)


@pytest.mark.parametrize("memory", [200, 5000, 1 << 20])
def test_exact_against_brute_force_while_it_spills(spark, memory):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(300)]
    rows = [(i, t.replace(" ", rng.choice([" ", "  ", "\t\n"]))) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "x" * 300_000), (903, "x" * 300_000)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.duplicates(df, memory=memory).collect()}
    assert got == helpers.copies(rows)


def test_grace_recursion_tells_equal_hashes_apart(tmp_path):
    records = [(5, i, i, 1, b"", b"ab"[i % 2 : i % 2 + 1] * 50) for i in range(40)]
    got = {g: keep for g, keep, *_ in exact_dedup.grace(iter(records), 60, str(tmp_path))}
    assert got == {i: i % 2 for i in range(40)}
    assert not list(tmp_path.iterdir())


def test_exact_rows_that_tie_and_other_columns(spark):
    df = spark.createDataFrame([(1, "a", 1, 1), (1, "a", 1, 2), (None, "a", 1, 3), (None, None, 1, 4), (2, "b", 1, 5)], "doc_id long, text string, g long, keep_id long")
    assert sum(r["kept"] for r in exact_dedup.duplicates(df).collect()) == 3
    kept = exact_dedup.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, ""), (1, "a"), (2, "b")]
    assert exact_dedup.duplicates(df.limit(0)).count() == 0


def near_rows(seed: int = 1) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows: list[tuple[int, str | None]] = []
    for base in range(12):
        words = [word() for _ in range(rng.choice([4, 9, 30, 150]))]
        for _ in range(8):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows) * 3, " ".join(copy).upper() if base % 2 else "\n".join(copy)))
    return [*rows, (5000, None), (5001, ""), (5002, " \t"), (5003, "one"), (5004, "ONE"), (5005, "one two"), (5006, "w " * 40)]


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_against_brute_force(spark, words, percent):
    rows = near_rows()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(3), words=words, percent=percent).collect()}
    assert got == helpers.components(rows, words, percent)


def test_near_on_a_table_against_brute_force(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df, words=3, percent=85).collect()}
    assert got == helpers.components(rows, 3, 85)


def test_near_in_blocks_smaller_than_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(40):
        copy = list(words)
        for _ in range(rng.randint(1, 6)):
            copy[rng.randrange(len(copy))] = f"x{rng.random()}"
        rows.append((i, " ".join(copy)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS), words=3, percent=85).collect()}
    assert got == helpers.components(rows, 3, 85)


def test_near_keeps_one_of_each_group_with_all_columns(spark):
    rows = near_rows(2)
    df = spark.createDataFrame(rows, DOCS).withColumn("node", F.lit(1)).withColumn("band", F.lit("x"))
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, _, k) in helpers.components(rows, 5, 80).items() if k}
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_repeated_and_null_ids_do_not_crash(spark):
    long = " ".join(f"w{k}" for k in range(50))
    df = spark.createDataFrame([(1, long), (1, "other text altogether here now"), (None, long), (2, long + " x"), (2, long + " x")], DOCS)
    got = near_dedup.near_duplicates(df, words=3, percent=85).collect()
    assert len(got) == 5
    assert {r["component_id"] for r in got if r["doc_id"] == 2} == {1}


def test_estimates_are_near_the_truth():
    import numpy as np

    rng = np.random.default_rng(0)
    for share in (0.5, 0.8, 0.95):
        errors = []
        for _ in range(60):
            common, more = rng.integers(0, 2**63, int(2000 * share), dtype=np.uint64), [rng.integers(0, 2**63, int(1000 * (1 - share)) + 1, dtype=np.uint64) * np.uint64(2) for _ in range(2)]
            sets = [np.unique(np.concatenate([common * np.uint64(2), m])) for m in more]
            true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
            a, b = (near_dedup.sketch(s)[None] for s in sets)
            errors.append(near_dedup.estimate(a, b, np.array([len(sets[0])]), np.array([len(sets[1])]))[0] - true)
        assert abs(np.mean(errors)) < 0.03
