from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import merkle, registry
from tests.compare import agree


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v: object) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes: list[str]) -> tuple[str, list[list[str]]]:
    """The last node, and each node's siblings by level as (left, right)."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i : i + 3]) for i in range(0, len(below), 3)])
    paths = []
    for i in range(len(nodes)):
        path = []
        for below in levels[:-1]:
            run = i - i % 3
            path.append(("".join(below[run:i]), "".join(below[i + 1 : run + 3])))
            i //= 3
        paths.append(path)
    return levels[-1][0], paths


def brute(rows: list[tuple]) -> list[tuple]:
    """Rows of (id, group, text), the text checked being without its line feeds."""
    none_first = lambda v: (v is not None, v)
    by: dict = {}
    for i, g, t in rows:
        by.setdefault(g, []).append((i, h(field(i), field(g), field(t)), h(field(i), field(g), field(None if t is None else t.replace("\n", "")))))
    groups = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    for g in groups:
        by[g].sort(key=lambda x: (none_first(x[0]), x[1]))
    tops = {g: tree([x[1] for x in by[g]]) for g in groups}
    root, over = tree([tops[g][0] for g in groups])
    out = []
    for g, up in zip(groups, over, strict=True):
        for (i, leaf, seen), path in zip(by[g], tops[g][1], strict=True):
            node = seen
            for left, right in path + up:
                node = h(left, node, right)
            out.append((i, leaf, tops[g][0], root, h(*[a + b for a, b in path + up]), node, node == root))
    return sorted(out, key=repr)


def made(spark, rows: list[tuple], partitions: int = 3) -> list[tuple]:
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "id long, grp string, text string, pos int, tree string").repartition(partitions)
    fixed = [F.col("id"), F.col("grp")]
    got = merkle.manifest(df, "id", "grp", [*fixed, F.col("text")], [*fixed, F.replace(F.col("text"), F.lit("\n"), F.lit(""))])
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_the_query_equals_its_sql(spark, medium):
    assert agree(registry.op11_sql_blocks(spark, medium), medium, registry.OP11_SQL) == 1000


@pytest.mark.parametrize("sizes", [[1], [2, 3], [1, 3, 4, 9, 10, 27, 28], [243, 244, 730]])
def test_trees_of_all_forms(spark, sizes):
    rows = [(100 * i + 7, f"g{k}", f"text {i}\n" if i % 4 else "plain") for k, n in enumerate(sizes) for i in range(n)]
    random.Random(1).shuffle(rows)
    assert made(spark, rows) == brute(rows)


def test_blocks_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 3)
    rows = [(i, "all" if i < 200 else f"s{i}", "a\nb" if i % 5 == 0 else "ab") for i in range(240)]
    assert made(spark, rows) == brute(rows)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, None, None), (None, "", ""), (None, "é", "x"), (1, None, "\n"), (1, None, None), (1, None, ""), (2, "", "same\n"), (2, "", "same\n"), (2, "", "other"), (3, "é", "y" * 50_000)]
    assert made(spark, rows) == brute(rows)


def test_an_empty_table(spark):
    df = spark.createDataFrame([], "id long, grp string")
    got = merkle.manifest(df, "id", "grp", [F.col("id")])
    assert got.count() == 0 and got.columns == ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_a_change_is_found_in_one_leaf_alone(spark):
    df = spark.range(500).select(F.col("id"), F.lit("g").alias("grp"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    seen = F.when(F.col("id") == 77, F.lit("other")).otherwise(F.col("text"))
    got = merkle.manifest(df, "id", "grp", [F.col("text")], [seen])
    assert [r["id"] for r in got.where("not verified").collect()] == [77]
