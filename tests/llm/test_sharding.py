from __future__ import annotations

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from palimpsest.llm import common, sharding


def laid_out(parts, histogram):
    """Rows by goal, and the goals of each group, from a plan."""
    load, goals, seen = Counter(), defaultdict(set), defaultdict(Counter)
    for shard, n, low, high, start, stop, goal in parts:
        load[goal] += (high - low) * (stop - start)
        for nth in range(low, high):
            goals[shard, n, nth].add(goal)
            seen[shard, n, nth][goal] += stop - start
    assert Counter((s, n) for s, n, _ in goals) == Counter(histogram)
    assert all(sum(c.values()) == n for (_, n, _), c in seen.items())
    return load, goals


def test_no_group_is_cut_that_fits():
    rng = random.Random(7)
    for _ in range(400):
        shards = rng.choice([2, 3, 8])
        sizes = [rng.choice([2, 3, 5, 8, 21, rng.randint(2, 60)]) for _ in range(rng.randint(1, 60))] + [rng.randint(60, 500)] * rng.randint(0, 1)
        histogram = Counter((rng.randrange(shards), n) for n in sizes)
        alone = rng.choice([0, rng.randint(0, 400), shards * 60])
        quota = sharding._quota(sum(sizes) + alone, shards)
        parts, room = sharding.plan(histogram, quota)
        load, goals = laid_out(parts, histogram)
        assert all(load[s] + room[s] == quota[s] and room[s] >= 0 for s in range(shards))
        cut = [key for key, g in goals.items() if len(g) > 1]
        assert len(cut) <= shards
        # a group that is cut was larger than every room then left, and rooms only shrink: so it fits none of the end's rooms
        assert all(n > max(room) for _, n, _ in cut)
        if alone >= shards * 60:
            assert all(n > max(quota) for _, n, _ in cut)
        for _, n, _ in cut:
            if n > max(quota):
                assert n > min(quota)


def test_whole_groups_stay_together_and_shards_are_even(spark):
    rng = random.Random(3)
    sizes = [rng.randint(5, 60) for _ in range(30)]
    rows = [(i, f"g{g}") for i, g in enumerate(g for g, n in enumerate(sizes) for _ in range(n))]
    rows += [(len(rows) + i, None if i % 50 == 0 else f"alone {i}") for i in range(400)]
    rng.shuffle(rows)
    # names that the operator uses itself
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("row", "grp", "shard", "slot", "n", "law")})
    got = sharding.shard_documents(df).collect()
    text = dict(rows)
    load, where, slots = Counter(r["shard"] for r in got), defaultdict(set), defaultdict(list)
    for r in got:
        where[text[r["doc_id"]]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert len(got) == len(rows) and max(load.values()) - min(load.values()) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in where.values())


def test_labels_move_to_the_majority(spark):
    bundles = common.durable(spark.createDataFrame([("a", 0, 5, 0), ("a", 1, 2, 1), ("b", 2, 1, 2), ("b", 3, 4, 3)], "grp string, origin int, n long, shard int"), "bundles")
    got = {(r["grp"], r["origin"]): r["shard"] for r in sharding.propagate(bundles, [4, 4, 4, 4]).collect()}
    assert got == {("a", 0): 0, ("a", 1): 0, ("b", 2): 3, ("b", 3): 3}


def test_null_groups_link_nothing(spark):
    nodes = common.durable(spark.range(40).select(F.col("id").alias("row"), F.when(F.col("id") < 10, "x").alias("grp")), "nodes")
    got = sharding.balance(nodes, 4).collect()
    assert sorted(Counter(r["shard"] for r in got).values()) == [10] * 4
    assert len({r["shard"] for r in got if r["row"] < 10}) == 1


def test_sums_before_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(common, "RUN", 4)
    df = spark.range(300).select(F.when(F.col("id") < 250, "hot").otherwise("cold").alias("k"), "id", (F.col("id") % 5 + 1).alias("w"))
    rows = common.sums_before(df, ["k"], F.col("id"), [F.col("id")], "w", "upto", 30).collect()
    for key, n in (("hot", 250), ("cold", 50)):
        own = sorted((r["upto"], r["w"]) for r in rows if r["k"] == key)
        at = 0
        for upto, w in own:
            assert upto == at
            at += w
        assert len(own) == n
