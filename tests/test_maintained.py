"""What is kept up to date commit by commit equals what is made from nothing, and reads no more than it must."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest import schemas
from palimpsest.operators import search
from palimpsest.sources.fixtures import embedded_edges
from palimpsest.sources.index import SegmentedIndex
from palimpsest.sources.maintained import Maintained
from palimpsest.sources.store import EdgeStore
from tests.test_state import T0, edges


def made(store: EdgeStore, held: Maintained) -> None:
    """Each maintained table equals that of ``derive``."""
    store.derive()
    rows = lambda df, *c: sorted((tuple(r) for r in df.select(*c).collect()), key=repr)
    whole = store.derived("edges")
    assert rows(held.table("edges"), "id", "cluster_id", F.col("arc_id").cast("string"), "affiliation", "context_entity") == rows(whole, "id", "cluster_id", "arc_id", "affiliation", "context_entity")
    assert rows(held.table("entities"), "user_id", "key", "name", "mention_count", "first_id", "last_id") == rows(store.derived("entities"), "user_id", "key", "name", "mention_count", "first_id", "last_id")
    history = F.transform("history", lambda h: F.concat_ws("|", h["value"], h["type"]))
    assert rows(held.table("facts"), "user_id", "key", "value", "edge_id", history) == rows(store.derived("facts"), "user_id", "key", "value", "edge_id", history)
    assert rows(held.table("milestones"), "id", "source_text") == rows(store.derived("milestones"), "id", "source_text")
    assert rows(held.table("ambiguities"), "id", "other_id", "question") == rows(store.derived("ambiguities"), "id", "other_id", "question")


def test_updates_equal_what_is_made_from_nothing(spark, small, tmp_path):
    e = embedded_edges(spark, small).where("user_id < 12").withColumn("k", F.col("k").cast("int"))
    e = e.withColumn("significance", F.when(F.col("k") % 3 == 0, "stative").when(F.col("k") % 5 == 0, "milestone"))
    # every other user's texts are told apart, so that some users have confirmations and others have none
    own = F.when(F.col("user_id") % 2 == 0, F.concat_ws(" #", "source_text", "id")).otherwise(F.col("source_text"))
    e = e.withColumn("source_text", own).withColumn("source_text_hash", F.lit(None).cast("string"))
    e = e.withColumn("entities", F.when(F.col("k") % 4 == 0, F.array("object")).otherwise(F.array("object", "predicate")))
    store = EdgeStore(spark, str(tmp_path / "s"), buckets=4)
    held = Maintained(store)
    cuts = ["2024-01-01", "2024-01-08", "2024-01-16", "2025-01-01"]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        at = F.col("source_timestamp")
        store.append(schemas.conform(e.where((at >= F.lit(a).cast("timestamp_ntz")) & (at < F.lit(b).cast("timestamp_ntz")))))
        if k == 1:
            store.forget(4, "entity", "item_3", F.lit(T0).cast("timestamp_ntz"))
        assert held.update() > 0
        assert held.update() == 0
        made(store, held)
    store.compact()
    store.append(schemas.conform(e.where("user_id = 2").limit(5).withColumn("id", F.col("id") + 10**6).withColumn("source_text", F.concat_ws("!", "source_text", "id"))))
    store.compact()
    # both commits are in the snapshot by now
    held.update()
    made(store, held)
    assert held.vacuum() > 0
    made(store, held)
    assert held.enriched(2).where("cluster_id is not null").count() == store.current(2).where("tombstoned_at is null").count()


def test_an_update_touches_the_buckets_of_its_users_alone(spark, tmp_path):
    store = EdgeStore(spark, str(tmp_path / "s"), buckets=16)
    held = Maintained(store)
    store.append(edges(spark, [(u, u, "Ann", "like", f"tea{u}", {"sequence_number": None}) for u in range(30)]))
    assert held.update() == 30
    before = held._manifest(1)
    store.append(edges(spark, [(1000, 3, "Ann", "like", "milk", {"sequence_number": None})]))
    reads: list[list[str]] = []
    plain = held._read

    def noted(part, manifest, buckets=None):
        df = plain(part, manifest, buckets)
        reads.append(df.inputFiles())
        return df

    held._read = noted
    assert held.update() == 1
    mine = spark.range(1).select(store.bucket(F.lit(3).cast("long"))).first()[0]
    assert {f"user_bucket={mine}"} == {p.split("/")[-2] for files in reads for p in files}
    after = held._manifest(2)
    assert {k for k, v in after.items() if before.get(k) != v} <= {(p, mine) for p, _ in after}
    assert {r["cluster_id"] for r in held.table("edges", 3).collect()} == {3}


def test_a_commit_can_merge_clusters(spark, tmp_path):
    store = EdgeStore(spark, str(tmp_path / "s"), buckets=2)
    held = Maintained(store)
    add = lambda *rows: store.append(edges(spark, [(i, 1, "x", "p", f"o{i}", {"entities": list(names), "sequence_number": None}) for i, names in rows]))
    add((50, ["a"]), (7, ["b"]), (30, ["c", "d"]), (9, []))
    held.update()
    assert {r["id"]: r["cluster_id"] for r in held.table("edges").collect()} == {50: 50, 7: 7, 30: 30, 9: 9}
    add((60, ["a", "d"]))
    held.update()
    assert {r["id"]: r["cluster_id"] for r in held.table("edges").collect()} == {50: 30, 7: 7, 30: 30, 9: 9, 60: 30}
    add((3, ["B", "c"]))
    held.update()
    assert {r["id"]: r["cluster_id"] for r in held.table("edges").collect()} == {50: 3, 7: 3, 30: 3, 9: 9, 60: 3, 3: 3}


def test_reads_cost_the_commits_since_the_last_compaction(spark, tmp_path):
    store = EdgeStore(spark, str(tmp_path / "s"), buckets=2)
    for k in range(12):
        assert store.append(edges(spark, [(k, 1, "Ann", "move_to", f"c{k}", {"sequence_number": None, "source_timestamp": T0 + dt.timedelta(days=k)})]), k, "q")
    before = store.current().collect()
    assert len(store._commits().inputFiles()) == 12
    store.compact()
    assert len(store._commits().inputFiles()) == 1 and store._pending() == []
    # a batch that comes again after its commit was folded is known
    assert not store.append(edges(spark, [(3, 1, "Ann", "move_to", "c3")]), 3, "q")
    assert store.append(edges(spark, [(40, 1, "Ann", "move_to", "c40", {"sequence_number": None})]), 12, "q")
    assert {r["sequence_number"] for r in store.current().where("id = 40").collect()} == {13}
    assert len(store._commits().inputFiles()) == 2
    assert store.vacuum() == 13  # twelve commits and their log
    assert sorted(r["id"] for r in store.current().collect()) == sorted([*(r["id"] for r in before), 40])
    assert store.vacuum() == 0


def test_an_append_computes_its_input_once(spark, tmp_path):
    count = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(x):
        count.add(1)
        return x

    store = EdgeStore(spark, str(tmp_path / "s"), buckets=2)
    store.append(edges(spark, [(k, k % 3, "Ann", "like", f"c{k}") for k in range(40)]).withColumn("object_full", noted("object")))
    assert count.value == 40


WORDS = ["tea", "milk", "car", "sun", "rain", "the", "of", "road"]


def texts(n: int, seed: int) -> list[tuple[int, str]]:
    draw = random.Random(seed)
    return [(i, " ".join(draw.choices(WORDS, weights=[1, 2, 3, 4, 1, 40, 30, 2], k=draw.randrange(1, 40)))) for i in range(n)]


def ranking(df) -> list[tuple]:
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in df.collect())


def test_the_index_equals_one_made_anew(spark, tmp_path):
    queries = spark.createDataFrame([(1, ["tea"]), (2, ["the", "of"]), (3, ["rain", "the", "nothing"]), (4, ["nothing"])], "query_id long, terms array<string>")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = SegmentedIndex(spark, str(tmp_path / "i"), fan=3, block=8, part=50)
    assert index.search(queries)[0].count() == 0
    live: dict[int, str] = {}
    for k in range(4):
        rows = [(i + 60 * k, t) for i, t in texts(100, k)]  # ids overlap, so documents are replaced
        index.add(frame([*rows, (5000 + k, ""), (6000 + k, None)]))
        live |= dict(rows)
        gone = [i for i in live if i % 11 == k]
        index.remove(frame([(i, "") for i in gone]))
        live = {i: t for i, t in live.items() if i not in gone}
        found, counts = index.search(queries, 5)
        docs = frame(sorted(live.items()))
        assert ranking(found) == ranking(search.bm25(search.postings(docs), queries, 5, search.lengths(docs).where("length > 0")))
        assert counts["read"] < counts["blocks"]
    assert {r["level"] for r in index._of("segment")} == {0, 1}
    held = sorted(r["name"] for r in index.manifest())
    assert index.vacuum() > 0 and sorted(r["name"] for r in index.manifest()) == held
    assert ranking(index.search(queries, 5)[0]) == ranking(found)


def test_a_rare_word_spares_most_blocks_of_a_common_one(spark, tmp_path):
    rows = [(i, " ".join(["the"] * (1 + i % 9)) + " filler" * (i % 13) + (" zebra" if i % 400 == 0 else "")) for i in range(1600)]
    index = SegmentedIndex(spark, str(tmp_path / "i"), block=32)
    index.add(spark.createDataFrame(rows, "doc_id long, text string"))
    queries = spark.createDataFrame([(1, ["the"])], "query_id long, terms array<string>")
    _, counts = index.search(queries, 3)
    assert counts["read"] <= counts["blocks"] // 3


@pytest.mark.parametrize("ids", [[], [1]])
def test_an_index_of_nothing(spark, tmp_path, ids):
    index = SegmentedIndex(spark, str(tmp_path / "i"))
    index.remove(spark.createDataFrame([(i,) for i in ids], "doc_id long"))
    index.add(spark.createDataFrame([(i, "") for i in ids], "doc_id long, text string"))
    assert index.search(spark.createDataFrame([(1, ["a"])], "query_id long, terms array<string>"))[0].count() == 0


def test_tables_that_nobody_reads_are_not_carried(spark, tmp_path):
    store = EdgeStore(spark, str(tmp_path / "s"), buckets=2)
    held = Maintained(store, parts=("entities",))
    more = {"sequence_number": None, "entities": ["tea", "Ann"]}
    store.append(edges(spark, [(u, u, "Ann", "like", f"tea{u}", more) for u in range(4)]))
    held.update()
    # one is new, the other confirms an edge, so that its user is made anew
    store.append(edges(spark, [(100, 3, "Ann", "like", "milk", more), (101, 2, "Ann", "like", "tea2", more)]))
    assert held.update() == 2
    assert sorted((r["user_id"], r["key"], r["mention_count"]) for r in held.table("entities").collect()) == [(u, k, 2 if u == 3 else 1) for u in range(4) for k in ("ann", "tea")]
    assert {p.name for p in (tmp_path / "s" / "maintained").iterdir() if not p.name.startswith(("manifest", "log"))} == {"edges", "entities"}
    for other in (lambda: held.table("facts"), lambda: Maintained(store).table("facts"), lambda: Maintained(store).update() or Maintained(store, parts=("facts",)).table("facts"), lambda: Maintained(store, parts=("fact",))):
        with pytest.raises(ValueError):
            other()


def test_a_segment_is_made_with_one_shuffle_of_its_postings(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    plans, write = {}, DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (plans.setdefault(path.rsplit("/", 1)[1], []).append(self._df._jdf.queryExecution().executedPlan().toString()), write(self, path, *a, **k))[1])
    index = SegmentedIndex(spark, f"file://{tmp_path}/i", block=2, part=3)
    index.add(spark.createDataFrame([(i, "tea tea oak" if i % 2 else "tea, Oak; elm") for i in range(8)] + [(90, None), (91, "..")], "doc_id long, text string"))
    index.add(spark.createDataFrame([(1, "tea"), (1, "tea and elm"), (None, "oak")], "doc_id long, text string"))
    # ids that come once are not grouped, their texts are not shuffled
    assert "Exchange" not in plans["docs"][0] and "Exchange" in plans["docs"][1]
    # parts, order and blocks of a term come from one grouping
    assert all(p.count("Exchange hashpartitioning") == 1 and "Window" not in p for p in plans["blocks"])
    found, blocks = index.search(spark.createDataFrame([(1, ["oak"]), (2, ["and", "elm"])], "query_id long, terms array<string>"), 20)
    got = {(r["query_id"], r["doc_id"]) for r in found.collect()}
    assert got == {(1, i) for i in (0, 2, 3, 4, 5, 6, 7)} | {(2, i) for i in (0, 1, 2, 4, 6)} and blocks["blocks"] > 4


def test_lists_of_postings_are_collected_from_sorted_rows(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    from palimpsest.sources import index as made

    plans, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (path.endswith("/blocks") and plans.append(self._df._jdf.queryExecution().executedPlan().toString()), write(self, path, *a, **k))[1])
    before = spark.conf.get(made.HASHED, None)
    index = SegmentedIndex(spark, f"file://{tmp_path}/i", block=4, part=12)
    index.add(spark.createDataFrame([(i, "tea " * (1 + i % 5) + "oak " * (i % 7) + ("elm" if i == 3 else "")) for i in range(30)], "doc_id long, text string"))
    # no map of lists beside what Spark counts as memory, and no block that carries the list it is cut from
    assert len(plans) == 1 and "SortAggregate" in plans[0] and "ObjectHashAggregate" not in plans[0]
    assert re.search(r"Generate .*\[term#\d+, part#\d+\], false, \[block#\d+, postings#\d+\]", plans[0])
    assert spark.conf.get(made.HASHED, None) == before
    with pytest.raises(KeyError), made.sorted_groups(spark):
        assert spark.conf.get(made.HASHED) == "false"
        raise KeyError
    assert spark.conf.get(made.HASHED, None) == before
    # blocks of a part: numbered from 0, full but the last, the most telling first, with the tables' types
    name = index._of("segment")[0]["name"]
    rows = spark.read.parquet(f"file://{tmp_path}/i/{name}/blocks")
    assert [(f.name, f.dataType) for f in rows.schema] == [(f.name, f.dataType) for f in index._read(made.BLOCKS, [f"{name}/blocks"]).schema]
    lengths = {i: 1 + i % 5 + i % 7 + (i == 3) for i in range(30)}
    mean, held = sum(lengths.values()) / 30, {}
    for r in rows.collect():
        held.setdefault((r["term"], r["part"]), []).append(r)
    assert {t for t, _ in held} == {"tea", "oak", "elm"} and len([p for t, p in held if t == "tea"]) == 3
    tf = {"tea": lambda i: 1 + i % 5, "oak": lambda i: i % 7, "elm": lambda i: int(i == 3)}
    for term, count in tf.items():
        found = []
        for cells in (sorted(v, key=lambda r: r["block"]) for (t, _), v in held.items() if t == term):
            assert [r["block"] for r in cells] == list(range(len(cells))) and all(len(r["postings"]) == 4 for r in cells[:-1]) and cells[-1]["postings"]
            part = [tuple(p) for r in cells for p in r["postings"]]
            assert part == sorted(part, key=lambda p: (-p[1] * 2.2 / (p[1] + 1.2 * (0.25 + 0.75 * p[2] / mean)), p[0]))
            found += part
        assert sorted(found) == [(i, count(i), lengths[i]) for i in range(30) if count(i)]
