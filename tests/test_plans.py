"""What the plans look like."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import scan, scoring
from palimpsest.plans.answers import _lifted
from palimpsest.sources.fixtures import edges


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_filters_and_columns_reach_the_scan(spark, small):
    text = plan(scan.live(edges(spark, small)).where("user_id = 3").select("id", "object"))
    assert "EqualTo(user_id,3)" in text
    assert "event_type" not in text.split("ReadSchema")[1].split("\n")[0]


def test_no_cartesian_product_when_scoring(spark, small):
    e, q = _lifted(spark, small)
    text = plan(scoring.answered(e, q))
    assert "CartesianProduct" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_top_k_is_a_heap(spark, small):
    from palimpsest.operators import search

    v = spark.read.parquet(f"{small}/embeddings.parquet")
    assert "TakeOrderedAndProject" in plan(search.top_k(v, F.array(*[F.lit(0.1)] * 64)))


def test_last_n_limits_before_the_shuffle(spark, small):
    assert "WindowGroupLimit" in plan(scan.last_n(edges(spark, small), 5, ["user_id"], [F.desc("id")]))


def test_rows_that_name_no_other_do_not_meet_in_one_task(spark, small):
    from palimpsest.operators import assertions

    e = edges(spark, small).withColumn("superseded_by", F.when(F.col("k") % 7 == 0, F.col("id") + 1))
    rules = (assertions.refers("exists", "superseded_by"), assertions.refers("same_user", "superseded_by", "target.user_id = user_id"))
    text = plan(assertions._flags(e, rules)[0])
    assert "IsNotNull" in text or "isnotnull((CASE WHEN" in text
    assert "Union" in text
    got = {r["constraint"]: r["n"] for r in assertions.violations(e, rules).collect()}
    last = e.agg(F.max("id")).first()[0]
    other = e.alias("a").join(e.select(F.col("id").alias("to"), F.col("user_id").alias("its")), F.col("superseded_by") == F.col("to")).where("its <> user_id").count()
    assert got == {"exists": e.where(F.col("superseded_by") > last).count(), "same_user": other}


def test_rules_are_read_from_given_tables(spark, small):
    from palimpsest.plans import memory

    assert "events.parquet" in plan(memory.date_rules(spark, small))
    assert "conversations.parquet" in plan(memory.situational(spark, small))


def test_postings_are_counted_within_rows(spark, small):
    from palimpsest.operators import search

    docs = spark.createDataFrame([(1, "b a b, B!"), (2, ""), (3, None), (4, "x")], "doc_id long, text string")
    got = {(r["doc_id"], r["term"]): (r["tf"], r["length"]) for r in search.postings(docs).collect()}
    assert got == {(1, "a"): (1, 4), (1, "b"): (3, 4), (4, "x"): (1, 1)}
    twice = docs.unionByName(docs.where("doc_id = 1"))
    assert {(r["doc_id"], r["term"]): r["tf"] for r in search.postings(twice).collect()} == {(1, "a"): 2, (1, "b"): 6, (4, "x"): 1}
    # no map of a task's terms in memory
    assert "Aggregate" not in plan(search.postings(spark.read.parquet(f"{small}/documents.parquet")))


def test_edges_of_users_who_ask_nothing_get_no_vectors(spark, small):
    e, q = _lifted(spark, small)
    tree = e._jdf.queryExecution().optimizedPlan().toString()
    vectors, semi = tree.index("Join Inner, (__vec"), tree.index("Join LeftSemi")
    # deeper in the tree: before the join with the vectors
    assert vectors < semi


def test_a_python_worker_holds_one_pair_of_blocks(spark, small):
    from palimpsest.operators import search

    v = spark.read.parquet(f"{small}/embeddings.parquet")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    text = plan(search.top_k_each(v, q, 5))
    assert "FlatMapGroupsInPandas" in text and "MapInPandas [" not in text.replace("FlatMapGroupsInPandas", "")
