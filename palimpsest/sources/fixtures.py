"""A deterministic projection of the ``events`` and ``embeddings`` tables to fact edges and queries.

``EDGES_SQL`` and ``QUERIES_SQL`` say the same in DuckDB's SQL, as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import dims

AS_OF = "2024-01-20 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of() -> F.Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.col("k")
    e = e.withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    subject, item = F.concat(F.lit("user_"), F.col("user_id")), F.concat(F.lit("item_"), k % 10)
    text = F.concat(subject, F.lit(" "), F.col("event_type"), F.lit(" item_"), k)
    return e.select(
        F.col("event_id").alias("id"),
        "user_id",
        subject.alias("subject"),
        F.col("event_type").alias("predicate"),
        item.alias("object"),
        text.alias("source_text"),
        F.sha2(text.cast("binary"), 256).alias("source_text_hash"),
        F.col("ts").alias("source_timestamp"),
        F.when(F.col("event_type").isin("purchase", "signup"), F.date_trunc("day", "ts").cast("timestamp_ntz") + F.make_interval(days=k - 50)).alias("resolved_event_date"),
        F.when(k % 3 == 0, "last week").alias("temporal_expression"),
        F.element_at(F.array(*map(F.lit, dims.SCHEMAS)), k % 11 + 1).alias("schematic"),
        F.element_at(F.array(F.lit("past"), F.lit("present"), F.lit("future")), k % 3 + 1).alias("temporal_context"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("valence"),
        F.when(F.col("event_type") == "error", "angry").when(F.col("event_type") == "signup", "happy").alias("emotion"),
        F.when(k % 2 == 0, item).alias("emotion_target"),
        (k % 7 == 0).alias("negated"),
        F.when(k % 10 != 9, k % 10 != 8).alias("is_current"),
        F.when(k % 13 == 0, F.col("ts") + F.make_interval(days=F.lit(5))).alias("tombstoned_at"),
        F.array(subject, item, F.concat(F.lit("zone_"), F.col("user_id") % 15)).alias("entities"),
        F.when(k % 4 == 0, "llm:gpt").when(k % 4 == 1, "llm:gemini").otherwise("user").alias("source_tag"),
        F.col("event_id").alias("sequence_number"),
        text.alias("episodic_fact"),
        "k",
    )


EDGES_SQL = """edges AS (
  SELECT event_id AS id, user_id, 'user_' || user_id AS subject, event_type AS predicate, 'item_' || (k % 10) AS object,
    'user_' || user_id || ' ' || event_type || ' item_' || k AS source_text, sha256('user_' || user_id || ' ' || event_type || ' item_' || k) AS source_text_hash,
    ts AS source_timestamp, CASE WHEN event_type IN ('purchase', 'signup') THEN date_trunc('day', ts) + to_days(k - 50) END AS resolved_event_date,
    CASE WHEN k % 3 = 0 THEN 'last week' END AS temporal_expression,
    (['career', 'finance', 'education', 'health', 'hobby', 'family', 'social', 'experience', 'emotional', 'identity', 'uncategorized'])[k % 11 + 1] AS schematic,
    (['past', 'present', 'future'])[k % 3 + 1] AS temporal_context, least(value / 100, 1.0) AS valence,
    CASE event_type WHEN 'error' THEN 'angry' WHEN 'signup' THEN 'happy' END AS emotion, CASE WHEN k % 2 = 0 THEN 'item_' || (k % 10) END AS emotion_target,
    k % 7 = 0 AS negated, CASE WHEN k % 10 <> 9 THEN k % 10 <> 8 END AS is_current, CASE WHEN k % 13 = 0 THEN ts + to_days(5) END AS tombstoned_at,
    ['user_' || user_id, 'item_' || (k % 10), 'zone_' || (user_id % 15)] AS entities,
    CASE WHEN k % 4 = 0 THEN 'llm:gpt' WHEN k % 4 = 1 THEN 'llm:gemini' ELSE 'user' END AS source_tag, event_id AS sequence_number,
    'user_' || user_id || ' ' || event_type || ' item_' || k AS episodic_fact, k
  FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) AS k FROM events))"""


def embedded_edges(spark: SparkSession, sf_dir: str, asking: DataFrame | None = None) -> DataFrame:
    """Edges with an ``embedding``; the count of vectors is read from the files' footers. ``asking(user_id)``: edges of no other
    users are wanted; they go before vectors are joined to them."""
    e = table(spark, sf_dir, "embeddings")
    n = e.count()
    vectors = e.select(F.col("vec_id").alias("__vec"), "embedding")
    own = edges(spark, sf_dir)
    if asking is not None:
        own = own.join(asking.select("user_id").distinct(), "user_id", "left_semi")
    dealt = own.withColumn("__vec", F.col("id") % F.lit(max(n, 1)))
    return dealt.join(vectors, "__vec").drop("__vec")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a question of one user."""
    q, i = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values)).cast("int") + 1)
    return q.select(
        i.alias("query_id"),
        (i % 150).alias("user_id"),
        F.col("embedding").alias("query_embedding"),
        pick(dims.SCHEMAS, F.col("label")).alias("match_schema"),
        pick(["when", "how", "what", "who", None], i).alias("wh"),
        pick(["temporal", "emotional", "relational", "episodic"], i).alias("return_field"),
        F.when(i % 3 == 0, F.concat(F.lit("item_"), i % 10)).alias("entity"),
        F.when(i % 4 == 1, F.array(F.lit("glad"))).when(i % 4 == 2, F.array(F.lit("angry"))).alias("emotions"),
        F.concat(F.lit("question "), i, F.lit("?")).alias("text"),
    )


QUERIES_SQL = """queries AS (
  SELECT vec_id AS query_id, vec_id % 150 AS user_id, embedding AS query_embedding,
    (['career', 'finance', 'education', 'health', 'hobby', 'family', 'social', 'experience', 'emotional', 'identity', 'uncategorized'])[label % 11 + 1] AS match_schema,
    (['when', 'how', 'what', 'who', NULL])[vec_id % 5 + 1] AS wh, (['temporal', 'emotional', 'relational', 'episodic'])[vec_id % 4 + 1] AS return_field,
    CASE WHEN vec_id % 3 = 0 THEN 'item_' || (vec_id % 10) END AS entity,
    CASE WHEN vec_id % 4 = 1 THEN ['glad'] WHEN vec_id % 4 = 2 THEN ['angry'] END AS emotions, 'question ' || vec_id || '?' AS text
  FROM embeddings)"""
