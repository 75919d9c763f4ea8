"""Queries over the edge projection: scans, facets, state transitions, entities, time. Each has its DuckDB SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import temporal, text
from palimpsest.operators import entities as E
from palimpsest.operators import scan, state
from palimpsest.plans.registered import query
from palimpsest.sources.durable import fresh_path
from palimpsest.sources.fixtures import AS_OF, EDGES_SQL, as_of, edges, table
from palimpsest.sources.store import EdgeStore

WITH = f"WITH {EDGES_SQL}\n"
STAMP = "yyyy-MM-dd HH:mm:ss"
LIVE = "tombstoned_at IS NULL"
CURRENT = "coalesce(is_current, TRUE)"
NOW = f"TIMESTAMP '{AS_OF}'"


def stamp(c: str, name: str | None = None) -> F.Column:
    return F.date_format(c, STAMP).alias(name or c)


def sql_stamp(c: str, name: str | None = None) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {name or c}"


@query(WITH + f"SELECT id, user_id, subject, predicate, object, source_text_hash, schematic, valence, negated, {sql_stamp('resolved_event_date')}, array_to_string(entities, ',') AS entities, source_tag FROM edges")
def edge_projection(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).select("id", "user_id", "subject", "predicate", "object", "source_text_hash", "schematic", "valence", "negated", stamp("resolved_event_date"), F.array_join("entities", ",").alias("entities"), "source_tag")


@query(WITH + f"SELECT id, subject, object, temporal_context FROM edges WHERE {LIVE}")
def live_scan(spark: SparkSession, d: str) -> DataFrame:
    return scan.live(edges(spark, d)).select("id", "subject", "object", "temporal_context")


@query(WITH + f"SELECT id, user_id FROM edges WHERE {LIVE} AND {CURRENT} AND len(list_filter(entities, lambda x: contains(lower(x), 'item_3'))) > 0")
def entity_filter(spark: SparkSession, d: str) -> DataFrame:
    e = scan.live(edges(spark, d))
    return e.where(scan.is_current() & scan.mentions("ITEM_3", strict=False)).select("id", "user_id")


@query(WITH + f"""SELECT query_id, id, is_current FROM (SELECT user_id || ':' || object AS query_id, id, is_current, max(CASE WHEN {CURRENT} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, object) AS any_current
  FROM edges WHERE {LIVE}) WHERE {CURRENT} OR any_current = 0""")
def currency_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A question about each user and object; some objects have no current edge."""
    e = scan.live(edges(spark, d)).withColumn("query_id", F.concat_ws(":", "user_id", "object"))
    return scan.with_fallback(e).select("query_id", "id", "is_current")


@query(WITH + f"SELECT id, predicate, object FROM edges WHERE {LIVE} AND {CURRENT} AND lower(subject) = 'user_7' AND lower(object) = 'item_4'")
def relationships(spark: SparkSession, d: str) -> DataFrame:
    return scan.relationships(edges(spark, d), subject="USER_7", object_="Item_4").select("id", "predicate", "object")


@query(WITH + f"SELECT id, {sql_stamp('source_timestamp')} FROM edges WHERE {LIVE} AND strftime(source_timestamp, '%Y-%m-%d %H:%M:%S') LIKE '2024-01-1%' ORDER BY source_timestamp DESC NULLS LAST, id DESC LIMIT 50")
def facet_time(spark: SparkSession, d: str) -> DataFrame:
    return scan.by_facet(edges(spark, d), "time", "2024-01-1", 50).select("id", stamp("source_timestamp"))


@query(WITH + f"SELECT id, subject FROM edges WHERE {LIVE} AND (list_contains(list_transform(entities, lambda x: lower(x)), 'zone_3') OR lower(subject) = 'zone_3' OR lower(object) = 'zone_3') ORDER BY id DESC LIMIT 100")
def facet_entity(spark: SparkSession, d: str) -> DataFrame:
    return scan.by_facet(edges(spark, d), "entity", "Zone_3", 0).select("id", "subject")


def extraction(spark: SparkSession, d: str) -> DataFrame:
    """The one-to-one side table of an edge's provenance, as a view."""
    return edges(spark, d).select(F.col("id").alias("edge_id"), "source_tag", "negated", "emotion_target")


@query(WITH + f", x AS (SELECT id AS edge_id, source_tag AS tag FROM edges) SELECT id, tag FROM edges JOIN x ON id = edge_id WHERE {LIVE} AND tag = 'llm:gemini' ORDER BY id DESC LIMIT 1000")
def facet_source(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d).drop("source_tag").join(extraction(spark, d).select(F.col("edge_id").alias("id"), "source_tag"), "id")
    return scan.by_facet(e, "source", "llm:gemini", 5000).select("id", F.col("source_tag").alias("tag"))


@query(WITH + f"SELECT id, schematic FROM edges WHERE {LIVE} AND schematic = 'health' ORDER BY id DESC LIMIT 100")
def facet_trace(spark: SparkSession, d: str) -> DataFrame:
    return scan.by_facet(edges(spark, d), "trace", "health").select("id", "schematic")


@query(WITH + f"SELECT id, {sql_stamp('resolved_event_date')} FROM edges WHERE resolved_event_date <= {NOW} AND ({LIVE} OR tombstoned_at > {NOW})")
def valid_at(spark: SparkSession, d: str) -> DataFrame:
    return scan.valid_at(edges(spark, d), as_of()).select("id", stamp("resolved_event_date"))


@query(WITH + f"SELECT id, round(epoch_us(resolved_event_date - {NOW}) / 86400e6, 6) AS days_until FROM edges WHERE {LIVE} AND {CURRENT} AND resolved_event_date BETWEEN {NOW} AND {NOW} + to_days(7)".replace("epoch_us(resolved_event_date - " + NOW + ")", "(epoch_us(resolved_event_date) - epoch_us(" + NOW + "))"))
def upcoming(spark: SparkSession, d: str) -> DataFrame:
    return scan.upcoming(edges(spark, d), as_of()).select("id", F.round("days_until", 6).alias("days_until"))


@query(WITH + f"SELECT p.id AS probe_id, e.id FROM edges p JOIN edges e ON e.user_id = p.user_id AND e.sequence_number BETWEEN p.sequence_number - 50 AND p.sequence_number + 50 AND e.id <> p.id WHERE coalesce(e.is_current, TRUE)")
def neighbours(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return scan.neighbours(e, e.select(F.col("id").alias("probe_id")), 50).select("probe_id", "id")


PROXIMITY_SQL = """CASE WHEN a < 0.04 THEN 'right now' WHEN a < 1 THEN CASE WHEN d > 0 THEN 'today' ELSE 'earlier today' END WHEN a < 2 THEN CASE WHEN d > 0 THEN 'tomorrow' ELSE 'yesterday' END
  ELSE CASE WHEN d > 0 THEN 'in ' ELSE '' END || CASE WHEN a < 7 THEN CAST(CAST(round_even(a, 0) AS BIGINT) AS VARCHAR) || ' days'
    WHEN a < 30 THEN CAST(CAST(round_even(a / 7, 0) AS BIGINT) AS VARCHAR) || CASE WHEN round_even(a / 7, 0) = 1 THEN ' week' ELSE ' weeks' END
    WHEN a < 365 THEN CAST(CAST(round_even(a / 30, 0) AS BIGINT) AS VARCHAR) || CASE WHEN round_even(a / 30, 0) = 1 THEN ' month' ELSE ' months' END
    ELSE CAST(CAST(round_even(a / 365, 0) AS BIGINT) AS VARCHAR) || CASE WHEN round_even(a / 365, 0) = 1 THEN ' year' ELSE ' years' END END || CASE WHEN d > 0 THEN '' ELSE ' ago' END END"""
DAYS_SQL = f", t AS (SELECT *, (epoch_us(resolved_event_date) - epoch_us({NOW})) / 86400e6 AS d, abs((epoch_us(resolved_event_date) - epoch_us({NOW})) / 86400e6) AS a FROM edges WHERE resolved_event_date IS NOT NULL)"


@query(WITH + DAYS_SQL + f" SELECT id, {PROXIMITY_SQL} AS proximity FROM t")
def proximity(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).where("resolved_event_date is not null").select("id", temporal.proximity(F.col("resolved_event_date"), as_of()).alias("proximity"))


@query(WITH + DAYS_SQL + f" SELECT id, round_even(d, 1) AS days, {PROXIMITY_SQL} AS proximity, d > 0 AND d <= 7 AS is_upcoming, d < 0 AND {CURRENT} AS is_overdue FROM t")
def urgency(spark: SparkSession, d: str) -> DataFrame:
    return scan.urgency(edges(spark, d), as_of()).select("id", "days", "proximity", "is_upcoming", "is_overdue")


@query(WITH + f""", t AS (SELECT id, (epoch_us({NOW}) - epoch_us(source_timestamp)) / 1e6 AS s FROM edges WHERE source_timestamp <= {NOW})
SELECT id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN CAST(CAST(floor(s / 60) AS BIGINT) AS VARCHAR) || ' minute' || CASE WHEN floor(s / 60) = 1 THEN '' ELSE 's' END
  WHEN s < 86400 THEN CAST(CAST(floor(s / 3600) AS BIGINT) AS VARCHAR) || ' hour' || CASE WHEN floor(s / 3600) = 1 THEN '' ELSE 's' END
  WHEN s < 604800 THEN CAST(CAST(floor(s / 86400) AS BIGINT) AS VARCHAR) || ' day' || CASE WHEN floor(s / 86400) = 1 THEN '' ELSE 's' END
  WHEN s < 2592000 THEN CAST(CAST(floor(s / 604800) AS BIGINT) AS VARCHAR) || ' week' || CASE WHEN floor(s / 604800) = 1 THEN '' ELSE 's' END
  ELSE CAST(CAST(floor(s / 2592000) AS BIGINT) AS VARCHAR) || ' month' || CASE WHEN floor(s / 2592000) = 1 THEN '' ELSE 's' END END AS age FROM t""")
def humanize(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d).where(F.col("source_timestamp") <= as_of())
    return e.select("id", temporal.humanize(temporal.seconds_between(as_of(), F.col("source_timestamp"))).alias("age"))


@query(WITH + f"SELECT id, CASE WHEN source_timestamp >= {NOW} THEN 1.0 ELSE round(exp(-((epoch_us({NOW}) - epoch_us(source_timestamp)) / 1e6) / 2592000.0), 6) END AS staleness FROM edges")
def staleness(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).select("id", F.round(temporal.staleness(F.col("source_timestamp"), as_of()), 6).alias("staleness"))


@query(WITH + "SELECT id, CAST(year(source_timestamp) AS INT) AS year, CAST(month(source_timestamp) AS INT) AS month, CAST(day(source_timestamp) AS INT) AS day, CAST(hour(source_timestamp) AS INT) AS hour, dayname(source_timestamp) AS weekday, isodow(source_timestamp) >= 6 AS is_weekend FROM edges")
def calendar(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).select("id", *scan.calendar(F.col("source_timestamp")))


@query(WITH + "SELECT id, source_timestamp < resolved_event_date AS is_before, abs(epoch_us(source_timestamp) - epoch_us(resolved_event_date)) / 1e6 AS seconds FROM edges WHERE resolved_event_date IS NOT NULL")
def durations(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("source_timestamp"), F.col("resolved_event_date")
    return edges(spark, d).where("resolved_event_date is not null").select("id", temporal.is_before(a, b).alias("is_before"), temporal.duration_between(a, b).alias("seconds"))


@query(WITH + """SELECT min(id) AS id, user_id, source_text_hash, count(*) AS writes, strftime(min(source_timestamp), '%Y-%m-%d %H:%M:%S') AS first_learned_at, strftime(max(source_timestamp), '%Y-%m-%d %H:%M:%S') AS last_confirmed_at,
  CASE WHEN count(*) > 1 AND arg_min(coalesce(strftime(tombstoned_at, '%Y'), ''), id) = '' THEN TRUE ELSE coalesce(bool_and(is_current), TRUE) END AS is_current, arg_max(object, id) AS object FROM edges GROUP BY user_id, source_text_hash""")
def dedup_confirm(spark: SparkSession, d: str) -> DataFrame:
    return state.confirmed(edges(spark, d)).select("id", "user_id", "source_text_hash", "writes", stamp("first_learned_at"), stamp("last_confirmed_at"), "is_current", "object")


@query(WITH + "SELECT source_text_hash, count(*) AS n, min(id) AS first_id FROM edges GROUP BY source_text_hash")
def source_hash(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).groupBy("source_text_hash").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


ISLANDS_SQL = f""", c AS (SELECT *, CASE WHEN object IS DISTINCT FROM lag(object) OVER w THEN 1 ELSE 0 END AS changed FROM edges WHERE {LIVE} WINDOW w AS (PARTITION BY user_id, subject, predicate ORDER BY id)),
i AS (SELECT *, sum(changed) OVER (PARTITION BY user_id, subject, predicate ORDER BY id) AS island FROM c),
h AS (SELECT user_id, subject, predicate, island - 1 AS island, min(id) AS superseded_by, arg_min(source_timestamp, id) AS superseded_at FROM i GROUP BY user_id, subject, predicate, island)"""


@query(WITH + ISLANDS_SQL + " SELECT id, CAST(island AS BIGINT) AS island, superseded_by, strftime(superseded_at, '%Y-%m-%d %H:%M:%S') AS superseded_at, superseded_by IS NULL AS now_current FROM i LEFT JOIN h USING (user_id, subject, predicate, island)")
def supersession_scd2(spark: SparkSession, d: str) -> DataFrame:
    return state.superseded(edges(spark, d)).select("id", "island", "superseded_by", stamp("superseded_at"), "now_current")


@query(WITH + ISLANDS_SQL + " SELECT user_id, subject, predicate, arg_max(object, id) AS value, max(id) AS id, count(DISTINCT island) AS versions FROM i GROUP BY user_id, subject, predicate")
def current_by_key(spark: SparkSession, d: str) -> DataFrame:
    return state.superseded(edges(spark, d)).groupBy("user_id", "subject", "predicate").agg(F.max_by("object", "id").alias("value"), F.max("id").alias("id"), F.countDistinct("island").alias("versions"))


@query(WITH + "SELECT id, object, lead(object) OVER (PARTITION BY user_id ORDER BY sequence_number) AS next_object FROM edges WHERE lower(subject) = 'user_5' AND lower(predicate) = 'purchase'")
def history_trace(spark: SparkSession, d: str) -> DataFrame:
    return state.history(edges(spark, d), "User_5", "purchase").select("id", "object", "next_object")


@query(WITH + f""", r AS (SELECT *, concat_ws('::', schematic, predicate, subject) AS key FROM edges WHERE {LIVE}),
c AS (SELECT *, lag(object) OVER (PARTITION BY user_id, key ORDER BY id) AS before FROM r)
SELECT user_id, key, arg_max(object, id) AS value, max(id) AS edge_id, count(*) FILTER (before IS NOT NULL AND before <> object) AS changes,
  coalesce(string_agg(before || ':' || CASE WHEN negated THEN 'correction' WHEN temporal_context = 'past' THEN 'reversal' ELSE 'update' END, ',' ORDER BY id) FILTER (before IS NOT NULL AND before <> object), '') AS history FROM c GROUP BY user_id, key""")
def fact_history(spark: SparkSession, d: str) -> DataFrame:
    f = state.facts(edges(spark, d))
    return f.select("user_id", "key", "value", "edge_id", F.col("changes").cast("long").alias("changes"), F.array_join(F.transform("history", lambda h: F.concat_ws(":", h["value"], h["type"])), ",").alias("history"))


@query(WITH + f"SELECT id, user_id, source_text FROM (SELECT *, row_number() OVER (PARTITION BY user_id, source_text ORDER BY id) AS r FROM edges WHERE predicate = 'signup') WHERE r = 1")
def milestones(spark: SparkSession, d: str) -> DataFrame:
    return state.milestones(edges(spark, d).where("predicate = 'signup'")).select("id", "user_id", "source_text")


def _forget(by: str, scope: object):
    def run(spark: SparkSession, d: str) -> DataFrame:
        gone = state.forget(edges(spark, d), by, scope, as_of())
        return gone.groupBy("user_id").agg(F.count_if(F.col("tombstone_reason").isNotNull()).alias("forgotten"), F.count_if(F.col("tombstoned_at").isNull()).alias("left"))

    return run


for _by, _scope, _sql in (
    ("id", 17, "id = 17"),
    ("entity", "ITEM_3", "(lower(subject) = 'item_3' OR lower(object) = 'item_3' OR list_contains(list_transform(entities, lambda x: lower(x)), 'item_3'))"),
    ("time", ("2024-01-05 00:00:00", "2024-01-09 12:00:00"), "source_timestamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09 12:00:00'"),
    ("source", "llm:gpt", "source_tag = 'llm:gpt'"),
    ("all", "", "TRUE"),
):
    query(WITH + f'SELECT user_id, count(*) FILTER ({LIVE} AND {_sql}) AS forgotten, count(*) FILTER ({LIVE} AND NOT {_sql}) AS "left" FROM edges GROUP BY user_id', name=f"forget_{_by}")(_forget(_by, _scope))

NAMED_SQL = f", m AS (SELECT id, user_id, lower(e) AS key, source_timestamp FROM (SELECT *, unnest(entities) AS e FROM edges WHERE {LIVE}))"


@query(WITH + NAMED_SQL + " SELECT user_id, key, count(*) AS mention_count, min(id) AS first_id, max(id) AS last_id FROM m GROUP BY user_id, key")
def entity_mentions(spark: SparkSession, d: str) -> DataFrame:
    return E.mentions(edges(spark, d)).select("user_id", "key", "mention_count", "first_id", "last_id")


@query(WITH + NAMED_SQL + f""", c AS (SELECT *, count(*) OVER (PARTITION BY user_id, key ORDER BY id) AS n FROM m WHERE key <> 'user_' || (user_id - user_id % 2)),
b AS (SELECT id, max(n) AS n FROM c GROUP BY id) SELECT e.id, CASE WHEN e.user_id % 2 = 0 THEN 1.0::DOUBLE WHEN n >= 5 THEN 0.8 WHEN n >= 2 THEN 0.6 WHEN n >= 1 THEN 0.4 ELSE 0.1 END AS affiliation FROM edges e LEFT JOIN b ON e.id = b.id WHERE {LIVE}""")
def affiliation(spark: SparkSession, d: str) -> DataFrame:
    speaker = F.concat(F.lit("user_"), F.col("user_id") - F.col("user_id") % 2)
    return E.affiliation(edges(spark, d), speaker)


@query(WITH + f""", p AS (SELECT id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY id) AS r, list_distinct(list_concat([subject, object], entities)) AS names FROM edges WHERE {LIVE}),
x AS (SELECT a.id, unnest(b.names) AS name, 'user_' || a.user_id AS speaker FROM p a JOIN p b ON a.user_id = b.user_id AND b.r BETWEEN a.r - 5 AND a.r - 1),
n AS (SELECT id, name, count(*) AS n FROM x WHERE length(name) > 1 AND lower(name) <> speaker GROUP BY id, name), f AS (SELECT id, arg_min(name, (-n, name)) AS context_entity FROM n GROUP BY id)
SELECT p.id, context_entity FROM p LEFT JOIN f USING (id)""")
def context_entity(spark: SparkSession, d: str) -> DataFrame:
    return E.context_entity(edges(spark, d), F.concat(F.lit("user_"), F.col("user_id")))


TYPES = ["PERSON", "ORG", "LOCATION"]


@query(WITH + f", t AS (SELECT DISTINCT user_id, 'item_' || (k % 10) AS key, (['PERSON', 'ORG', 'LOCATION'])[k % 10 % 3 + 1] AS entity_type FROM edges WHERE k % 10 < 8) SELECT id, 'GENERIC' AS subject_type, coalesce(entity_type, 'GENERIC') AS object_type FROM edges e LEFT JOIN t ON t.user_id = e.user_id AND t.key = lower(e.object)")
def entity_types(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    n = F.col("k") % 10
    types = e.where(n < 8).select("user_id", F.lower("object").alias("key"), F.element_at(F.array(*map(F.lit, TYPES)), n % 3 + 1).alias("entity_type")).distinct()
    return E.with_types(e, types).select("id", "subject_type", "object_type")


@query(WITH + f", m AS (SELECT user_id, lower(e) AS key, e AS name, count(*) AS n FROM (SELECT user_id, unnest(entities) AS e FROM edges WHERE {LIVE}) GROUP BY ALL) SELECT user_id, key, n AS mention_count FROM m WHERE key = 'zone_2'")
def entity_lookup(spark: SparkSession, d: str) -> DataFrame:
    return E.mentions(edges(spark, d)).where(F.col("key") == "Zone_2".lower()).select("user_id", "key", "mention_count")


@query("SELECT conv_id, turn, NOT list_contains(coalesce(list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), []), role) AS retrieval_mode FROM conversations")
def retrieval_mode(spark: SparkSession, d: str) -> DataFrame:
    return E.retrieval_mode(table(spark, d, "conversations").withColumn("speaker", F.col("role")), "conv_id").select("conv_id", "turn", "retrieval_mode")


@query("SELECT conv_id, turn, md5(coalesce(array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), '|'), '')) AS context FROM conversations")
def context_window(spark: SparkSession, d: str) -> DataFrame:
    return E.context_window(table(spark, d, "conversations"), "conv_id").select("conv_id", "turn", F.md5(F.array_join("context", "|").cast("binary")).alias("context"))


@query("SELECT event_id, nth, nth <= 3 AS allowed FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS nth FROM events)")
def cooldown(spark: SparkSession, d: str) -> DataFrame:
    return E.cooldown(table(spark, d, "events")).select("event_id", F.col("nth").cast("long").alias("nth"), "allowed")


@query(WITH + f""", l AS (SELECT id, user_id, object, predicate, row_number() OVER (PARTITION BY user_id ORDER BY id) AS n, list_distinct(string_split(lower(source_text), ' ')) AS w FROM edges WHERE {LIVE}),
m AS (SELECT p.id, max(o.id) AS other_id FROM l p JOIN l o ON p.user_id = o.user_id AND o.n < p.n AND o.n >= p.n - 30 AND o.object <> p.object AND list_contains(o.w, p.predicate) GROUP BY p.id)
SELECT m.id, other_id, 'Did you mean ' || p.object || ' or ' || o.object || '?' AS question FROM m JOIN l p ON p.id = m.id JOIN l o ON o.id = m.other_id""")
def ambiguity(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    probes = scan.live(e).select("id", "user_id", "object", F.array("predicate").alias("terms"))
    return E.ambiguities(e, probes)


def _patterns(unit: str, cells: int, expr: str) -> str:
    return WITH + f""", n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY source_timestamp DESC, id DESC) AS r FROM edges WHERE {LIVE}), k AS (SELECT user_id, CAST({expr} AS INT) AS bucket, id, count(*) OVER (PARTITION BY user_id) AS total FROM n WHERE r <= 200)
SELECT user_id, bucket, count(*) AS n, any_value(total) AS total, round(count(*) / any_value(total), 6) AS confidence, array_to_string(list(id ORDER BY id)[1:5], ',') AS example_ids FROM k GROUP BY user_id, bucket HAVING count(*) > any_value(total) / {cells}.0"""


for _unit, _cells, _expr in (("hour", 24, "hour(source_timestamp)"), ("dow", 7, "isodow(source_timestamp) - 1")):
    query(_patterns(_unit, _cells, _expr), name=f"patterns_{_unit}")(lambda spark, d, u=_unit: E.patterns(edges(spark, d), u).select("user_id", "bucket", "n", "total", F.round("confidence", 6).alias("confidence"), F.array_join("example_ids", ",").alias("example_ids")))


@query("""WITH s AS (SELECT user_id, least(1.0, greatest(0.0, 0.5 + sum((event_id % 7 - 3) / 500.0))) AS warmth, least(1.0, greatest(0.0, 0.5 + sum((event_id % 5 - 3) / 200.0))) AS formality FROM events GROUP BY user_id)
SELECT user_id, round(CASE WHEN warmth < 1e-9 THEN 0.5 ELSE warmth END, 6)::DOUBLE AS warmth, round(CASE WHEN formality < 1e-9 THEN 0.5 ELSE formality END, 6)::DOUBLE AS formality FROM s""")
def profile_read(spark: SparkSession, d: str) -> DataFrame:
    """Profiles read from a store whose users' turns have moved them; one at 0 reads as the default 0.5."""
    turns = table(spark, d, "events")
    store = EdgeStore(spark, fresh_path(spark, "profiles"), buckets=8)
    moved = lambda n, per: ((F.col("event_id") % n - 3) / float(per)).alias("x")
    store.adapt(turns.select("user_id", moved(7, 500).alias("warmth"), moved(5, 200).alias("formality")))
    return store.profiles().select("user_id", F.round("warmth", 6).alias("warmth"), F.round("formality", 6).alias("formality"))


ARRIVED_SQL = """, w AS (SELECT *, (id * 2654435761) % 4294967296 AS hid FROM edges), q AS (SELECT *, row_number() OVER (ORDER BY source_timestamp, hid) AS seq FROM w),
c AS (SELECT user_id, source_text_hash, first(hid ORDER BY seq) AS id, min(seq) AS seq, max(seq) AS last_seq, last(object ORDER BY seq) AS object, first(subject ORDER BY seq) AS subject, first(predicate ORDER BY seq) AS predicate,
  first(source_timestamp ORDER BY seq) AS source_timestamp, first(tombstoned_at ORDER BY seq) AS dead, count(*) AS n, first(is_current ORDER BY seq) AS own FROM q GROUP BY user_id, source_text_hash)"""
RETIRED_SQL = ARRIVED_SQL + """, d AS (SELECT *, CASE WHEN object IS DISTINCT FROM lag(object) OVER k OR row_number() OVER k = 1 THEN 1 ELSE 0 END AS new FROM c WINDOW k AS (PARTITION BY user_id, subject, predicate ORDER BY last_seq)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id, subject, predicate ORDER BY last_seq) AS island FROM d), h AS (SELECT user_id, subject, predicate, island - 1 AS island, id AS by, source_timestamp AS at FROM i WHERE new = 1)"""


def arrived(spark: SparkSession, d: str) -> EdgeStore:
    """A store of the edges under ids that are in no order of time, written in two batches of one stream with a compaction between."""
    e = edges(spark, d).withColumn("id", (F.col("id") * 2654435761) % 4294967296).withColumn("sequence_number", F.lit(None).cast("long"))
    store = EdgeStore(spark, fresh_path(spark, "arrived"), buckets=8)
    early = F.col("source_timestamp") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    store.append(e.where(early), 0, "events")
    store.compact()
    store.append(e.where(~early), 1, "events")
    return store


@query(WITH + RETIRED_SQL + f""" SELECT i.id, CASE WHEN n > 1 AND dead IS NULL THEN TRUE ELSE coalesce(own, TRUE) END AND h.by IS NULL AS is_current, h.by AS superseded_by, {sql_stamp('h.at', 'superseded_at')}, i.seq AS sequence_number, i.last_seq AS last_sequence
FROM i LEFT JOIN h USING (user_id, subject, predicate, island)""")
def ingested_supersession(spark: SparkSession, d: str) -> DataFrame:
    """What the store says is current, after confirmations, supersession and tombstones, in order of arrival."""
    return arrived(spark, d).current().select("id", "is_current", "superseded_by", stamp("superseded_at"), "sequence_number", "last_sequence")


@query(WITH + ARRIVED_SQL + " SELECT id, object, lead(object) OVER (PARTITION BY user_id ORDER BY seq) AS next_object FROM c WHERE lower(subject) = 'user_5' AND lower(predicate) = 'purchase'")
def ingested_history(spark: SparkSession, d: str) -> DataFrame:
    return state.history(arrived(spark, d).current(), "User_5", "purchase").select("id", "object", "next_object")


@query(WITH + ARRIVED_SQL + """, l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS r FROM c WHERE dead IS NULL) SELECT user_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY seq DESC) AS newest FROM l WHERE r <= 5 GROUP BY user_id""")
def ingested_newest(spark: SparkSession, d: str) -> DataFrame:
    """Each user's last five edges by arrival."""
    e = scan.live(arrived(spark, d).merged())
    last = scan.last_n(e, 5, ["user_id"], scan.newest(e))
    return last.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct(-F.col("sequence_number"), "id"))).alias("n")).select("user_id", F.array_join("n.id", ",").alias("newest"))


@query(WITH + f"SELECT user_id, id, 'event' AS reason FROM edges WHERE {LIVE} AND {CURRENT} AND resolved_event_date BETWEEN {NOW} AND {NOW} + to_days(7) UNION ALL SELECT user_id, arg_max(id, source_timestamp) AS id, 'stale_arc' FROM edges WHERE {LIVE} AND source_timestamp <= {NOW} GROUP BY user_id, object HAVING max(source_timestamp) < {NOW} - to_days(7)")
def proactive_due(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    due = scan.upcoming(e, as_of()).select("user_id", "id", F.lit("event").alias("reason"))
    arcs = scan.live(e).where(F.col("source_timestamp") <= as_of()).groupBy("user_id", "object").agg(F.max_by("id", "source_timestamp").alias("id"), F.max("source_timestamp").alias("checked"))
    return due.unionByName(arcs.where(F.col("checked") < as_of() - F.make_interval(days=F.lit(7))).select("user_id", "id", F.lit("stale_arc").alias("reason")))


def values(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, T._parse_datatype_string(columns))


def sql_values(name: str, columns: str, rows: list[tuple]) -> str:
    cell = lambda v: "NULL" if v is None else f"'{v.replace(chr(39), chr(39) * 2)}'" if isinstance(v, str) else str(v)
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)})"


DATES = [
    (1, "yesterday", "I saw her yesterday", "2024-01-16"),
    (2, "today", "today it rained", "2024-01-17"),
    (3, "tomorrow", "we fly tomorrow", "2024-01-18"),
    (4, "last monday", "we met last monday", "2024-01-15"),
    (5, "next friday", "it is next friday", "2024-01-19"),
    (6, "friday", "see you on friday", "2024-01-19"),
    (7, "friday", "we talked friday", "2024-01-12"),
    (8, "last wednesday", "last wednesday", "2024-01-10"),
    (9, "last week", "last week", "2024-01-10"),
    (10, "last month", "last month", "2023-12-17"),
    (11, "three days ago", "three days ago", "2024-01-14"),
    (12, "2 weeks ago", "2 weeks ago", "2024-01-03"),
    (13, "a month ago", "a month ago", "2023-12-17"),
    (14, "5 years ago", "5 years ago", "2019-01-17"),
    (15, "7 may 2023", "7 may 2023", "2023-05-07"),
    (16, "march 2021", "march 2021", "2021-03-01"),
    (17, "2019", "2019", "2019-01-01"),
    (18, "maybe", "maybe", None),
    (19, "the second", "the second", None),
]


@query(f"WITH {sql_values('d', 'id, expression, sentence, resolved', DATES)} SELECT event_id, resolved FROM events JOIN d ON d.id = event_id % {len(DATES)} + 1")
def date_rules(spark: SparkSession, d: str) -> DataFrame:
    """Relative dates, one for each event by turns, seen from Wednesday 2024-01-17."""
    by_turns = lambda c: F.element_at(F.array(*[F.lit(r[c]) for r in DATES]), (F.col("event_id") % len(DATES)).cast("int") + 1)
    rows = table(spark, d, "events").select("event_id", by_turns(1).alias("expression"), by_turns(2).alias("sentence"))
    at = F.lit("2024-01-17 10:30:00").cast("timestamp_ntz")
    return rows.select("event_id", F.date_format(temporal.resolve_date(F.col("expression"), at, F.col("sentence")), "yyyy-MM-dd").alias("resolved"))


RULES = [
    ("yesterday", "date_trunc('day', ts) - INTERVAL 1 DAY"),
    ("Tomorrow", "date_trunc('day', ts) + INTERVAL 1 DAY"),
    ("last monday", "date_trunc('day', ts) - to_days(CAST(CASE WHEN isodow(ts) = 1 THEN 7 ELSE isodow(ts) - 1 END AS INT))"),
    ("next friday", "date_trunc('day', ts) + to_days(CAST(CASE WHEN isodow(ts) < 5 THEN 5 - isodow(ts) ELSE 12 - isodow(ts) END AS INT))"),
    ("last week", "date_trunc('day', ts) - INTERVAL 7 DAY"),
    ("three days ago", "date_trunc('day', ts) - INTERVAL 3 DAY"),
    ("2 weeks ago", "date_trunc('day', ts) - INTERVAL 14 DAY"),
    ("a month ago", "date_trunc('day', ts) - INTERVAL 1 MONTH"),
    ("5 years ago", "date_trunc('day', ts) - INTERVAL 5 YEAR"),
    ("7 may 2023", "TIMESTAMP '2023-05-07'"),
    ("in march", "make_timestamp(year(ts), 3, 1, 0, 0, 0)"),
    ("2019", "TIMESTAMP '2019-01-01'"),
    ("maybe", "NULL"),
]


@query("SELECT event_id, strftime(CASE event_id % " + str(len(RULES)) + " " + " ".join(f"WHEN {i} THEN {sql}" for i, (_, sql) in enumerate(RULES)) + " END, '%Y-%m-%d') AS resolved FROM events")
def dates_of_events(spark: SparkSession, d: str) -> DataFrame:
    """An expression for each event, seen from its time."""
    said = F.element_at(F.array(*[F.lit(e) for e, _ in RULES]), (F.col("event_id") % len(RULES)).cast("int") + 1)
    return table(spark, d, "events").select("event_id", F.date_format(temporal.resolve_date(said, F.col("ts").cast("timestamp_ntz"), said), "yyyy-MM-dd").alias("resolved"))


SAID = [(1, "Tell me about Anna", True), (2, "What's going on with work?", True), (3, "  describe the trip", True), (4, "When did Anna leave?", False), (5, "", False), (6, "What do we know about Bob", True)]


@query("WITH " + sql_values("s", "id, said, situational", SAID).replace("True", "TRUE").replace("False", "FALSE") + f" SELECT conv_id, turn, length(coalesce(text, '')) AS n_chars, situational FROM conversations JOIN s ON s.id = (conv_id * 7 + turn) % {len(SAID)} + 1")
def situational(spark: SparkSession, d: str) -> DataFrame:
    """Whether a turn asks for a situation: each begins with a phrase, by turns, or says nothing."""
    phrase = F.element_at(F.array(*[F.lit(t) for _, t, _ in SAID]), F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(len(SAID))).cast("int") + 1)
    said = table(spark, d, "conversations").withColumn("said", F.when(phrase == "", phrase).otherwise(F.concat_ws(" ", phrase, F.coalesce("text", F.lit("")))))
    return said.select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), text.is_situational(F.col("said")).alias("situational"))


@query(WITH + f"""SELECT id, CASE schematic WHEN 'career' THEN 'professional' WHEN 'finance' THEN 'professional' WHEN 'education' THEN 'professional' WHEN 'family' THEN 'familial' WHEN 'social' THEN 'social' WHEN 'hobby' THEN 'social' WHEN 'experience' THEN 'social' ELSE 'personal' END AS relational_type,
  CASE WHEN temporal_context = 'present' THEN 'stative' WHEN predicate = 'signup' AND temporal_context = 'past' THEN 'milestone' WHEN predicate = 'view' AND temporal_context = 'past' THEN 'notable' WHEN negated THEN 'notable' ELSE 'routine' END AS significance FROM edges""")
def significance(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d).withColumn("relational_type", F.lit("personal"))
    verb = F.when(F.col("predicate") == "signup", "ACHIEVEMENT").when(F.col("predicate") == "view", "EXPERIENCE").otherwise("ACTION")
    return e.select("id", state.relational_type().alias("relational_type"), state.significance(F.col("temporal_context"), F.lit("simple"), verb, F.col("negated")).alias("significance"))


@query(WITH + "SELECT user_id, CASE WHEN predicate = 'signup' THEN 'milestone' WHEN predicate = 'view' THEN 'fact' ELSE 'episode' END AS tier, count(*) AS n FROM edges GROUP BY ALL")
def tiers(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("predicate") == "signup", "milestone").when(F.col("predicate") == "view", "stative").otherwise("routine")
    return edges(spark, d).withColumn("significance", kind).groupBy("user_id", state.tier().alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query(WITH + "SELECT id, 'user' AS tag FROM edges UNION ALL SELECT id, source_tag FROM edges WHERE source_tag <> 'user'")
def two_pass_ingest(spark: SparkSession, d: str) -> DataFrame:
    """A user's text and the model's response to it are two passes over one utterance."""
    e = edges(spark, d)
    return e.select("id", F.lit("user").alias("tag")).unionByName(e.where("source_tag <> 'user'").select("id", F.col("source_tag").alias("tag")))


@query("""SELECT user_id, strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL""")
def windowed_tumbling(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy("user_id", F.window(F.col("ts").cast("timestamp_ntz"), "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select("user_id", F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n", "total")


@query("""WITH b AS (SELECT user_id, time_bucket(INTERVAL 12 HOUR, ts) AS h FROM events), s AS (SELECT user_id, h AS start FROM b UNION ALL SELECT user_id, h - INTERVAL 12 HOUR FROM b)
SELECT user_id, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY ALL""")
def windowed_sliding(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy("user_id", F.window(F.col("ts").cast("timestamp_ntz"), "1 day", "12 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.date_format("w.start", STAMP).alias("start"), "n")


@query("""WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, session""")
def windowed_session(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp_ntz"), "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.date_format("w.start", STAMP).alias("start"), "n")


@query(WITH + f"SELECT user_id, count(*) AS n, count(*) FILTER ({LIVE}) AS n_live, count(DISTINCT source_text_hash) AS n_texts FROM edges GROUP BY user_id")
def copy_check(spark: SparkSession, d: str) -> DataFrame:
    """What a table copy must agree on."""
    return edges(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("tombstoned_at").isNull()).alias("n_live"), F.countDistinct("source_text_hash").alias("n_texts"))


@query(WITH + "SELECT id, len(list_filter(string_split(source_text, ' '), lambda w: w IN ('click', 'error'))) > 0 AS negated FROM edges")
def negation_lexical(spark: SparkSession, d: str) -> DataFrame:
    shown = F.regexp_replace("source_text", r"\b(click|error)\b", "never")
    return edges(spark, d).select("id", text.negated(shown).alias("negated"))


