"""Queries for answering, search, graphs, verification and the timeline, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text, vector
from palimpsest.operators import entities as E
from palimpsest.operators import graph, scan, scoring, search, timeline, verify
from palimpsest.plans.memory import CURRENT, LIVE, WITH, values
from palimpsest.plans.registered import query
from palimpsest.sources.fixtures import QUERIES_SQL, edges, embedded_edges, queries, table


def _lifted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Edges and queries whose cosines lie in 0..1, so that both refusals and answers occur."""
    q = queries(spark, d)
    e = embedded_edges(spark, d, q).withColumn("embedding", vector.lifted(F.col("embedding")))
    return e, q.withColumn("query_embedding", vector.lifted(F.col("query_embedding")))


COSINE = "list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), list_transform(query_embedding, lambda x: x::DOUBLE))"

ACTIVATION_SQL = f"""{WITH}, {QUERIES_SQL}, n AS (SELECT count(*) AS n FROM embeddings),
v AS (SELECT e.*, m.embedding FROM edges e, n JOIN embeddings m ON m.vec_id = e.id % n.n WHERE {LIVE}),
j AS (SELECT v.*, q.* EXCLUDE (user_id), (1 + {COSINE}) / 2 AS content FROM v JOIN queries q ON q.user_id = v.user_id WHERE q.entity IS NULL OR len(list_filter(v.entities, lambda x: contains(lower(x), lower(q.entity)))) > 0),
a AS (SELECT *, max(CASE WHEN {CURRENT} THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS any_current FROM j),
c AS (SELECT * FROM a WHERE {CURRENT} OR (any_current = 0 AND return_field <> 'temporal')),
f AS (SELECT *,
  CASE WHEN NOT (return_field = 'emotional' OR coalesce(wh, '') = 'how') THEN 1.0 WHEN emotion IS NULL THEN 0.3 WHEN emotions IS NULL THEN 0.8 WHEN list_contains(emotions, emotion) THEN 1.0
    WHEN emotion = 'happy' AND list_contains(emotions, 'glad') THEN 0.9 ELSE 0.5 END::DOUBLE AS emotional,
  CASE WHEN NOT (return_field = 'temporal' OR coalesce(wh, '') = 'when') THEN 1.0 WHEN resolved_event_date IS NULL AND temporal_expression IS NULL THEN 0.1
    ELSE CASE temporal_context WHEN 'past' THEN least(1.0, CASE WHEN resolved_event_date IS NOT NULL THEN 0.8 ELSE 0.5 END + 0.2) WHEN 'future' THEN greatest(0.3, CASE WHEN resolved_event_date IS NOT NULL THEN 0.8 ELSE 0.5 END - 0.1)
      ELSE CASE WHEN resolved_event_date IS NOT NULL THEN 0.8 ELSE 0.5 END END END::DOUBLE AS temporal,
  CASE WHEN entity IS NULL THEN 1.0 WHEN contains(lower(subject), lower(entity)) OR contains(lower(entity), lower(subject)) THEN 1.0 WHEN len(list_filter(entities, lambda x: contains(lower(x), lower(entity)))) > 0 THEN 0.8 ELSE 0.0 END::DOUBLE AS relational,
  CASE WHEN schematic = 'uncategorized' THEN 0.5 WHEN schematic = match_schema THEN 1.0
    WHEN (match_schema, schematic) IN (('career', 'finance'), ('career', 'education'), ('finance', 'career'), ('education', 'career'), ('health', 'hobby'), ('hobby', 'health'), ('hobby', 'experience'), ('family', 'social'), ('social', 'family'), ('experience', 'hobby'), ('emotional', 'social'), ('emotional', 'family')) THEN 0.7 ELSE 0.3 END::DOUBLE AS schematic_match FROM c),
s AS (SELECT *, pow(greatest(0.0, content) * emotional * temporal * relational * schematic_match, 3) AS activation FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY activation DESC, id) AS rank, count(*) OVER (PARTITION BY query_id) AS n FROM s),
g AS (SELECT query_id, max(n) AS n, max(activation) AS top, max(CASE WHEN rank = n // 2 + 1 THEN activation END) AS middle FROM r GROUP BY query_id),
h AS (SELECT *, (n >= 3 AND middle > 0 AND top < 3.0 * middle) OR top < 1e-6 AS refused FROM g)"""


@query(ACTIVATION_SQL + " SELECT query_id, id, round(emotional, 6) AS emotional, round(temporal, 6) AS temporal, round(relational, 6) AS relational, round(schematic_match, 6) AS schematic_match, round(activation, 6) AS activation FROM s")
def activation(spark: SparkSession, d: str) -> DataFrame:
    e, q = _lifted(spark, d)
    return scoring.activated(e, q).select("query_id", "id", *[F.round(c, 6).alias(c) for c in ("emotional", "temporal", "relational", "schematic_match", "activation")])


_OTHER = "(e.id * 7 + 3) % n.n"
PQS_SQL = ACTIVATION_SQL.replace("SELECT e.*, m.embedding FROM edges e, n JOIN embeddings m ON m.vec_id = e.id % n.n", f"SELECT e.*, m.embedding, o.embedding AS other FROM edges e, n JOIN embeddings m ON m.vec_id = e.id % n.n JOIN embeddings o ON o.vec_id = {_OTHER}").replace(f"(1 + {COSINE}) / 2", f"(1 + greatest({COSINE}, {COSINE.replace('transform(embedding', 'transform(other')})) / 2")


@query(PQS_SQL + " SELECT query_id, id, round(content, 6) AS content, round(activation, 6) AS activation FROM s")
def activation_pqs(spark: SparkSession, d: str) -> DataFrame:
    """Edges that also carry the vector of a predicted question: the nearer of the two counts."""
    e, q = _lifted(spark, d)
    v = table(spark, d, "embeddings")
    other = v.select(F.col("vec_id").alias("__other"), F.array(F.struct(F.lit("?").alias("text"), vector.lifted(F.col("embedding")).alias("embedding"))).alias("pqs"))
    e = e.withColumn("__other", (F.col("id") * 7 + 3) % F.lit(max(v.count(), 1))).join(other, "__other").drop("__other")
    return scoring.activated(e, q).select("query_id", "id", F.round("content", 6).alias("content"), F.round("activation", 6).alias("activation"))


@query(ACTIVATION_SQL + " SELECT query_id, n, round(top, 6) AS top, round(middle, 6) AS middle, refused FROM h")
def echo_refusal(spark: SparkSession, d: str) -> DataFrame:
    e, q = _lifted(spark, d)
    return scoring.echo(scoring.ranked(scoring.activated(e, q))).select("query_id", "n", F.round("top", 6).alias("top"), F.round("middle", 6).alias("middle"), "refused")


@query(ACTIVATION_SQL + """ SELECT query_id, array_to_string(list(id ORDER BY rank), ',') AS edge_ids, array_to_string(list(source_text ORDER BY rank)[1:5], '|') AS grounding
FROM r JOIN h USING (query_id) WHERE activation > 0.1 * top AND rank <= 10 GROUP BY query_id""")
def grounding(spark: SparkSession, d: str) -> DataFrame:
    e, q = _lifted(spark, d)
    g = scoring.significant(scoring.ranked(scoring.activated(e, q)))
    return g.select("query_id", F.array_join("edge_ids", ",").alias("edge_ids"), F.array_join("grounding", "|").alias("grounding"))


ANSWER_SQL = """CASE WHEN wh IS NULL THEN CASE WHEN negated THEN 'No' ELSE 'Yes' END
  WHEN return_field = 'temporal' THEN coalesce(CASE WHEN strftime(resolved_event_date, '%m-%d') = '01-01' THEN strftime(resolved_event_date, '%Y') ELSE strftime(resolved_event_date, '%B %Y') END, temporal_expression, '')
  WHEN return_field = 'emotional' AND emotion IS NOT NULL THEN emotion || coalesce(' about ' || emotion_target, '') WHEN return_field = 'relational' THEN array_to_string(entities, ', ') ELSE episodic_fact END"""


@query(ACTIVATION_SQL + f" SELECT query_id, {ANSWER_SQL} AS answer FROM r WHERE rank = 1")
def answer_render(spark: SparkSession, d: str) -> DataFrame:
    e, q = _lifted(spark, d)
    return scoring.ranked(scoring.activated(e, q)).where("rank = 1").select("query_id", scoring.rendered().alias("answer"))


@query(ACTIVATION_SQL + f""" SELECT q.query_id, coalesce(h.refused, TRUE) AS refused, CASE WHEN h.query_id IS NULL THEN 'no_edges' WHEN h.refused THEN 'echo_below_noise' END AS reason,
  CASE WHEN NOT h.refused THEN r.id END AS edge_id, CASE WHEN NOT h.refused THEN round(r.activation, 6) END AS activation, CASE WHEN coalesce(h.refused, TRUE) THEN 'This information is not mentioned in the conversation.' ELSE {ANSWER_SQL.replace('wh IS NULL', 'r.wh IS NULL').replace('return_field', 'r.return_field')} END AS answer
FROM queries q LEFT JOIN h ON h.query_id = q.query_id LEFT JOIN r ON r.query_id = q.query_id AND r.rank = 1""")
def answer_questions(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: a question for each vector over all users' edges, each answered from its dominant edge or refused."""
    e, q = _lifted(spark, d)
    return scoring.answered(e, q).select("query_id", "refused", "reason", "edge_id", F.round("activation", 6).alias("activation"), "answer")


@query(WITH + f""", r AS (SELECT DISTINCT user_id FROM edges), m AS (SELECT r.user_id, schematic, episodic_fact, coalesce(strftime(resolved_event_date, '%Y-%m-%d'), '') AS day, id FROM edges JOIN r USING (user_id) WHERE {LIVE} AND {CURRENT}),
n AS (SELECT user_id, schematic, arg_max(episodic_fact, (day, id)) AS fact FROM m GROUP BY ALL)
SELECT r.user_id AS request_id, string_agg(fact, '. ' ORDER BY schematic) AS situation, CASE WHEN count(fact) = 0 THEN 'empty_situation' END AS reason FROM r LEFT JOIN n USING (user_id) GROUP BY r.user_id""")
def situation(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    asked = e.select(F.col("user_id").alias("request_id"), "user_id", F.lit(None).cast("string").alias("entity")).distinct()
    return scoring.situation(e, asked).select("request_id", "situation", "reason")


@query(WITH + f", n AS (SELECT *, row_number() OVER (PARTITION BY user_id, subject ORDER BY id DESC) AS r FROM edges WHERE {LIVE} AND {CURRENT}) SELECT user_id, subject, string_agg(episodic_fact, '. ' ORDER BY r) || '.' AS summary FROM n WHERE r <= 10 GROUP BY ALL")
def summary(spark: SparkSession, d: str) -> DataFrame:
    return scoring.summary(edges(spark, d))


DOT = "list_dot_product(list_transform({a}, lambda x: x::DOUBLE), list_transform({b}, lambda x: x::DOUBLE))"


@query(f"SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, {DOT.format(a='embedding', b='(SELECT embedding FROM embeddings WHERE vec_id = 3)')} AS s FROM embeddings) ORDER BY s DESC, vec_id LIMIT 8")
def topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 3").select(F.col("embedding").alias("q"), F.lit(1).alias("one"))
    scored = e.withColumn("one", F.lit(1)).join(F.broadcast(q), "one")
    return search.top_k(scored, F.col("q"), 8).select("vec_id", F.round("score", 6).alias("score"))


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, {DOT.format(a='e.embedding', b='q.embedding')} AS s FROM embeddings q JOIN embeddings e ON TRUE WHERE q.vec_id % 50 = 0)
SELECT query_id, vec_id, CAST(rank AS INT) AS rank, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def topk_each(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return search.top_k_each(e, q, 5).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH m AS (SELECT vec_id AS mention_id, vec_id % 7 AS user_id, embedding FROM embeddings WHERE vec_id % 10 = 0), e AS (SELECT vec_id % 7 AS user_id, 'entity_' || vec_id AS name, embedding FROM embeddings WHERE vec_id % 10 <> 0),
s AS (SELECT mention_id, name, {DOT.format(a='m.embedding', b='e.embedding')} AS s FROM m JOIN e USING (user_id))
SELECT mention_id, CASE WHEN count(*) < 3 OR max(s) >= avg(s) + stddev_pop(s) THEN arg_max(name, s) END AS name, round(max(s), 6) AS score, count(*) AS n FROM s GROUP BY mention_id""")
def entity_link(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("user_id", F.col("vec_id") % 7)
    mentions = e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("mention_id"), "user_id", "embedding")
    known = e.where("vec_id % 10 <> 0").select("user_id", F.concat(F.lit("entity_"), "vec_id").alias("name"), "embedding")
    return E.linked(mentions, known).select("mention_id", "name", F.round("score", 6).alias("score"), "n")


TERMS = [(1, ["the", "and"]), (2, ["de", "la"]), (3, ["tion"]), (4, ["nosuchterm"])]
BM25_SQL = r"""WITH q(query_id, terms) AS (VALUES (1, ['the', 'and']), (2, ['de', 'la']), (3, ['tion']), (4, ['nosuchterm'])), a AS (SELECT query_id, unnest(terms) AS term FROM q),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS t FROM documents),
p AS (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM w), i AS (SELECT doc_id, length, term, count(*) AS tf FROM p GROUP BY ALL),
n AS (SELECT count(*) AS n_docs, avg(len(t)) AS mean_length FROM w WHERE len(t) > 0), f AS (SELECT term, count(*) AS df FROM i GROUP BY term),
s AS (SELECT query_id, doc_id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length)))) AS score FROM a JOIN i USING (term) JOIN f USING (term), n GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)"""


def _terms(spark: SparkSession) -> DataFrame:
    return values(spark, "query_id long, terms array<string>", TERMS)


@query(BM25_SQL + " SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10")
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    found = search.search_documents(table(spark, d, "documents"), _terms(spark))
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(BM25_SQL + " SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3")
def bm25_index(spark: SparkSession, d: str) -> DataFrame:
    """The same by way of the whole inverted index, part of which was renewed."""
    docs = table(spark, d, "documents")
    index = search.refreshed(search.postings(docs), docs, docs.where("doc_id % 10 = 0"))
    return search.bm25(index, _terms(spark), 3).select("query_id", "doc_id", "rank")


@query(BM25_SQL + """, b AS (SELECT query_id, doc_id, rank FROM r WHERE rank <= 10 UNION ALL SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM r WHERE rank <= 10),
u AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS score FROM b GROUP BY ALL)
SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc_id) AS rank FROM u) WHERE rank <= 10""")
def rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    first = search.search_documents(table(spark, d, "documents"), _terms(spark))
    second = first.select("query_id", "doc_id", F.row_number().over(W.partitionBy("query_id").orderBy("doc_id")).alias("rank"))
    return search.fused(first, second).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


RECURSIVE = f"{WITH}, b AS (SELECT * FROM edges WHERE {LIVE})".replace("WITH edges", "WITH RECURSIVE edges")


@query(RECURSIVE + """, n AS (SELECT id, user_id, object AS key FROM b UNION ALL SELECT id, user_id, predicate FROM b),
l AS (SELECT DISTINCT x.id AS a, y.id AS c FROM n x JOIN n y ON x.user_id = y.user_id AND x.key = y.key), w AS (SELECT id AS a, id AS c FROM b UNION SELECT w.a, l.c FROM w JOIN l ON w.c = l.a)
SELECT a AS id, min(c) AS cluster_id FROM w GROUP BY a""")
def components(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d).withColumn("entities", F.array("object", "predicate"))
    return graph.components(e)


@query(RECURSIVE + """, n AS (SELECT id, user_id, object AS key FROM b), l AS (SELECT user_id, key, min(id) AS cluster_id FROM n GROUP BY ALL)
SELECT l.user_id, cluster_id, count(*) AS n, round(avg(sequence_number), 6) AS mean_sequence, array_to_string(list(b.id ORDER BY b.id), ',') AS members, l.key AS participants FROM b JOIN l ON l.user_id = b.user_id AND l.key = b.object GROUP BY ALL""")
def recluster(spark: SparkSession, d: str) -> DataFrame:
    c = graph.clusters(edges(spark, d).withColumn("entities", F.array("object")))
    return c.select("user_id", "cluster_id", F.size("members").cast("long").alias("n"), F.round("mean_sequence", 6).alias("mean_sequence"), F.array_join("members", ",").alias("members"), F.array_join("participants", ",").alias("participants"))


@query(WITH + f""", adj AS (SELECT DISTINCT user_id, lower(predicate) AS a, lower(object) AS b FROM edges WHERE {LIVE} UNION SELECT user_id, lower(object), lower(predicate) FROM edges WHERE {LIVE}),
d0 AS (SELECT DISTINCT user_id, 'item_' || (user_id % 10) AS node, 0 AS d FROM edges), d1 AS (SELECT adj.user_id, b AS node, 1 AS d FROM adj JOIN d0 ON d0.user_id = adj.user_id AND d0.node = a),
d2 AS (SELECT adj.user_id, b AS node, 2 AS d FROM adj JOIN d1 ON d1.user_id = adj.user_id AND d1.node = a), d3 AS (SELECT adj.user_id, b AS node, 3 AS d FROM adj JOIN d2 ON d2.user_id = adj.user_id AND d2.node = a),
m AS (SELECT user_id, node, min(d) AS d FROM (SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3) GROUP BY ALL)
SELECT e.id, CAST(coalesce(least(coalesce(s.d, 99), coalesce(o.d, 99)) % 99, -1) AS INT) + CASE WHEN s.d IS NULL AND o.d IS NULL THEN -1 ELSE 0 END AS hops FROM edges e LEFT JOIN m s ON s.user_id = e.user_id AND s.node = lower(predicate) LEFT JOIN m o ON o.user_id = e.user_id AND o.node = lower(object) WHERE {LIVE}""")
def khop(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d).withColumn("subject", F.col("predicate"))
    goals = e.select("user_id", F.concat(F.lit("item_"), F.col("user_id") % 10).alias("goal")).distinct()
    return graph.hops(e, goals)


FACTS_SQL = f""", c AS (SELECT DISTINCT user_id * 10 + r AS fact_id, user_id AS query_id, r AS rank, user_id, 'item_' || ((user_id + r) % 10) AS entity, 'click' AS predicate, '' AS object FROM edges, range(1, 4) t(r)),
s AS (SELECT fact_id, arg_max(e.id, sequence_number) AS edge_id FROM c JOIN edges e ON e.user_id = c.user_id AND list_contains(e.entities, c.entity) AND e.predicate = c.predicate WHERE {LIVE} GROUP BY fact_id)"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    users = edges(spark, d).select("user_id").distinct().withColumn("rank", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    return users.select(F.col("user_id").alias("query_id"), "rank", "user_id", F.concat(F.lit("item_"), (F.col("user_id") + F.col("rank")) % 10).alias("entity"), F.lit("click").alias("predicate"), F.lit("").alias("object"))


@query(WITH + FACTS_SQL + " SELECT fact_id, edge_id FROM s")
def verify_facts(spark: SparkSession, d: str) -> DataFrame:
    c = _candidates(spark, d).withColumn("fact_id", F.col("user_id") * 10 + F.col("rank"))
    return verify.supporting(edges(spark, d), c.select("fact_id", "user_id", "entity", "predicate", "object"))


@query(WITH + FACTS_SQL + """, k AS (SELECT c.*, edge_id FROM c JOIN s USING (fact_id) WHERE entity NOT IN ('item_3', 'item_4')), f AS (SELECT query_id, arg_min(entity, rank) AS entity, arg_min(edge_id, rank) AS edge_id FROM k GROUP BY query_id)
SELECT q.query_id, f.query_id IS NOT NULL AS verified, edge_id, coalesce(entity, 'This information is not mentioned in the conversation.') AS answer FROM (SELECT DISTINCT query_id FROM c) q LEFT JOIN f USING (query_id)""")
def rejection_memory(spark: SparkSession, d: str) -> DataFrame:
    c = _candidates(spark, d)
    bad = values(spark, "entity string, predicate string, object string", [("item_3", "click", ""), ("item_4", "click", "")])
    empty = values(spark, "key string", [])
    return verify.verified(edges(spark, d), c, verify.remember(empty, bad))


DIMS_SQL = """, t AS (SELECT *, CASE schematic WHEN 'career' THEN 'career' WHEN 'education' THEN 'career' WHEN 'finance' THEN 'career' WHEN 'health' THEN 'health' WHEN 'hobby' THEN 'health' WHEN 'family' THEN 'relationship' WHEN 'social' THEN 'relationship' ELSE 'emotional' END AS domain,
  CASE source_tag WHEN 'llm:gpt' THEN 'chatgpt' WHEN 'llm:gemini' THEN 'gemini' ELSE 'claude' END AS host, CASE WHEN NOT coalesce(is_current, TRUE) THEN 'correction' ELSE 'new' END AS type, lower(subject) AS thread, CAST(source_timestamp AS DATE) AS day FROM edges)"""
SESSIONS_SQL = DIMS_SQL + """, g AS (SELECT user_id, domain, thread, day, count(*) AS n_events, arg_min(host, id) AS host, count(*) FILTER (type <> 'new') AS n_changes FROM t GROUP BY ALL),
s AS (SELECT *, dense_rank() OVER w AS session, coalesce(lag(host) OVER w <> host, FALSE) AS host_switch FROM g WINDOW w AS (PARTITION BY user_id, domain, thread ORDER BY day))"""


@query(WITH + DIMS_SQL + " SELECT id, domain, host, type FROM t")
def timeline_dims(spark: SparkSession, d: str) -> DataFrame:
    return timeline.events(edges(spark, d)).select("id", "domain", "host", "type")


@query(WITH + SESSIONS_SQL + " SELECT user_id, domain, thread, strftime(day, '%Y-%m-%d') AS day, n_events, host, n_changes, CAST(session AS INT) AS session, host_switch FROM s")
def timeline_sessions(spark: SparkSession, d: str) -> DataFrame:
    return timeline.sessions(edges(spark, d)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


THREADS_SQL = SESSIONS_SQL + ", h AS (SELECT user_id, domain, thread, count(*) AS n_sessions, CAST(sum(n_events) AS BIGINT) AS n_events, min(day) AS first_day, max(day) AS last_day, count(*) FILTER (host_switch) AS n_switches, max(n_changes) > 0 AS changed FROM s GROUP BY ALL)"


@query(WITH + THREADS_SQL + " SELECT user_id, domain, thread, n_sessions, n_events, strftime(first_day, '%Y-%m-%d') AS first_day, strftime(last_day, '%Y-%m-%d') AS last_day, n_switches, changed FROM h")
def timeline_threads(spark: SparkSession, d: str) -> DataFrame:
    return timeline.threads(edges(spark, d)).withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first_day", "last_day")})


@query(WITH + THREADS_SQL + " SELECT user_id, domain, count(*) AS n_threads, CAST(sum(n_events) AS BIGINT) AS n_events, strftime(min(first_day), '%Y-%m-%d') AS first_day, strftime(max(last_day), '%Y-%m-%d') AS last_day FROM h GROUP BY ALL")
def timeline_branches(spark: SparkSession, d: str) -> DataFrame:
    return timeline.branches(edges(spark, d)).withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first_day", "last_day")})


DOCUMENT_SQL = SESSIONS_SQL + """, e AS (SELECT user_id, domain, thread, day, string_agg(id || ':' || type || ':' || episodic_fact || ':' || host, ',' ORDER BY id) AS events FROM t GROUP BY ALL),
x AS (SELECT s.*, session || ' ' || strftime(day, '%Y-%m-%d') || ' ' || host || ' ' || CAST(host_switch AS VARCHAR) || ' ' || events AS line FROM s JOIN e USING (user_id, domain, thread, day)),
y AS (SELECT user_id, domain, thread, thread || '[' || string_agg(line, ';' ORDER BY session) || ']' AS line FROM x GROUP BY user_id, domain, thread),
z AS (SELECT user_id, domain, domain || '{' || string_agg(line, '|' ORDER BY thread) || '}' AS line FROM y GROUP BY user_id, domain)"""


@query(WITH + DOCUMENT_SQL + " SELECT user_id, md5(string_agg(line, '/' ORDER BY domain)) AS timeline FROM z GROUP BY user_id")
def timeline_document(spark: SparkSession, d: str) -> DataFrame:
    """The nested document of each user, read back level by level."""
    event = lambda e: F.concat_ws(":", e["id"], e["type"], e["fact"], e["host"])
    session = lambda s: F.concat_ws(" ", s["session"], F.date_format(s["day"], "yyyy-MM-dd"), s["host"], s["host_switch"].cast("string"), F.array_join(F.transform(s["events"], event), ","))
    thread = lambda t: F.concat(t["thread"], F.lit("["), F.array_join(F.transform(t["sessions"], session), ";"), F.lit("]"))
    domain = lambda x: F.concat(x["domain"], F.lit("{"), F.array_join(F.transform(x["threads"], thread), "|"), F.lit("}"))
    return timeline.document(edges(spark, d)).select("user_id", F.md5(F.array_join(F.transform("timeline", domain), "/").cast("binary")).alias("timeline"))


@query(r"""WITH p AS (SELECT conv_id, turn, coalesce(text, '') AS a, coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS b FROM conversations),
t AS (SELECT conv_id, turn, list_filter(list_distinct(regexp_split_to_array(lower(a), '\s+')), lambda x: x <> '') AS x, list_filter(list_distinct(regexp_split_to_array(lower(b), '\s+')), lambda x: x <> '') AS y FROM p)
SELECT conv_id, turn, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0::DOUBLE ELSE round(2.0::DOUBLE * len(list_intersect(x, y)) / (len(x) + len(y)), 6) END AS f1 FROM t""")
def token_f1(spark: SparkSession, d: str) -> DataFrame:
    """Each turn against the next one of its conversation."""
    from pyspark.sql import Window as W

    rows = table(spark, d, "conversations").withColumn("b", F.lead("text").over(W.partitionBy("conv_id").orderBy("turn")))
    return rows.select("conv_id", "turn", F.round(text.token_f1(F.col("text"), F.col("b")), 6).alias("f1"))


@query(WITH + "SELECT id, contains(lower(source_text), 'item_1') OR contains(lower(source_text), 'signup') AS passed FROM edges")
def keyword_grade(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).select("id", text.contains_keyword(F.col("source_text"), F.array(F.lit("ITEM_1"), F.lit("signup"))).alias("passed"))


@query(WITH + "SELECT schematic, temporal_context, count(*) AS n, round(avg(valence), 6) AS mean, grouping(schematic, temporal_context) AS level FROM edges GROUP BY ROLLUP (schematic, temporal_context)")
def score_rollup(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).rollup("schematic", "temporal_context").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("valence"), 6).alias("mean"), F.grouping_id().alias("level"))


@query(WITH + f"SELECT user_id, predicate, count(*) AS n FROM (SELECT user_id, predicate FROM edges WHERE {LIVE} INTERSECT SELECT user_id, predicate FROM edges WHERE NOT ({LIVE})) GROUP BY ALL")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d).select("user_id", "predicate", "tombstoned_at")
    both = e.where("tombstoned_at is null").select("user_id", "predicate").intersect(e.where("tombstoned_at is not null").select("user_id", "predicate"))
    return both.groupBy("user_id", "predicate").agg(F.count(F.lit(1)).alias("n"))


def _latest(spark: SparkSession, d: str) -> DataFrame:
    return scan.last_n(scan.live(edges(spark, d)), 20, ["user_id"], [F.desc("id")]).select("user_id", "id")


query(WITH + f"SELECT user_id, id FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS r FROM edges WHERE {LIVE}) WHERE r <= 20", name="last_n")(_latest)
