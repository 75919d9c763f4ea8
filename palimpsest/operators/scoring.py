"""Answering by activation: every live edge of the asking user is scored along five factors, the echo decides between an
answer and a refusal, and the answer is rendered from the dominant edge. One plan answers any number of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palimpsest.functions import dims, temporal, text, vector
from palimpsest.operators.scan import arrival, is_current, live, mentions, newest

ECHO_RATIO, ECHO_FLOOR, ECHO_LEAST, SIGNIFICANT = 3.0, 1e-6, 3, 0.1


def content_factor(edges: DataFrame) -> Column:
    """The largest non-negative cosine of the query with the edge's vector and those of its predicted questions (``pqs``, where the
    edges have them); 0 without any."""
    near = lambda v: vector.dot(F.col("query_embedding"), v)
    own = [near(F.col("embedding"))]
    if "pqs" in edges.columns:
        known = F.filter(F.coalesce("pqs", F.array().cast(edges.schema["pqs"].dataType)), lambda q: q["embedding"].isNotNull())
        own.append(F.array_max(F.transform(known, lambda q: near(q["embedding"]))))
    return F.coalesce(F.greatest(F.lit(0.0), *own), F.lit(0.0))


def emotional_factor() -> Column:
    asked = (F.col("return_field") == "emotional") | (F.coalesce("wh", F.lit("")) == "how")
    synonyms = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in dims.EMOTION_SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.col("emotion")), F.array().cast("array<string>"))
    none = F.coalesce(F.size("emotions"), F.lit(0)) <= 0
    return (
        F.when(~asked, 1.0)
        .when(F.col("emotion").isNull(), 0.3)
        .when(none, 0.8)
        .when(F.array_contains("emotions", F.col("emotion")), 1.0)
        .when(F.arrays_overlap("emotions", synonyms), 0.9)
        .otherwise(0.5)
    )


def temporal_factor() -> Column:
    asked = (F.col("return_field") == "temporal") | (F.coalesce("wh", F.lit("")) == "when")
    nothing = F.col("resolved_event_date").isNull() & F.col("temporal_expression").isNull()
    base = F.when(F.col("resolved_event_date").isNotNull(), 0.8).otherwise(0.5)
    context = F.col("temporal_context")
    return F.when(~asked, 1.0).when(nothing, 0.1).when(context == "past", F.least(F.lit(1.0), base + 0.2)).when(context == "future", F.greatest(F.lit(0.3), base - 0.1)).otherwise(base)


def relational_factor() -> Column:
    e, s = F.lower("entity"), F.lower(F.coalesce("subject", F.lit("")))
    named = F.exists(F.coalesce("entities", F.array().cast("array<string>")), lambda x: F.lower(x).contains(e))
    return F.when(e.isNull() | (e == "user"), 1.0).when(s.contains(e) | e.contains(s), 1.0).when(named, 0.8).otherwise(0.0)


def schematic_factor() -> Column:
    related = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in dims.RELATED_SCHEMAS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))]), F.col("match_schema")), F.array().cast("array<string>"))
    blank = F.coalesce("schematic", F.lit("")).isin("", "uncategorized")
    return F.when(F.coalesce("match_schema", F.lit("")) == "", 1.0).when(blank, 0.5).when(F.col("schematic") == F.col("match_schema"), 1.0).when(F.array_contains(related, F.col("schematic")), 0.7).otherwise(0.3)


def _met(edges: DataFrame, queries: DataFrame, temporal_aware: bool) -> DataFrame:
    """The live edges of each query's user; an entity asked for narrows to edges that name it."""
    q = queries.withColumn("__about_time", (F.col("return_field") == "temporal") & F.lit(temporal_aware))
    return live(edges).join(q, "user_id").where(F.col("entity").isNull() | mentions(F.col("entity"), strict=False))


def _allowed(edges: DataFrame, queries: DataFrame, temporal_aware: bool) -> DataFrame:
    """What meets a query, and of that only current edges, unless there are none and it is not about time. Whether there are is
    one bit a query, found beforehand, so that no candidates are dealt out to tell."""
    any_current = _met(edges, queries, temporal_aware).groupBy(F.col("query_id").alias("__asked")).agg((F.max(is_current().cast("int")) == 1).alias("__any"))
    told = queries.join(any_current, F.col("query_id").eqNullSafe(F.col("__asked"))).drop("__asked")
    met = _met(edges, told, temporal_aware)
    return met.where(is_current() | (~F.col("__any") & ~F.col("__about_time"))).drop("__any", "__about_time")


def candidates(edges: DataFrame, queries: DataFrame, temporal_aware: bool = True) -> DataFrame:
    """The live edges of each query's user; only current ones, unless there are none and the query is not about time. An entity
    asked for narrows to edges that name it."""
    return _allowed(edges, queries, temporal_aware)


#: Columns that scoring reads and nothing after it does.
VECTORS = ("embedding", "query_embedding", "pqs")


def activated(edges: DataFrame, queries: DataFrame) -> DataFrame:
    """Candidates with ``content, emotional, temporal, relational, schematic_match, activation``, without vectors; the activation is
    the product of the factors' cubes. Edges are scored where they meet their query, before anything is shuffled by query, so
    that no vector is."""
    met = _allowed(edges, queries, True)
    kept = [c for c in met.columns if c not in VECTORS]
    scored = met.select(*kept, content_factor(edges).alias("content"), emotional_factor().alias("emotional"), temporal_factor().alias("temporal"), relational_factor().alias("relational"), schematic_factor().alias("schematic_match"))
    factors = F.col("content") * F.col("emotional") * F.col("temporal") * F.col("relational") * F.col("schematic_match")
    return scored.withColumn("activation", F.pow(factors, F.lit(3)))


def ranked(scored: DataFrame) -> DataFrame:
    w = W.partitionBy("query_id")
    return scored.withColumn("rank", F.row_number().over(w.orderBy(F.desc("activation"), "id"))).withColumn("n", F.count(F.lit(1)).over(w))


def echo(rank: DataFrame) -> DataFrame:
    """``query_id, n, top, middle, refused``: the middle is element n div 2 of the descending list. Refused is what does not stand
    out: a top under the floor, or, among three or more with a positive middle, under three times the middle."""
    middle = F.max(F.when(F.col("rank") == F.floor(F.col("n") / 2) + 1, F.col("activation")))
    s = rank.groupBy("query_id").agg(F.max("n").alias("n"), F.max("activation").alias("top"), middle.alias("middle"))
    return s.withColumn("refused", echo_refuses())


def echo_refuses() -> Column:
    flat = (F.col("n") >= ECHO_LEAST) & (F.col("middle") > 0) & (F.col("top") < ECHO_RATIO * F.col("middle"))
    return flat | (F.col("top") < ECHO_FLOOR)


def significant(rank: DataFrame, ids: int = 10, texts: int = 5) -> DataFrame:
    """``query_id, edge_ids, grounding`` of the edges above a tenth of the top, in order of activation."""
    top = F.max("activation").over(W.partitionBy("query_id"))
    kept = rank.withColumn("__top", top).where((F.col("activation") > SIGNIFICANT * F.col("__top")) & (F.col("rank") <= ids))
    row = F.struct("rank", "id", "source_text")
    g = kept.groupBy("query_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return g.select("query_id", F.col("rows.id").alias("edge_ids"), F.slice(F.col("rows.source_text"), 1, texts).alias("grounding"))


def rendered() -> Column:
    """The answer an edge gives to a query's return field; yes or no to a question without a question word."""
    date = F.coalesce(temporal.rendered(F.col("resolved_event_date")), F.col("temporal_expression"), F.lit(""))
    feeling = F.when(F.coalesce("emotion", F.lit("")) != "", F.concat(F.col("emotion"), F.coalesce(F.concat(F.lit(" about "), F.col("emotion_target")), F.lit(""))))
    people = F.when(F.size("entities") > 0, F.array_join("entities", ", "))
    fact, obj = F.coalesce("episodic_fact", F.lit("")), F.trim(F.coalesce("object", F.lit("")))
    short = F.coalesce(F.col("wh").isin("what", "who", "where", "how"), F.lit(False)) & (text.word_count(obj) >= 3) & (F.length(obj) < F.length(fact))
    plain = F.when(short, obj).when(F.length(fact) > 3, fact).otherwise(F.coalesce("source_text", F.lit("")))
    answer = F.when(F.col("return_field") == "temporal", date).when((F.col("return_field") == "emotional") & feeling.isNotNull(), feeling).when((F.col("return_field") == "relational") & people.isNotNull(), people).otherwise(plain)
    yes_no = F.col("wh").isNull() & F.col("text").contains("?")
    return F.when(yes_no, F.when(F.col("negated"), "No").otherwise("Yes")).otherwise(answer)


def answered(edges: DataFrame, queries: DataFrame, ids: int = 10, texts: int = 5) -> DataFrame:
    """A row for each query: ``query_id, refused, reason, edge_id, activation, answer, edge_ids, grounding``. Edges are scored once:
    ranking, echo, dominant edge and grounding come from one window and one aggregate over it."""
    rank = ranked(activated(edges, queries))
    middle = F.max(F.when(F.col("rank") == F.floor(F.col("n") / 2) + 1, F.col("activation")))
    first = F.max(F.when(F.col("rank") == 1, F.struct(F.col("id"), F.col("activation"), rendered().alias("said"))))
    some = F.sort_array(F.collect_list(F.when(F.col("rank") <= ids, F.struct("rank", "activation", "id", "source_text"))))
    s = rank.groupBy("query_id").agg(F.max("n").alias("n"), middle.alias("middle"), first.alias("first"), some.alias("some"))
    s = s.withColumn("top", F.col("first.activation")).withColumn("some", F.filter("some", lambda e: e["activation"] > SIGNIFICANT * F.col("first.activation")))
    out = queries.select("query_id").join(s, "query_id", "left")
    refused = F.coalesce(echo_refuses(), F.lit(True))
    return out.select(
        "query_id",
        refused.alias("refused"),
        F.when(F.col("n").isNull(), "no_edges").when(refused, "echo_below_noise").alias("reason"),
        F.when(~refused, F.col("first.id")).alias("edge_id"),
        F.when(~refused, F.col("top")).alias("activation"),
        F.when(refused, dims.REFUSAL).otherwise(F.col("first.said")).alias("answer"),
        F.when(~refused, F.col("some.id")).alias("edge_ids"),
        F.when(~refused, F.slice(F.col("some.source_text"), 1, texts)).alias("grounding"),
    )


def situation(edges: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests(request_id, user_id, entity)``: the newest fact of each schema about the entity, in schema order, as one text."""
    met = live(edges).where(is_current()).join(requests, "user_id").where(F.col("entity").isNull() | mentions(F.col("entity"), strict=False))
    newest = met.groupBy("request_id", "schematic").agg(F.max_by("episodic_fact", F.struct(F.coalesce(F.date_format("resolved_event_date", "yyyy-MM-dd"), F.lit("")), *arrival(edges))).alias("fact")).where(F.length("fact") > 3)
    parts = newest.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("schematic", "fact"))).alias("p"))
    return requests.select("request_id").join(parts, "request_id", "left").select("request_id", F.array_join(F.col("p.fact"), ". ").alias("situation"), F.slice(F.col("p.fact"), 1, 5).alias("grounding"), F.when(F.col("p").isNull(), "empty_situation").alias("reason"))


def summary(edges: DataFrame, keep: int = 10) -> DataFrame:
    """``user_id, subject, summary``: a subject's newest current facts."""
    w = W.partitionBy("user_id", "subject").orderBy(*newest(edges))
    last = live(edges).where(is_current()).withColumn("r", F.row_number().over(w)).where(F.col("r") <= keep)
    facts = last.groupBy("user_id", "subject").agg(F.sort_array(F.collect_list(F.struct("r", "episodic_fact"))).alias("f"))
    return facts.select("user_id", "subject", F.concat(F.array_join(F.col("f.episodic_fact"), ". "), F.lit(".")).alias("summary"))
