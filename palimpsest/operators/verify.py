"""Implied-fact verification: a candidate answer counts only if some edge bears out the fact it implies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palimpsest.functions import dims, text
from palimpsest.operators.scan import arrival, live

_WH = r"(?:who|what|where|when|why|how|which|whose|whom)"
_AUX = r"(?:do|does|did|is|are|was|were|has|have|had|will|would|can|could|should)"
STOP = ["the", "a", "an", "of", "to", "in", "on", "at", "for", "and", "or", "is", "are", "was", "were", "did", "does", "do", "who", "what", "where", "when", "why", "how", "which"]


def implied(question: Column) -> Column:
    """``struct(predicate, object)``: of the last clause after ``and``, without its question word and auxiliary, the first word's
    lemma and the rest."""
    clause = F.element_at(F.split(text.normalised(question), r" and "), -1)
    bare = F.trim(F.regexp_replace(clause, rf"^(?:{_WH} )?(?:{_AUX} )?", ""))
    verb = F.substring_index(bare, " ", 1)
    rest = F.trim(F.regexp_replace(bare, r"^\S+ ?", ""))
    return F.struct(text.verb_lemma(verb).alias("predicate"), rest.alias("object"))


def implied_fact(candidate: Column, predicate: Column, object_: Column) -> Column:
    return F.concat_ws(" ", F.nullif(F.trim(candidate), F.lit("")), F.nullif(predicate, F.lit("")), F.nullif(object_, F.lit("")))


def rejection_key(subject: Column, predicate: Column, object_: Column) -> Column:
    return F.concat_ws("|", *[text.normalised(c) for c in (subject, predicate, object_)])


def compound_parts(subject: Column) -> Column:
    """The names in ``A, B and C``."""
    return F.filter(F.transform(F.split(subject, r",| and | & "), lambda x: F.trim(x)), lambda x: x != "")


def content_words(value: Column) -> Column:
    return F.filter(F.array_distinct(F.split(text.normalised(value), " ")), lambda w: (F.length(w) > 1) & ~w.isin(STOP))


def _names() -> Column:
    """The names an edge goes by, in lower case, each once: the parts of its subject and its entities."""
    have = F.coalesce("entities", F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.coalesce(compound_parts(F.lower("subject")), F.array().cast("array<string>")), F.transform(have, lambda x: F.lower(x))))


def supporting(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """``facts(fact_id, user_id, entity, predicate, object)``: the newest live edge that names the entity and either holds the
    predicate's lemma and a word of the object, or shares two content words with one of its questions (``pqs``, if any). Edges
    are joined by user and name, so a fact meets the edges that name its entity only."""
    own = live(edges)
    order = arrival(own)[0]
    lemmas = F.transform(F.split(text.normalised(F.col("episodic_fact")), " "), lambda w: text.verb_lemma(w))
    e = own.select("user_id", F.col("id").alias("edge_id"), order.alias("__place"), F.explode(_names()).alias("__name"), content_words(F.col("episodic_fact")).alias("__words"), lemmas.alias("__lemmas"), *([F.expr("transform(coalesce(pqs, array()), q -> q.text)").alias("__pqs")] if "pqs" in own.columns else [F.array().cast("array<string>").alias("__pqs")]))
    met = facts.withColumn("__name", F.lower("entity")).join(e, ["user_id", "__name"])
    wanted = content_words(F.col("object"))
    holds = F.array_contains("__lemmas", F.col("predicate")) & ((F.size(wanted) == 0) | F.arrays_overlap(wanted, F.col("__words")))
    asked = content_words(F.concat_ws(" ", "predicate", "object"))
    near = F.exists("__pqs", lambda q: F.size(F.array_intersect(content_words(q), asked)) >= 2)
    ok = met.where(F.coalesce(holds, F.lit(False)) | F.coalesce(near, F.lit(False)))
    return ok.groupBy("fact_id").agg(F.max_by("edge_id", F.struct("__place", "edge_id")).alias("edge_id"))


def verified(edges: DataFrame, candidates: DataFrame, rejected: DataFrame) -> DataFrame:
    """``candidates(query_id, rank, user_id, entity, predicate, object)`` without what ``rejected(key)`` remembers; each query's first
    supported candidate, or a refusal."""
    keyed = candidates.withColumn("key", rejection_key(F.col("entity"), F.col("predicate"), F.col("object")))
    left = keyed.join(rejected.select("key").distinct(), "key", "left_anti").withColumn("fact_id", F.struct("query_id", "rank"))
    found = left.join(supporting(edges, left.select("fact_id", "user_id", "entity", "predicate", "object")), "fact_id")
    first = found.groupBy("query_id").agg(F.min_by(F.struct("entity", "edge_id", "rank"), "rank").alias("f"))
    return candidates.select("query_id").distinct().join(first, "query_id", "left").select("query_id", F.col("f").isNotNull().alias("verified"), F.col("f.edge_id").alias("edge_id"), F.coalesce(F.col("f.entity"), F.lit(dims.REFUSAL)).alias("answer"))


def remember(rejected: DataFrame, failures: DataFrame) -> DataFrame:
    """The rejection memory with the keys of ``failures(entity, predicate, object)`` added: distinct, in order."""
    keys = failures.select(rejection_key(F.col("entity"), F.col("predicate"), F.col("object")).alias("key"))
    return rejected.select("key").unionByName(keys).distinct().orderBy("key")


def with_verified_query(vqs: Column, query: Column) -> Column:
    """The verified questions with one more, if no equal one is there and one of the two places is free."""
    have = F.coalesce(vqs, F.array().cast("array<string>"))
    known = F.exists(have, lambda v: text.normalised(v) == text.normalised(query))
    return F.when(known | (F.size(have) >= 2), have).otherwise(F.concat(have, F.array(query)))


def question_type(question: Column) -> Column:
    """The kind of answer a question wants, by its question word."""
    q = F.lower(F.trim(question))
    kinds = {r"\bhow (long|often)\b|\bwhen\b": "temporal", r"\bhow (many|much)\b": "quantity", r"\bwhere\b": "location", r"\b(who|whom|whose)\b": "person", r"\bwhy\b": "reason", r"\bhow\b": "manner", r"\bwhat\b|\bwhich\b": "thing"}
    out = F.lit("yes_no")
    for pattern, kind in reversed(kinds.items()):
        out = F.when(q.rlike(pattern), F.lit(kind)).otherwise(out)
    return out


def first_rank(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(order))).where("__r = 1").drop("__r")
