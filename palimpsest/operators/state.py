"""State transitions of the write path as set operations over the log of writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palimpsest.functions import dims
from palimpsest.operators.scan import arrival, live

def confirmed(writes: DataFrame, revive: bool = False) -> DataFrame:
    """One edge for each (user, source hash): the first write to arrive keeps its id, later ones confirm it. Subject, predicate
    and object are the last known; ``first_learned_at`` and ``last_confirmed_at`` span the writes; a confirmation makes the edge
    current. A tombstoned edge stays as it was, unless ``revive``. ``last_sequence`` is the last write's place."""
    order, have = F.struct(*arrival(writes)), set(writes.columns)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    other = [c for c in writes.columns if c not in ("id", "user_id", "source_text_hash", "subject", "predicate", "object", "is_current", "tombstoned_at", "first_learned_at", "last_confirmed_at", "last_sequence", "writes")]
    learned = F.coalesce("first_learned_at", "source_timestamp") if "first_learned_at" in have else F.col("source_timestamp")
    seen = F.coalesce("last_confirmed_at", "source_timestamp") if "last_confirmed_at" in have else F.col("source_timestamp")
    place = F.coalesce(*[c for c in ("last_sequence", "sequence_number", "id") if c in have])
    # the first write as a whole: its place is compared once, not once a column
    grouped = writes.groupBy("user_id", "source_text_hash").agg(
        F.min_by(F.struct("id", *other, F.col("is_current").alias("__current"), F.col("tombstoned_at").alias("__tombstone")), order).alias("__first"),
        *[last(c) for c in ("subject", "predicate", "object")],
        F.min(learned).alias("first_learned_at"),
        F.max(seen).alias("last_confirmed_at"),
        F.max(place).alias("last_sequence"),
        F.count(F.lit(1)).alias("writes"),
    ).select("*", "__first.*").drop("__first")
    dead = F.lit(False) if revive else F.col("__tombstone").isNotNull()
    return grouped.withColumn("is_current", F.when((F.col("writes") > 1) & ~dead, True).otherwise(F.coalesce("__current", F.lit(True)))).withColumn("tombstoned_at", F.when(dead, F.col("__tombstone"))).drop("__current", "__tombstone")


KEYS = ("user_id", "subject", "predicate")


def superseded(edges: DataFrame, keys: tuple[str, ...] = KEYS, value: str = "object", dead: bool = False) -> DataFrame:
    """Slowly changing facts: within a key, in order of arrival (of the last confirmation, where that is known), a run of equal
    values is superseded by the first row of the next run. Adds ``island, superseded_by, superseded_at, now_current``.
    Tombstoned rows take no part, unless ``dead``. One shuffle: the next run's head is the last head seen when the key is
    read backwards."""
    rows = (edges if dead else live(edges)).drop("superseded_by", "superseded_at")
    order = arrival(rows, last=True)
    forth, back = W.partitionBy(*keys).orderBy(*order), W.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    starts = F.coalesce(~F.col(value).eqNullSafe(F.lag(value).over(forth)), F.lit(True)) | (F.row_number().over(forth) == 1)
    rows = rows.withColumn("__new", starts).withColumn("island", F.sum(F.col("__new").cast("int")).over(forth))
    head = F.when(F.col("__new"), F.struct(F.col("id").alias("by"), F.col("source_timestamp").alias("at")))
    rows = rows.withColumn("__next", F.last(head, ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, -1)))
    return rows.withColumn("superseded_by", F.col("__next.by")).withColumn("superseded_at", F.col("__next.at")).drop("__new", "__next").withColumn("now_current", F.col("superseded_by").isNull())


def retired(edges: DataFrame) -> DataFrame:
    """Supersession applied: a superseded edge is no longer current, names its successor and loses its predicted questions. Subjects,
    predicates and objects are compared without regard to case, and predicates whose verbs are of one state as that state
    (``dims.state_class``: who lives somewhere no longer lives where they moved before); an edge forgotten later has still
    superseded. All older values retire, not the newest alone (``superseded_one_each``)."""
    low = {f"__{c}": F.lower(F.trim(c)) for c in ("subject", "object")} | {"__predicate": dims.state_class(F.col("predicate"))}
    rows = superseded(edges.withColumns(low), ("user_id", "__subject", "__predicate"), "__object", dead=True)
    return rows.withColumn("is_current", F.coalesce("is_current", F.lit(True)) & F.col("now_current")).withColumn("pqs", F.when(F.col("now_current"), F.col("pqs"))).drop("island", "now_current", *low)


def superseded_one_each(edges: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The row-by-row variant: each insert retires one edge, the newest live one of its key with another object among the
    key's last 20. An ordered fold of each key, in Arrow batches."""
    import pandas as pd

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["place", "id"])
        alive, by = [], {}
        for i, obj in zip(rows["id"], rows["object"], strict=True):
            for k in range(len(alive) - 1, max(-1, len(alive) - 21), -1):
                if alive[k][1] != obj:
                    by[alive[k][0]] = i
                    del alive[k]
                    break
            alive.append((i, obj))
        return pd.DataFrame({"id": rows["id"], "superseded_by": pd.array([by.get(i) for i in rows["id"]], dtype="Int64")})

    rows = live(edges)
    return rows.select(*keys, arrival(rows)[0].alias("place"), "id", "object").groupBy(*keys).applyInPandas(fold, "id long, superseded_by long")


def history(edges: DataFrame, subject: str, predicate: str) -> DataFrame:
    """A fact's values, oldest first, each with the value that followed it in the same user's history."""
    order = arrival(edges)
    found = edges.where((F.lower("subject") == subject.lower()) & (F.lower("predicate") == predicate.lower()))
    return found.withColumn("next_object", F.lead("object").over(W.partitionBy("user_id").orderBy(*order))).orderBy(*order)


def fact_key() -> Column:
    return F.concat_ws("::", "schematic", dims.state_class(F.col("predicate")), "subject")


def facts(edges: DataFrame) -> DataFrame:
    """The newest value of each (user, fact key), with the number of changes and the values before."""
    return facts_by_key(live(edges).withColumn("key", fact_key())).drop("sequence_number")


def facts_by_key(rows: DataFrame) -> DataFrame:
    """``facts`` of rows that have their ``key``, with the place of the newest value's edge."""
    order = arrival(rows)
    w, at = W.partitionBy("user_id", "key").orderBy(*order), F.struct(*order)
    rows = rows.withColumn("__before", F.lag("object").over(w)).withColumn("__changed", F.col("__before").isNotNull() & (F.col("__before") != F.col("object")))
    change = F.struct(at.alias("place"), F.col("__before").alias("value"), F.col("source_timestamp").alias("at"), change_kind().alias("type"))
    place = F.max_by("sequence_number", at) if "sequence_number" in rows.columns else F.lit(None).cast("long")
    return rows.groupBy("user_id", "key").agg(F.max_by("object", at).alias("value"), F.max_by("id", at).alias("edge_id"), place.alias("sequence_number"), F.sort_array(F.collect_list(F.when(F.col("__changed"), change))).alias("history")).withColumn("changes", F.size("history"))


def change_kind() -> Column:
    """What a superseding row is: a correction if it was negated, a reversal if it looks back, else an update."""
    return F.when(F.col("negated"), "correction").when(F.col("temporal_context") == "past", "reversal").otherwise("update")


#: What sums of a user's deltas may differ by between orders of the same deltas, and more.
ROUNDING = 1e-9


def profiles(deltas: DataFrame) -> DataFrame:
    """``deltas(user_id, warmth, formality)`` -> a user's style: 0.5 moved by the sum of the deltas, within 0 and 1; a value of 0 reads
    as 0.5, also one that is 0 but for the rounding of the sum, which depends on the order of the deltas."""

    def value(c: str) -> Column:
        v = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + F.coalesce(F.sum(c), F.lit(0.0))))
        return F.when(v < ROUNDING, 0.5).otherwise(v).alias(c)

    return deltas.groupBy("user_id").agg(value("warmth"), value("formality"))


def tier() -> Column:
    """Where an edge also goes: milestones, facts or plain episodes."""
    return F.when(F.col("significance") == "milestone", "milestone").when(F.col("significance") == "stative", "fact").otherwise("episode")


def significance(tense: Column, aspect: Column, verb_class: Column, emphatic: Column) -> Column:
    """What a statement's tense, aspect and verb class make of it."""
    base = (
        F.when((tense == "present") & (aspect == "simple"), "stative")
        .when((tense == "past") & (aspect == "habitual"), "stative")
        .when((tense == "present") & (aspect == "perfect") & verb_class.isin("STATIVE", "RELATION", "IDENTITY"), "stative")
        .when((tense == "past") & (aspect == "simple") & (verb_class == "ACHIEVEMENT"), "milestone")
        .when((tense == "past") & (verb_class == "EXPERIENCE"), "notable")
        .otherwise("routine")
    )
    return F.when(emphatic & (base == "routine"), "notable").otherwise(base)


def milestones(edges: DataFrame) -> DataFrame:
    """The first row of each distinct text of a user."""
    w = W.partitionBy("user_id", "source_text").orderBy(*arrival(edges))
    return edges.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


SCOPES = ("id", "entity", "time", "source", "all")


def forget_predicate(by: str, scope: object) -> Column:
    """Which edges ``forget`` means: an id, an entity's name, a pair of times, a source tag, or all."""
    if by == "id":
        return F.col("id") == int(scope)
    if by == "entity":
        e = F.lower(F.lit(str(scope)))
        return F.coalesce((F.lower("subject") == e) | (F.lower("object") == e) | F.exists("entities", lambda x: F.lower(x) == e), F.lit(False))
    if by == "time":
        lo, hi = scope
        return F.coalesce(F.col("source_timestamp").between(F.lit(lo).cast("timestamp_ntz"), F.lit(hi).cast("timestamp_ntz")), F.lit(False))
    if by == "source":
        return F.coalesce(F.col("source_tag") == str(scope), F.lit(False))
    if by == "all":
        return F.lit(True)
    raise ValueError(f"scope {by!r} is none of {SCOPES}")


def forget(edges: DataFrame, by: str, scope: object, now: Column) -> DataFrame:
    """Tombstones what is meant and still live; what is dead stays as it is, so doing it twice changes nothing."""
    meant = F.col("tombstoned_at").isNull() & forget_predicate(by, scope)
    reason = F.lit(f"by_{by}:{scope}")
    have = edges if "tombstone_reason" in edges.columns else edges.withColumn("tombstone_reason", F.lit(None).cast("string"))
    return have.withColumn("tombstone_reason", F.when(meant, reason).otherwise(F.col("tombstone_reason"))).withColumn("__gone", meant).withColumn("tombstoned_at", F.when(F.col("__gone"), now).otherwise(F.col("tombstoned_at"))).drop("__gone")


def store_gate(rows: DataFrame) -> DataFrame:
    """``rows(subject, subject_pos, predicate, object, source_text)`` that may be stored: leading determiners go, bare function
    words and self-relations do not pass, and a missing source text is made from the parts."""
    subject = F.regexp_replace(F.trim("subject"), r"(?i)^(the|a|an|this|that|these|those) ", "")
    kept = rows.withColumn("subject", subject).withColumn("predicate", F.translate(F.lower(F.trim("predicate")), " ", "_"))
    kept = kept.where(~F.coalesce(F.col("subject_pos").isin("DET", "ADV", "SCONJ", "PRON"), F.lit(False))).where(~F.coalesce(F.lower("subject") == F.lower("object"), F.lit(False)))
    kept = kept.where((F.coalesce(F.length("source_text"), F.lit(0)) >= 15) | (F.coalesce(F.length("object"), F.lit(0)) > 0))
    made = F.concat_ws(" ", "subject", F.translate("predicate", "_", " "), "object")
    return kept.withColumn("source_text", F.when(F.length(F.trim(F.coalesce("source_text", F.lit("")))) > 0, F.col("source_text")).otherwise(made))


def quality_gate(speaker: Column) -> Column:
    """Whether ``(subject, object, object_pos array)`` is worth an edge."""
    o, s = F.lower(F.trim("object")), F.lower(F.trim("subject"))
    pos = F.col("object_pos")
    only = lambda *kinds: F.forall(pos, lambda p: p.isin(*kinds))
    bad = (
        (F.coalesce(o, F.lit("")) == "")
        | (o.contains(s) & (F.length(o) > F.length(s) + 10))
        | (F.length(o) < 3)
        | (o == F.lower(speaker))
        | (o == s)
        | ((F.size(pos) == 1) & only("ADJ", "ADV", "INTJ"))
        | ((F.size(pos) == 2) & F.element_at(pos, 1).isin("DET", "ADV") & F.element_at(pos, 2).isin("ADJ", "ADV"))
        | ((F.size(pos) <= 2) & only("PRON", "DET", "ADV", "ADP"))
        | ~F.exists(pos, lambda p: p.isin("NOUN", "PROPN", "VERB", "NUM", "ADJ"))
    )
    return ~F.coalesce(bad, F.lit(True))


def relational_type() -> Column:
    """The schema's relation where the parser only says personal."""
    return F.when(F.coalesce("relational_type", F.lit("personal")) == "personal", dims.mapped(F.col("schematic"), dims.SCHEMA_RELATION, "personal")).otherwise(F.col("relational_type"))


def relational_type_of(schematic: str) -> Column:
    return dims.mapped(F.col(schematic), dims.SCHEMA_RELATION, "personal")
