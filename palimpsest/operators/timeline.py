"""The timeline document: domains hold threads (a subject within a domain), threads hold sessions (days), sessions events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palimpsest.functions import dims


def domain() -> Column:
    return dims.mapped(F.coalesce("schematic", F.lit("")), dims.SCHEMA_DOMAIN, "emotional")


def host() -> Column:
    return dims.mapped(F.lower(F.trim(F.coalesce("source_tag", F.lit("")))), dims.TAG_HOST, dims.DEFAULT_HOST)


def event_type() -> Column:
    return F.when(F.col("superseded_by").isNotNull(), "supersede").when(~F.coalesce("is_current", F.lit(True)), "correction").otherwise("new")


def session_day(created: str = "created_at") -> Column:
    return F.to_date(F.coalesce("source_timestamp", "resolved_event_date", created))


def events(edges: DataFrame) -> DataFrame:
    """``user_id, domain, thread, day, id, host, type, fact``."""
    have = edges
    for c, kind in (("superseded_by", "long"), ("created_at", "timestamp_ntz")):
        if c not in have.columns:
            have = have.withColumn(c, F.lit(None).cast(kind))
    return have.select("user_id", domain().alias("domain"), F.lower("subject").alias("thread"), session_day().alias("day"), "id", host().alias("host"), event_type().alias("type"), "episodic_fact")


def sessions(edges: DataFrame) -> DataFrame:
    """A row for each session: its number in the thread (1 for the first day), its events, main host (of its first event) and
    whether the host changed since the session before."""
    w = W.partitionBy("user_id", "domain", "thread").orderBy("day")
    s = events(edges).groupBy("user_id", "domain", "thread", "day").agg(F.count(F.lit(1)).alias("n_events"), F.min_by("host", "id").alias("host"), F.count_if(F.col("type") != "new").alias("n_changes"))
    return s.withColumn("session", F.dense_rank().over(w)).withColumn("host_switch", F.coalesce(F.lag("host").over(w) != F.col("host"), F.lit(False)))


def threads(edges: DataFrame) -> DataFrame:
    return sessions(edges).groupBy("user_id", "domain", "thread").agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("n_events").alias("n_events"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count_if("host_switch").alias("n_switches"), F.max(F.col("n_changes") > 0).alias("changed"))


def branches(edges: DataFrame) -> DataFrame:
    return threads(edges).groupBy("user_id", "domain").agg(F.count(F.lit(1)).alias("n_threads"), F.sum("n_events").alias("n_events"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"))


def document(edges: DataFrame) -> DataFrame:
    """``user_id, timeline``: the nested document of each user."""
    s = sessions(edges)
    keys = ["user_id", "domain", "thread", "day"]
    ev = events(edges).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("id", "type", F.col("episodic_fact").alias("fact"), "host"))).alias("events"))
    s = s.join(ev, keys).select("user_id", "domain", "thread", F.struct("session", "day", "host", "host_switch", "events").alias("s"))
    t = s.groupBy("user_id", "domain", "thread").agg(F.sort_array(F.collect_list("s")).alias("sessions"))
    d = t.groupBy("user_id", "domain").agg(F.sort_array(F.collect_list(F.struct("thread", "sessions"))).alias("threads"))
    return d.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("domain", "threads"))).alias("timeline"))
