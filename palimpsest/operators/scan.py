"""Scans, filters, facets and validity over edges (``schemas.EDGE``, or any frame with the columns named)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palimpsest.functions import temporal


def live(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("tombstoned_at").isNull())


def arrival(edges: DataFrame, last: bool = False) -> list[Column]:
    """What orders a user's edges: their place in the order of arrival (``last``: of the last confirmation), where it is known,
    then the id. Ids say nothing about time."""
    places = [c for c in (*(("last_sequence",) if last else ()), "sequence_number") if c in edges.columns]
    return [*([F.coalesce(*places)] if places else []), F.col("id")]


def is_current() -> Column:
    """Unknown counts as current."""
    return F.coalesce(F.col("is_current"), F.lit(True))


def mentions(entity: str | Column, strict: bool = True) -> Column:
    """Whether an entity name contains ``entity``, without regard to case; ``strict``: equals it."""
    e = F.lower(F.lit(entity) if isinstance(entity, str) else entity)
    return F.coalesce(F.exists("entities", lambda x: (F.lower(x) == e) if strict else F.lower(x).contains(e)), F.lit(False))


def with_fallback(candidates: DataFrame, key: str = "query_id", temporal_col: str | None = None) -> DataFrame:
    """Current rows of each query; if it has none and is not about time, all its rows. One pass, no second scan."""
    any_current = F.max(is_current().cast("int")).over(W.partitionBy(key)) == 1
    all_rows = ~any_current if temporal_col is None else ~any_current & ~F.col(temporal_col)
    return candidates.withColumn("__all", all_rows).where(is_current() | F.col("__all")).drop("__all")


def relationships(edges: DataFrame, subject: str | None = None, predicate: str | None = None, object_: str | None = None, only_current: bool = True) -> DataFrame:
    """Live edges equal in the parts given, without regard to case, newest first."""
    found = live(edges)
    for name, value in (("subject", subject), ("predicate", predicate), ("object", object_)):
        if value is not None:
            found = found.where(F.lower(name) == value.lower())
    return (found.where(is_current()) if only_current else found).orderBy(*newest(found))


def newest(edges: DataFrame) -> list[Column]:
    return [c.desc_nulls_last() for c in arrival(edges)]


FACETS = ("time", "entity", "source", "trace")


def by_facet(edges: DataFrame, facet: str, value: str | None = None, limit: int | None = 100) -> DataFrame:
    """Live edges by a facet: ``time`` (prefix of the utterance time; newest first, unknown last), ``entity``, ``source`` (tag)
    or ``trace`` (schema); a limit of 0 or None is 100, others are held to 1..1000."""
    if facet not in FACETS:
        raise ValueError(f"facet {facet!r} is none of {FACETS}")
    limit = min(max(limit or 100, 1), 1000)
    found = live(edges)
    if facet == "time":
        if value:
            found = found.where(F.date_format("source_timestamp", "yyyy-MM-dd HH:mm:ss").startswith(value))
        return found.orderBy(F.desc_nulls_last("source_timestamp"), F.desc("id")).limit(limit)
    if value:
        tests = {"entity": lambda: mentions(value) | (F.lower("subject") == value.lower()) | (F.lower("object") == value.lower()), "source": lambda: F.col("source_tag") == value, "trace": lambda: F.col("schematic") == value}
        found = found.where(tests[facet]())
    return found.orderBy(*newest(found)).limit(limit)


def show(edges: DataFrame, facet: str, value: str | None = None, limit: int | None = 100, export_raw_text: bool = False) -> DataFrame:
    found = by_facet(edges, facet, value, limit)
    return found if export_raw_text else found.drop("source_text")


def valid_at(edges: DataFrame, at: Column) -> DataFrame:
    return edges.where((F.col("resolved_event_date") <= at) & (F.col("tombstoned_at").isNull() | (F.col("tombstoned_at") > at))).orderBy("resolved_event_date", "id")


def upcoming(edges: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Live, current edges with an event date from now on to ``days`` ahead, soonest first."""
    due = F.col("resolved_event_date").between(now, now + F.make_interval(days=F.lit(days)))
    return live(edges).where(is_current() & due).withColumn("days_until", temporal.days_until(F.col("resolved_event_date"), now)).orderBy("resolved_event_date", "id")


def urgency(edges: DataFrame, now: Column) -> DataFrame:
    """Adds ``days, proximity, is_upcoming, is_overdue`` for edges with an event date."""
    d = temporal.days_until(F.col("resolved_event_date"), now)
    rows = edges.where(F.col("resolved_event_date").isNotNull())
    return rows.select("*", F.bround(d, 1).alias("days"), temporal.proximity(F.col("resolved_event_date"), now).alias("proximity"), ((d > 0) & (d <= 7)).alias("is_upcoming"), ((d < 0) & is_current()).alias("is_overdue"))


def neighbours(edges: DataFrame, probes: DataFrame, window: int = 5) -> DataFrame:
    """``probes(probe_id)``: for each, the current edges of the same user whose sequence number is at most ``window`` away by
    value. A range is cut into cells of its width, so that the join has equality keys: user and cell."""
    width = window + 1
    p = edges.join(probes, edges["id"] == probes["probe_id"]).select("probe_id", "user_id", F.col("sequence_number").alias("at"))
    p = p.withColumn("cell", F.explode(F.array(*[F.floor(F.col("at") / width) + d for d in (-1, 0, 1)])))
    e = edges.where(is_current()).withColumn("cell", F.floor(F.col("sequence_number") / width))
    return p.join(e, ["user_id", "cell"]).where((F.abs(F.col("sequence_number") - F.col("at")) <= window) & (F.col("id") != F.col("probe_id"))).drop("cell")


def calendar(at: Column) -> list[Column]:
    """Fields of a moment."""
    return [F.year(at).alias("year"), F.month(at).alias("month"), F.dayofmonth(at).alias("day"), F.hour(at).alias("hour"), F.date_format(at, "EEEE").alias("weekday"), (F.weekday(at) >= 5).alias("is_weekend")]


def last_n(df: DataFrame, n: int, keys: list[str], order: list[Column]) -> DataFrame:
    """The first n rows of each group in the given order."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= n).drop("__r")
