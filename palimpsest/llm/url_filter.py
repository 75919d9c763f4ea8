"""URL filters by a temporal list join.

Dated list entries (``add`` or ``remove`` a domain, host or URL prefix) become validity intervals; an as-of join holds every
capture against the entries that were active when it was fetched. A capture has a bounded number of keys: its host, the
host's parent domains and the prefixes of its path at each slash; each is an equality key of the join, and the interval
is its residual condition. A hot host makes many captures with one key but few intervals, a join that Spark splits.

Defined cases: null or unparsable URLs and null fetch times match nothing and pass; of entries for one key at one time a
removal wins; repeated entries count once; repeated captures are evaluated as rows; an empty list passes everything;
other columns of the captures stay as they are, but for those named like an output column, which it replaces. Rows are told
apart by a number that is written with them once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palimpsest.llm.common import durable, unused

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.+$", "")


def intervals(entries: DataFrame) -> DataFrame:
    """``entries(list, kind, value, action, at)`` -> ``list, kind, value, valid_from, valid_to`` (null: still valid)."""
    w = W.partitionBy("list", "kind", "value").orderBy("at", "action")
    known = entries.where("value is not null and at is not null").select("list", "kind", F.lower("value").alias("value"), "action", "at").distinct()
    dated = known.withColumn("valid_to", F.lead("at").over(w))
    return dated.where("action = 'add' and (valid_to is null or valid_to > at)").select("list", "kind", "value", F.col("at").alias("valid_from"), "valid_to")


def keys_of(url: Column) -> Column:
    """``array<struct<kind, value>>``: the host, it and its parent domains, and the path's prefixes up to each slash."""
    host, path = host_of(url), F.regexp_extract(url, PATH, 1)
    labels, steps = F.split(host, r"\."), F.split(path, "/")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("value")))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lower(F.array_join(F.slice(steps, F.lit(1), i), "/"))).alias("value")))
    own = F.array(F.struct(F.lit("host").alias("kind"), host.alias("value")))
    return F.when(host != "", F.array_distinct(F.concat(own, domains, prefixes)))


def evaluate(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """``captures`` with ``host, blocked, n_matches, matched_list, matched_kind, matched_value, valid_from`` added: the last
    four of the most specific match, that is the longest value, then prefix before host before domain, then the first list
    by name."""
    row, best_, n = unused(captures, "row", "best", "n")
    marked = durable(captures.withColumn(row, F.monotonically_increasing_id()), "captures")
    asked = marked.select(F.col(row).alias("row"), F.col(f"`{time_col}`").alias("at"), F.explode(keys_of(F.col(f"`{url_col}`"))).alias("key")).select("row", "at", F.col("key.kind").alias("kind"), F.col("key.value").alias("value"))
    active = (F.col("valid_from") <= F.col("at")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    hits = asked.join(intervals(entries), ["kind", "value"]).where(active)
    order = F.struct(-F.length("value"), F.element_at(F.create_map(F.lit("prefix"), F.lit(0), F.lit("host"), F.lit(1), F.lit("domain"), F.lit(2)), F.col("kind")), F.col("list"))
    best = F.min_by(F.struct("list", "kind", "value", "valid_from"), order)
    found = hits.groupBy(F.col("row").alias(row)).agg(F.count(F.lit(1)).alias(n), best.alias(best_))
    made = {
        "host": F.nullif(host_of(F.col(f"`{url_col}`")), F.lit("")),
        "blocked": F.col(n).isNotNull(),
        "n_matches": F.coalesce(n, F.lit(0)),
        "matched_list": F.col(f"{best_}.list"),
        "matched_kind": F.col(f"{best_}.kind"),
        "matched_value": F.col(f"{best_}.value"),
        "valid_from": F.col(f"{best_}.valid_from"),
    }
    own = [F.col(f"`{c}`") for c in captures.columns if c not in made]
    return marked.join(found, row, "left").select(*own, *[v.alias(k) for k, v in made.items()])
