"""The store as it was: every version of every edge in one table, and questions joined to the versions of their checkpoints.

A write makes a version of its edge, which lasts until the edge is written again. It is current until a write, of whatever
edge, gives its subject and predicate another value. Both ends are places in the order of arrival, so what was known and
current at any checkpoint is a range condition: twenty checkpoints, or one for each question, take one plan and one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palimpsest.functions import dims


def versions(writes: DataFrame) -> DataFrame:
    """``writes`` (numbered in ``sequence_number``) with the ``id`` of their edge, its first write's, and with ``known_from``,
    ``known_until`` and ``retired_at`` (null: not by now). An edge's tombstone is its first write's."""
    edge = W.partitionBy("user_id", "source_text_hash").orderBy("sequence_number")
    rows = writes.withColumn("known_from", F.col("sequence_number")).withColumn("known_until", F.lead("sequence_number").over(edge))
    first = edge.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("id", F.first("id").over(first)).withColumn("tombstoned_at", F.first("tombstoned_at").over(first))
    low = {f"__{c}": F.lower(F.trim(c)) for c in ("subject", "object")} | {"__predicate": dims.state_class(F.col("predicate"))}
    key = W.partitionBy("user_id", "__subject", "__predicate")
    forth, back = key.orderBy("sequence_number"), key.orderBy(F.desc("sequence_number"))
    rows = rows.withColumns(low).withColumn("__new", (F.row_number().over(forth) == 1) | ~F.col("__object").eqNullSafe(F.lag("__object").over(forth)))
    head = F.when(F.col("__new"), F.col("sequence_number"))
    return rows.withColumn("retired_at", F.last(head, ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, -1))).drop("__new", *low)


def as_of(versions_: DataFrame, questions: DataFrame) -> DataFrame:
    """``questions(.., user_id, checkpoint)`` with the live edges that had arrived by then, as they were; ``current`` tells whether
    they were so. The join goes by user; a checkpoint is a place in the order of arrival, itself included."""
    met = questions.join(versions_.where("tombstoned_at is null"), "user_id")
    known = (F.col("known_from") <= F.col("checkpoint")) & (F.col("known_until").isNull() | (F.col("known_until") > F.col("checkpoint")))
    return met.where(known).withColumn("current", F.col("retired_at").isNull() | (F.col("retired_at") > F.col("checkpoint")))


def pass_rates(answers: DataFrame) -> DataFrame:
    """``answers(checkpoint, passed)`` -> a row for each checkpoint, and for those up to it: ``checkpoint, n, passed, rate,
    cumulative_rate``."""
    each = answers.groupBy("checkpoint").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("passed"))
    # one row a checkpoint
    so_far = W.orderBy("checkpoint").rowsBetween(W.unboundedPreceding, 0)
    return each.withColumn("rate", F.col("passed") / F.col("n")).withColumn("cumulative_rate", F.sum("passed").over(so_far) / F.sum("n").over(so_far))
