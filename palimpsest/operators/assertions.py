"""Structural assertions: what must hold of a store's view, declared by name and checked in one pass.

A constraint is about a row (``row``), about the rows that agree in some columns (``unique``, ``one_value``), or about the row
that a column names (``refers``). All are compiled into one plan: rows are dealt out by each set of columns once, however
many constraints share it, and once by id for all references; then every row has a flag for each constraint, and one
aggregate counts them and keeps the smallest ids as examples.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palimpsest.functions import dims


@dataclass(frozen=True)
class Constraint:
    name: str
    kind: str  # row, unique, one_value or refers
    keys: tuple[str, ...] = ()
    #: row: what must hold. one_value: which rows count. refers: what must hold between ``target`` and the row.
    holds: str = "true"
    value: str = ""


def row(name: str, holds: str) -> Constraint:
    return Constraint(name, "row", holds=holds)


def unique(name: str, *keys: str) -> Constraint:
    return Constraint(name, "unique", keys)


def one_value(name: str, value: str, *keys: str, among: str = "true") -> Constraint:
    return Constraint(name, "one_value", keys, among, value)


def refers(name: str, column: str, holds: str = "true") -> Constraint:
    return Constraint(name, "refers", (column,), holds)


#: What holds of ``EdgeStore.current``. ``state`` is the predicate, or the state its verb is about.
EDGES = (
    row("has_owner", "id is not null and user_id is not null"),
    row("has_subject_and_predicate", "coalesce(subject, '') <> '' and coalesce(predicate, '') <> ''"),
    row("confirmed_after_learned", "first_learned_at is null or last_confirmed_at is null or first_learned_at <= last_confirmed_at"),
    row("numbered_in_order", "sequence_number is null or last_sequence is null or sequence_number <= last_sequence"),
    row("forgotten_for_a_reason", "tombstoned_at is null or tombstone_reason is not null"),
    row("retired_has_successor", "coalesce(is_current, true) or superseded_by is not null or tombstoned_at is not null"),
    unique("one_edge_a_text", "user_id", "source_text_hash"),
    unique("one_row_an_id", "id"),
    one_value("one_current_value", "lower(trim(object))", "user_id", "lower(trim(subject))", "state", among="coalesce(is_current, true) and tombstoned_at is null"),
    refers("successor_exists", "superseded_by"),
    refers("successor_of_same_user", "superseded_by", "target.user_id = user_id"),
    refers("successor_arrived_later", "superseded_by", "coalesce(target.last_sequence, target.sequence_number, 0) >= coalesce(last_sequence, sequence_number, 0)"),
)


def _flags(edges: DataFrame, constraints: tuple[Constraint, ...]) -> tuple[DataFrame, list[Column]]:
    rows = edges.withColumn("state", dims.state_class(F.col("predicate"))) if "state" not in edges.columns else edges
    flags: list[Column] = []
    by_keys: dict[tuple[str, ...], list[Constraint]] = {}
    for c in constraints:
        if c.kind in ("unique", "one_value"):
            by_keys.setdefault(c.keys, []).append(c)
    for keys, group in by_keys.items():
        w = W.partitionBy(*[F.expr(k) for k in keys])
        for c in group:
            if c.kind == "unique":
                rows = rows.withColumn(f"__{c.name}", F.count(F.lit(1)).over(w) > 1)
            else:
                counts, value = F.expr(c.holds), F.when(F.expr(c.holds), F.expr(c.value))
                rows = rows.withColumn(f"__{c.name}", counts & (F.min(value).over(w) != F.max(value).over(w)))
    named = [c for c in constraints if c.kind == "refers"]
    for column in dict.fromkeys(c.keys[0] for c in named):
        about = [f for f in edges.schema.names if f != "id"]
        targets = edges.groupBy(F.col("id").alias("__id")).agg(*[F.first(f).alias(f) for f in about if f in ("user_id", "sequence_number", "last_sequence", "source_timestamp")])
        targets = targets.select("__id", F.struct(*[f for f in targets.columns if f != "__id"]).alias("target"))
        # rows that name none are not dealt out by it: they would all meet in one task
        naming, rows = rows.where(F.col(column).isNotNull()), rows.where(F.col(column).isNull())
        met = naming.join(targets, F.col(column) == F.col("__id"), "left")
        for c in named:
            if c.keys[0] == column:
                missing = F.col("__id").isNull()
                broken = missing if c.holds == "true" else ~missing & ~F.coalesce(F.expr(c.holds), F.lit(False))
                met, rows = met.withColumn(f"__{c.name}", broken), rows.withColumn(f"__{c.name}", F.lit(False))
        rows = rows.unionByName(met.drop("__id", "target"))
    for c in constraints:
        broken = ~F.coalesce(F.expr(c.holds), F.lit(False)) if c.kind == "row" else F.coalesce(F.col(f"__{c.name}"), F.lit(False))
        flags.append(F.when(broken, F.lit(c.name)))
    return rows, flags


def violations(edges: DataFrame, constraints: tuple[Constraint, ...] = EDGES, examples: int = 5) -> DataFrame:
    """A row for each constraint: ``constraint, n, examples`` (the smallest ids that break it); 0 and none where it holds."""
    rows, flags = _flags(edges, constraints)
    broken = rows.select("id", F.explode(F.array_compact(F.array(*flags))).alias("constraint"))
    at = F.row_number().over(W.partitionBy("constraint").orderBy("id"))
    first = broken.select("constraint", "id").distinct().withColumn("r", at).where(F.col("r") <= examples).groupBy("constraint").agg(F.sort_array(F.collect_list("id")).alias("examples"))
    counted = broken.groupBy("constraint").agg(F.count(F.lit(1)).alias("n"))
    names = edges.sparkSession.createDataFrame([(c.name,) for c in constraints], "constraint string")
    return names.join(counted, "constraint", "left").join(first, "constraint", "left").select("constraint", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("examples", F.array().cast("array<bigint>")).alias("examples"))
