"""SQL functions of the engine."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import temporal
from palimpsest.functions.embed import embedder
from palimpsest.operators.analyze import DECOMPOSITION, rules

_SQL = {
    "pal_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(zip_with(slice(a, 1, least(size(a), size(b))), slice(b, 1, least(size(a), size(b))), (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "pal_norm(a ARRAY<DOUBLE>) RETURNS DOUBLE": "sqrt(aggregate(a, 0D, (s, x) -> s + x * x))",
    "pal_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "CASE WHEN pal_norm(a) * pal_norm(b) = 0 THEN 0D ELSE pal_dot(a, b) / (pal_norm(a) * pal_norm(b)) END",
    "pal_staleness(at TIMESTAMP, now TIMESTAMP) RETURNS DOUBLE": "CASE WHEN at IS NULL OR at >= now THEN 1D ELSE exp(-(unix_micros(now) - unix_micros(at)) / 1e6D / 2592000D) END",
    "pal_days_until(at TIMESTAMP, now TIMESTAMP) RETURNS DOUBLE": "(unix_micros(at) - unix_micros(now)) / 86400e6D",
    "pal_normalised(t STRING) RETURNS STRING": "trim(regexp_replace(regexp_replace(lower(translate(coalesce(t, ''), '_', ' ')), '[^a-z0-9 ]', ''), ' +', ' '))",
}


_COUNTED = "concat(CASE WHEN {ahead} THEN 'in ' ELSE '' END, CAST({n} AS STRING), ' {unit}', CASE WHEN {n} = 1 THEN '' ELSE 's' END, CASE WHEN {ahead} THEN '' ELSE ' ago' END)"
_STEPS = [(30, 7, "week"), (365, 30, "month"), (None, 365, "year")]


def _proximity() -> str:
    """``temporal.proximity`` as SQL over a number of days ``d``."""
    counted = lambda n, unit: _COUNTED.format(ahead="d > 0", n=n, unit=unit)
    steps = " ".join(f"WHEN {f'abs(d) < {below}' if below else 'd IS NOT NULL'} THEN {counted(f'CAST(bround(abs(d) / {per}) AS BIGINT)', unit)}" for below, per, unit in _STEPS)
    near = "WHEN abs(d) < 0.04 THEN 'right now' WHEN abs(d) < 1 THEN CASE WHEN d > 0 THEN 'today' ELSE 'earlier today' END WHEN abs(d) < 2 THEN CASE WHEN d > 0 THEN 'tomorrow' ELSE 'yesterday' END"
    return f"CASE {near} WHEN abs(d) < 7 THEN {counted('CAST(bround(abs(d)) AS BIGINT)', 'day')} {steps} END"


def _humanize() -> str:
    """``temporal.humanize`` as SQL over a number of seconds ``s``."""
    each = lambda per, unit: f"concat(CAST(floor(s / {per}) AS STRING), ' {unit}', CASE WHEN floor(s / {per}) = 1 THEN '' ELSE 's' END)"
    steps = [(3600, 60, "minute"), (86400, 3600, "hour"), (604800, 86400, "day"), (2592000, 604800, "week")]
    return f"CASE WHEN s < 60 THEN 'just now' {' '.join(f'WHEN s < {below} THEN {each(per, unit)}' for below, per, unit in steps)} WHEN s IS NOT NULL THEN {each(2592000, 'month')} END"


_WORDS = "array_distinct(filter(split(lower(coalesce({c}, '')), '\\\\s+'), w -> w <> ''))"
_SQL |= {
    "pal_proximity_days(d DOUBLE) RETURNS STRING": _proximity(),
    "pal_proximity(at TIMESTAMP, now TIMESTAMP) RETURNS STRING": "pal_proximity_days(pal_days_until(at, now))",
    "pal_humanize(s DOUBLE) RETURNS STRING": _humanize(),
    "pal_token_f1(a STRING, b STRING) RETURNS DOUBLE": f"CASE WHEN size(array_intersect({_WORDS.format(c='a')}, {_WORDS.format(c='b')})) = 0 THEN 0D ELSE 2D * size(array_intersect({_WORDS.format(c='a')}, {_WORDS.format(c='b')})) / (size({_WORDS.format(c='a')}) + size({_WORDS.format(c='b')})) END",
}


class Decompose:
    """A table function: a row for each sentence of a text that has a verb."""

    def eval(self, text: str, speaker: str, listener: str):
        names = [c.split()[0] for c in DECOMPOSITION.split(", ")]
        for row in rules(text or "", speaker or "user", listener or "assistant"):
            yield tuple(row[c] for c in names)


def _sql_of(column: Column) -> str:
    """A column expression as SQL: operators, which Spark prints as functions, get the quotes that make them such."""
    printed = column._jc.node().sql().split("'")
    return "'".join(re.sub(r"(?<![\w`])(<=>|>=|<=|[-+*/%=<>]|AND|OR|NOT)\(", r"`\1`(", part) if k % 2 == 0 else part for k, part in enumerate(printed))


def register(spark: SparkSession) -> list[str]:
    """Create the functions for this session; their names."""
    dated = _sql_of(temporal.resolve_date(F.col("e"), F.col("at")))
    names = []
    for head, body in [*_SQL.items(), ("pal_resolve_date(e STRING, at TIMESTAMP_NTZ) RETURNS TIMESTAMP_NTZ", dated)]:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
        names.append(head.split("(")[0])
    spark.udf.register("pal_embed", embedder())
    spark.udtf.register("pal_decompose", F.udtf(Decompose, returnType=DECOMPOSITION))
    return [*names, "pal_embed", "pal_decompose"]
