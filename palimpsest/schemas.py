"""Declared schemas, and conforming older data to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"long": T.LongType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "time": T.TimestampNTZType(), "strings": T.ArrayType(T.StringType()), "vector": T.ArrayType(T.FloatType())}


def _struct(fields: str) -> T.StructType:
    """``"a b: string, c: long"``: columns by kind."""
    groups = (g.split(":") for g in fields.split(","))
    return T.StructType([T.StructField(n, _KINDS[kind.strip()]) for names, kind in groups for n in names.split()])


_QUESTION = T.StructType([T.StructField("text", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])

EDGE = _struct(
    "id user_id: long, subject predicate object object_full source_text source_text_hash source_tag: string, created_at source_timestamp resolved_event_date: time, "
    "temporal_expression schematic temporal_context relational_type significance: string, valence: double, emotion emotion_target: string, entities: strings, "
    "context_entity episodic_fact mood: string, negated is_historical is_current: boolean, superseded_at: time, superseded_by: long, tombstoned_at: time, tombstone_reason: string, "
    "first_learned_at last_confirmed_at: time, cluster_id: long, arc_id: string, sequence_number last_sequence: long, subject_type object_type: string, affiliation confidence: double, embedding: vector, vqs: strings"
).add("pqs", T.ArrayType(_QUESTION))

#: What a column holds in rows written before it existed.
EDGE_DEFAULTS = {"schematic": "uncategorized", "temporal_context": "present", "relational_type": "personal", "significance": "routine", "valence": 0.5, "confidence": 0.9, "is_current": True, "negated": False, "is_historical": False, "subject_type": "GENERIC", "object_type": "GENERIC"}

UTTERANCE = _struct("user_id: long, text speaker listener: string, ts: time, tag: string")


def conform(df: DataFrame, schema: T.StructType = EDGE, defaults: dict | None = None) -> DataFrame:
    """``df`` with exactly the columns of ``schema``, in its order: missing ones get their default, others are cast."""
    defaults = EDGE_DEFAULTS if defaults is None else defaults
    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`").cast(f.dataType) if f.name in have else F.lit(defaults.get(f.name)).cast(f.dataType)).alias(f.name) for f in schema.fields])


def problems(df: DataFrame, schema: T.StructType = EDGE) -> list[str]:
    """What keeps ``df`` from having ``schema``: missing columns and other types."""
    have = {f.name: f.dataType for f in df.schema.fields}
    return [f"{f.name}: missing" if f.name not in have else f"{f.name}: {have[f.name].simpleString()} is not {f.dataType.simpleString()}" for f in schema.fields if have.get(f.name) != f.dataType]
