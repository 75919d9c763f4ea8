"""File sources and sinks: JSON lines, story files, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lines; blank ones are skipped, and a line that is no JSON is kept in ``_corrupt_record``."""
    reader = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


STORY = "story_id LONG, title STRING, batches ARRAY<STRUCT<batch: LONG, time: STRING, user_input: STRING, model_response: STRING>>, questions ARRAY<STRUCT<question: STRING, expected_contains: ARRAY<STRING>>>"


def _story(raw: bytes) -> dict:
    import yaml

    s = yaml.safe_load(raw.decode("utf-8")) or {}
    as_list = lambda v: [] if v is None else [str(x) for x in v] if isinstance(v, list) else [str(v)]
    ask = s.get("final_verification") or s.get("questions") or []
    ask = ask.get("questions", []) if isinstance(ask, dict) else ask
    return {
        "story_id": int(s.get("story_id") or 0),
        "title": s.get("story_name") or s.get("title"),
        "batches": [{"batch": b.get("batch"), "time": b.get("time"), "user_input": b.get("user_input"), "model_response": b.get("model_response")} for b in s.get("batches") or []],
        "questions": [{"question": q.get("question"), "expected_contains": as_list(q.get("expected_contains"))} for q in ask],
    }


def read_stories(spark: SparkSession, path: str) -> DataFrame:
    """YAML stories of a folder, parsed where they are read."""
    parse = F.udf(lambda raw: json.dumps(_story(bytes(raw)), default=str), "string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.y*ml").option("recursiveFileLookup", True).load(path)
    return files.select(F.from_json(parse("content"), STORY).alias("s")).select("s.*")


def write_report(per_item: DataFrame, totals: DataFrame, path: str) -> None:
    """A report: one JSON object with the totals and a line for each item."""
    totals.coalesce(1).write.mode("overwrite").json(f"{path}/totals")
    per_item.write.mode("overwrite").json(f"{path}/items")
