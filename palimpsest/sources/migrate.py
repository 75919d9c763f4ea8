"""Copying and re-embedding tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest import schemas


def copied(old: DataFrame, path: str) -> DataFrame:
    """Write rows in the edge schema, with hashes where they lack them, and read them back; counts must agree."""
    rows = schemas.conform(old).withColumn("source_text_hash", F.coalesce("source_text_hash", F.sha2(F.col("source_text").cast("binary"), 256)))
    rows.write.mode("errorifexists").parquet(path)
    new = old.sparkSession.read.parquet(path)
    if (a := old.count()) != (b := new.count()):
        raise RuntimeError(f"{b} rows were written of {a}")
    return new


def reembedded(edges: DataFrame, embed: Callable[[Column], Column], only_missing: bool = False) -> DataFrame:
    """Edges with vectors of their natural wording; ``only_missing`` leaves known vectors alone."""
    wording = F.concat_ws(" ", "subject", F.translate("predicate", "_", " "), "object")
    made = embed(wording)
    return edges.withColumn("embedding", F.coalesce("embedding", made) if only_missing else made)
