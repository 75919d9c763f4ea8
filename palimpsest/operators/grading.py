"""Grading answers and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text, vector

DISTRACTORS = 40


def graded(answers: DataFrame, strict: float = 0.3) -> DataFrame:
    """``answers(answer, gold, must_refuse, refused)`` with ``f1`` and ``passed``: a refusal where one is due, else an F1 of ``strict``."""
    scored = answers.withColumn("f1", text.token_f1(F.col("answer"), F.col("gold")))
    return scored.withColumn("passed", F.when(F.col("must_refuse"), F.col("refused")).otherwise(~F.col("refused") & (F.col("f1") >= strict)))


def pass_rates(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts and rates by key, with totals."""
    return rows.rollup(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("n_passed"), F.avg(F.col("passed").cast("double")).alias("rate"), F.grouping_id().alias("level"))


def above_distractors(answer: Column, keyword: Column, others: Column) -> Column:
    """Whether a keyword's vector is nearer to the answer's than the mean of the first ``DISTRACTORS`` other keywords' are."""
    some = F.slice(others, 1, DISTRACTORS)
    mean = F.aggregate(F.transform(some, lambda o: vector.cosine(answer, o)), F.lit(0.0), lambda s, x: s + x) / F.size(some)
    return F.when(F.size(some) > 0, vector.cosine(answer, keyword) > mean).otherwise(vector.cosine(answer, keyword) > 0)


def latencies(rows: DataFrame, column: str, *keys: str) -> DataFrame:
    """Least, middle, 95th percentile and largest of a column."""
    c = F.col(column)
    return rows.groupBy(*keys).agg(F.min(c).alias("least"), F.percentile(c, F.lit(0.5)).alias("middle"), F.percentile(c, F.lit(0.95)).alias("p95"), F.max(c).alias("largest"))
