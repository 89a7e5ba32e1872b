"""Evaluation aggregates and schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def perplexity(df: DataFrame, loss: str, tokens: str, keys: list[str] = ()) -> DataFrame:
    """exp of the summed loss by the summed tokens; null where there are no tokens."""
    n = F.sum(tokens)
    return df.groupBy(*keys).agg(F.when(n > 0, F.exp(F.sum(loss) / n)).alias("ppl"))


def mean_of_first(df: DataFrame, value: str, order: list[str], most: int = 100) -> DataFrame:
    """Plain mean over the first ``most`` rows; 0.0 for none."""
    return df.orderBy(*order).limit(most).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"))


def best_so_far(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("best", F.min(value).over(w))


def trailing_mean(df: DataFrame, keys: list[str], order: list[str], value: str, size: int = 10) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(size - 1), 0)
    return df.withColumn("trailing", F.avg(value).over(w))


def throughput(tokens: Column, seconds: Column) -> Column:
    return tokens / F.greatest(seconds, F.lit(1e-6))


def learning_rate(step: Column, warmup: int = 4000, peak: int = 8000, cosine: int = 28_920, high: float = 3e-4, low: float = 3e-5) -> Column:
    """Linear rise, plateau, cosine fall to ``low``."""
    progress = F.least((step - warmup - peak) / max(1, cosine), F.lit(1.0))
    fall = F.lit(low) + F.lit(high - low) * 0.5 * (1 + F.cos(F.lit(math.pi) * progress))
    return F.when(step < warmup, F.lit(high) * (step / max(1, warmup))).when(step < warmup + peak, F.lit(high)).otherwise(fall)


def auxiliary_weight(step: Column, warmup: int = 4000, peak: int = 8000, cosine: int = 28_920, first: float = 0.3, last: float = 0.1) -> Column:
    """The first weight until the plateau ends, then a linear way to the last."""
    progress = F.least((step - warmup - peak) / max(1, cosine), F.lit(1.0))
    return F.when(step < warmup + peak, F.lit(first)).otherwise(F.lit(first) + F.lit(last - first) * progress)


def stage_totals(log: DataFrame, keys: list[str]) -> DataFrame:
    """Per key set, and rolled up: runs, documents in and out, seconds; each log row once."""
    once = log.dropDuplicates(["log_id"])
    return once.rollup(*keys).agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("docs_in"), F.lit(0)).cast("bigint").alias("docs_in"), F.coalesce(F.sum("docs_out"), F.lit(0)).cast("bigint").alias("docs_out"))
