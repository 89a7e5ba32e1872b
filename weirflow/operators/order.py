"""Deterministic orders and exact running sums that do not need one task per key.

A running sum over a whole table, or over a key that holds a third of it, is taken in two
passes: totals per bucket of the order, a small running sum over the buckets, and running
sums inside each bucket. The buckets are ranges of the order, so the result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_HEX = 3


def shuffle_key(seed: int, *ids: str) -> Column:
    """The seeded shuffle: rows in the order of the md5 of seed and id."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def hash_bucket(key: Column) -> Column:
    """Bucket of an md5 order: its first digits."""
    return F.substring(key, 1, BUCKET_HEX)


def id_bucket(df: DataFrame, id_col: str, buckets: int = 4096) -> Column:
    """Bucket of an order by an integer id: equal ranges between its least and greatest."""
    low, high = df.agg(F.min(id_col), F.max(id_col)).first()
    width = max(1, ((high or 0) - (low or 0)) // buckets + 1)
    return F.floor((F.col(id_col) - F.lit(low or 0)) / F.lit(width)).cast("bigint")


def running(df: DataFrame, keys: list[str], order: list[str], bucket: Column, values: dict[str, Column], totals: bool = False) -> DataFrame:
    """``df`` with, for each of ``values``, its sum over the rows up to and including this
    one in ``order`` within ``keys``; with ``totals`` also ``<name>_all``, the key's sum.
    ``bucket`` must rise with ``order``; ``order`` must be total within a key."""
    data = df.withColumn("__b", bucket)
    names = list(values)
    data = data.withColumns({f"__v_{n}": v.cast("bigint") for n, v in values.items()})
    per = data.groupBy(*keys, "__b").agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in names])
    upto = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    before = per.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__b").alias("__kb"), *[F.coalesce(F.sum(f"__s_{n}").over(upto), F.lit(0)).alias(f"__o_{n}") for n in names],
        *([F.sum(f"__s_{n}").over(whole).alias(f"{n}_all") for n in names] if totals else []))
    condition = F.col("__b").eqNullSafe(F.col("__kb"))
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    joined = data.join(before, condition, "left").drop("__kb", *[f"__k_{k}" for k in keys])
    inside = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = joined.withColumns({n: (F.col(f"__o_{n}") + F.sum(f"__v_{n}").over(inside)).cast("bigint") for n in names})
    return out.drop("__b", *[f"__v_{n}" for n in names], *[f"__o_{n}" for n in names])


def position(df: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str = "rn", totals: bool = False) -> DataFrame:
    """1-based place of each row in ``order`` within ``keys``."""
    return running(df, keys, order, bucket, {name: F.lit(1)}, totals)
