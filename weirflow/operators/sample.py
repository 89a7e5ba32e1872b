"""Budgets, exact splits, interleaving and shards: everything that depends on an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.operators.order import hash_bucket, id_bucket, position, running, shuffle_key

SPLITS = ("train", "val", "test")


def budget_take(df: DataFrame, budgets: dict[str, int], tokens: Column, lang: str = "lang", order: str = "doc_id") -> DataFrame:
    """Documents in ``order`` while the running token count stays within the budget of their
    language: a prefix, nothing is skipped over. Languages without a budget give nothing."""
    limit = F.create_map(*[x for k, v in budgets.items() for x in (F.lit(k), F.lit(v))])
    data = df.where(F.col(lang).isin(list(budgets))).withColumn("tokens", tokens.cast("bigint"))
    run = running(data, [lang], [order], id_bucket(data, order), {"run": F.col("tokens")})
    return run.where(F.col("run") <= limit[F.col(lang)])


def split_counts(n: Column, ratio: tuple[float, float, float], boundary: str = "cumulative") -> tuple[Column, Column]:
    """Where train and val end among ``n`` shuffled documents. ``cumulative`` cuts at
    int(n r0) and int(n (r0 + r1)), ``separate`` at int(n r0) and int(n r0) + int(n r1)."""
    first = F.floor(n * F.lit(ratio[0]))
    second = F.floor(n * F.lit(ratio[0] + ratio[1])) if boundary == "cumulative" else first + F.floor(n * F.lit(ratio[1]))
    return first, second


def exact_split(df: DataFrame, keys: list[str], id_col: str, ratio: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42, boundary: str = "cumulative") -> DataFrame:
    """``df`` with ``split``: exact counts per ``keys`` in the seeded shuffle order."""
    if abs(sum(ratio) - 1) > 1e-6:
        raise ValueError("split ratios must sum to 1")
    data = df.withColumn("__o", shuffle_key(seed, id_col))
    placed = position(data, keys, ["__o", id_col], hash_bucket(F.col("__o")), "__rn", totals=True)
    first, second = split_counts(F.col("__rn_all"), ratio, boundary)
    return placed.withColumn("split", F.when(F.col("__rn") <= first, "train").when(F.col("__rn") <= second, "val").otherwise("test")).drop("__o", "__rn", "__rn_all")


def split_totals(df: DataFrame, lang: str = "lang") -> DataFrame:
    """Documents per language and split, per language, and in all (nulls mark the sums)."""
    return df.rollup(lang, "split").agg(F.count(F.lit(1)).alias("docs"))


def interleave(df: DataFrame, side: Column, id_col: str, keys: list[str] = (), share: tuple[float, float] = (0.6, 0.4), seed: int = 42) -> DataFrame:
    """``df`` with ``round`` and ``shuffle``: both sides shuffled, rounds of ten with
    int(10 a / (a + b)) rows of the first side and the rest of the second, shuffled within a
    round; a side that runs out leaves the rounds to the other. Order by ``keys``, ``round``,
    ``shuffle``, id."""
    if abs(sum(share) - 1) > 1e-6:
        raise ValueError("ratios must sum to 1")
    quota = int(10 * share[0] / (share[0] + share[1]))
    data = df.withColumn("__first", side).withColumn("shuffle", shuffle_key(seed, id_col))
    placed = position(data, [*keys, "__first"], ["shuffle", id_col], hash_bucket(F.col("shuffle")), "__rn")
    per = F.when(F.col("__first"), F.lit(quota)).otherwise(F.lit(10 - quota))
    if quota in (0, 10):
        per = F.lit(10)
    return placed.withColumn("round", F.floor((F.col("__rn") - 1) / per).cast("bigint")).drop("__first", "__rn")


def epoch_order(df: DataFrame, id_col: str, epoch: int, seed: int = 42, keys: list[str] = ()) -> DataFrame:
    """1-based place of each sample in the permutation of an epoch."""
    data = df.withColumn("__o", shuffle_key(seed + epoch, id_col))
    return position(data, list(keys), ["__o", id_col], hash_bucket(F.col("__o")), "place", totals=True).drop("__o") if keys else position(data.withColumn("__k", F.lit(0)), ["__k"], ["__o", id_col], hash_bucket(F.col("__o")), "place", totals=True).drop("__o", "__k")


def worker_shards(df: DataFrame, workers: int, place: str = "place", total: str = "place_all") -> DataFrame:
    """Contiguous ranges of the places, the remainder to the last worker; with fewer rows
    than workers the last one gets all."""
    per = F.floor(F.col(total) / workers)
    return df.withColumn("worker", F.when(per == 0, F.lit(workers - 1)).otherwise(F.least(F.floor((F.col(place) - 1) / F.greatest(per, F.lit(1))), F.lit(workers - 1))).cast("int"))


def batches(df: DataFrame, size: int, drop_last: bool = True, place: str = "place", total: str = "place_all") -> DataFrame:
    """Groups of ``size`` rows by place; ``drop_last`` leaves out the incomplete one."""
    out = df.withColumn("batch", F.floor((F.col(place) - 1) / size).cast("bigint"))
    return out.where(F.col("batch") < F.floor(F.col(total) / size)) if drop_last else out


def gumbel_pick(df: DataFrame, keys: list[str], id_col: str, logit: str, temperature: float = 0.6, seed: int = 42) -> DataFrame:
    """One id per key drawn in proportion to softmax(logit / temperature): the greatest
    probability by exponential noise. The noise is the md5 of seed, keys and id."""
    told = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.col(id_col).cast("string")))
    u = (F.conv(F.substring(told, 1, 12), 16, 10).cast("bigint") + 0.5) / float(1 << 48)
    score = F.col(logit) / max(temperature, 1e-5) - F.log(-F.log(u))
    return df.groupBy(*keys).agg(F.max_by(id_col, score).alias(id_col))
