"""Vector lookups, neighbours and scatter sums over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.functions.vectors import dot, l2_norm
from weirflow.session import cut_lineage


def lookup(ids: DataFrame, table: DataFrame, id_col: str, key: str, vector: str) -> DataFrame:
    """Each id with its vector; ids outside the table get null. Spark broadcasts the table
    if its size allows it."""
    return ids.join(table.select(F.col(key).alias("__k"), vector), F.col(id_col) == F.col("__k"), "left").drop("__k")


def gather(positions: DataFrame, pos: str, table: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """Vectors by position; -1 and missing positions give zeros."""
    zero = F.array_repeat(F.lit(0.0), dim)
    return lookup(positions, table, pos, key, vector).withColumn(vector, F.coalesce(F.transform(vector, lambda x: x.cast("double")), zero))


def nearest(queries: DataFrame, table: DataFrame, key: str, vector: str, k: int, block: int = 512) -> DataFrame:
    """The ``k`` vectors of greatest cosine for each query, itself apart; ties go to the
    smaller id. A stated query set against all rows: the queries are packed into blocks of
    about ``block``, every row meets every block, and a row's scores are cut to the best per
    query by the window's partial limit. Unit vectors are computed once and written."""
    def unit(df: DataFrame, name: str) -> DataFrame:
        return cut_lineage(df.select(F.col(key).alias(name), vector).withColumn("norm", F.greatest(l2_norm(F.col(vector)), F.lit(1e-12)))).select(name, F.transform(vector, lambda x: x.cast("double")).alias(f"{name}_v"), F.col("norm").alias(f"{name}_n"))

    q, rows = unit(queries, "q"), unit(table, "id")
    n = max(1, -(-q.count() // block))
    blocks = q.groupBy(F.pmod(F.xxhash64("q"), F.lit(n)).alias("block")).agg(F.collect_list(F.struct("q", "q_v", "q_n")).alias("qs"))
    met = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))).join(blocks, "block").select("id", "id_v", "id_n", F.explode("qs").alias("x")).where(F.col("x.q") != F.col("id"))
    scored = met.select(F.col("x.q").alias("q"), "id", (F.aggregate(F.zip_with("x.q_v", "id_v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x) / F.col("x.q_n") / F.col("id_n")).alias("score"))
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def indexed_blocks(queries: DataFrame, blocks: DataFrame, key: str, pos: str, query: str, weights: str, block: str, vector: str, k: int, ratio: int, offset: int = 0) -> DataFrame:
    """``picked``: for each position the ``k`` blocks of its sequence with the greatest score,
    best first, plus ``offset``; -1 where it sees fewer. The score is the weighted sum over the
    heads of the positive part of query head times block vector; a position sees the blocks of
    ``ratio`` positions that end with or before it. ``query`` holds the heads one after
    another. A sequence's blocks travel as one array, so no pair becomes a row."""
    of = blocks.groupBy(F.col(key).alias("__k")).agg(F.array_sort(F.collect_list(F.struct(F.col(block).cast("int").alias("b"), F.transform(vector, lambda x: x.cast("double")).alias("v")))).alias("__all"))
    seen = F.filter(F.coalesce("__all", F.array().cast("array<struct<b:int,v:array<double>>>")), lambda x: x["b"] < F.floor((F.col(pos) + 1) / ratio))

    def score(x):
        dim = F.size(x["v"])
        heads = F.transform(F.col(weights), lambda w, h: w.cast("double") * F.greatest(F.lit(0.0), dot(F.slice(F.col(query), h * dim + 1, dim), x["v"])))
        return F.struct((-F.aggregate(heads, F.lit(0.0), lambda a, y: a + y)).alias("neg"), x["b"].alias("b"))

    best = F.transform(F.slice(F.array_sort(F.transform(seen, score)), 1, k), lambda x: x["b"] + offset)
    return queries.join(of, F.col(key) == F.col("__k"), "left").withColumn("picked", F.concat(best, F.array_repeat(F.lit(-1), (F.lit(k) - F.size(best)).cast("int")))).drop("__k", "__all")


def scatter_sum(routed: DataFrame, token: str, weight: str, output: str) -> DataFrame:
    """Weighted outputs summed per token."""
    return routed.groupBy(token).agg(F.sum(F.col(weight) * F.col(output)).alias("sum"))


def scatter_vectors(routed: DataFrame, token: str, weight: str, vector: str) -> DataFrame:
    """Weighted vectors summed per token, element by element: partial sums before the shuffle."""
    flat = routed.select(token, F.col(weight).cast("double").alias("__w"), F.posexplode(vector).alias("__i", "__x"))
    per = flat.groupBy(token, "__i").agg(F.sum(F.col("__w") * F.col("__x")).alias("__s"))
    return per.groupBy(token).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__s"))), lambda x: x["__s"]).alias("sum"))


def vector_stats(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Vectors, greatest absolute value and root of the summed squares per key."""
    v = F.transform(vector, lambda x: x.cast("double"))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("vectors"), F.max(F.array_max(F.transform(v, lambda x: F.abs(x)))).alias("abs_max"), F.sqrt(F.sum(dot(v, v))).alias("norm"))
