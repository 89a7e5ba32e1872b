"""Token arrays: a stand-in tokenizer, totals, the flat stream, windows and next-token pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mock_encode(c: Column, vocab: int = 6400, eos: int = 2) -> Column:
    """Code points of the whole text modulo the vocabulary, then the end mark; nothing for an
    empty or null text. Stands in where no tokenizer is loaded. An Arrow UDF: in built-in
    functions each character would become a string of its own."""
    import pandas as pd

    def encode(s):
        import numpy as np

        def ids(t):
            if not t:
                return np.zeros(0, np.int32)
            return np.append(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) % vocab, eos).astype(np.int32)

        return s.map(ids, na_action=None)

    encode.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(encode, "array<int>")(c)


def reference_encode(c: Column, vocab: int = 6400, eos: int = 2) -> Column:
    """``mock_encode`` of the first 1,000 characters only, as the reference does without a
    tokenizer; what follows is lost."""
    return mock_encode(F.substring(c, 1, 1000), vocab, eos)


def clamp(ids: Column, vocab: int = 6400) -> Column:
    """Ids beyond the vocabulary become its last."""
    return F.transform(ids, lambda x: F.least(x, F.lit(vocab - 1)))


def tokenize(df: DataFrame, text: str = "text", encoder: Callable[..., Column] = mock_encode, **how) -> DataFrame:
    """``token_ids`` and ``length`` in place of the text; documents without tokens dropped.
    ``encoder`` makes the column of ids from that of the text, with ``how``."""
    return df.withColumn("token_ids", encoder(F.col(text), **how)).withColumn("length", F.size("token_ids")).where("length > 0").drop(text)


def token_totals(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.size("token_ids")), F.lit(0)).cast("bigint").alias("tokens"))


def placed(df: DataFrame, order: list[str], bucket: Column, ids: str = "token_ids", keys: list[str] = ()) -> DataFrame:
    """``__k_<key>.., __bucket, __at, __ids``: each document's ids with the place of its first
    one in the flat stream of its key, whose documents stand in order. Null lists count as
    empty; documents of equal keys and order count once. The ids are moved once, by key and
    bucket; the sums over buckets come from sizes alone."""
    keys_ = [F.col(k).alias(f"__k_{k}") for k in keys] or [F.lit(0).alias("__k_")]
    names = [f"__k_{k}" for k in keys] or ["__k_"]
    data = df.select(*keys_, *[F.col(o).alias(f"__o_{o}") for o in order], F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("__ids"), bucket.alias("__bucket"))
    at = [f"__o_{o}" for o in order]
    sizes = data.groupBy(*names, "__bucket", *at).agg(F.first(F.size("__ids")).cast("bigint").alias("__n"))
    per = sizes.groupBy(*names, "__bucket").agg(F.sum("__n").alias("__n"))
    before = per.select(*[F.col(x).alias(f"_{x}") for x in names], F.col("__bucket").alias("___bucket"), F.coalesce(F.sum("__n").over(Window.partitionBy(*names).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    same = F.lit(True)
    for x in (*names, "__bucket"):
        same = same & F.col(x).eqNullSafe(F.col(f"_{x}"))
    inside = Window.partitionBy(*names, "__bucket").orderBy(*at)
    told = data.join(before, same, "left").withColumn("__again", F.coalesce(F.lag(F.lit(True)).over(inside) & F.struct(*at).eqNullSafe(F.lag(F.struct(*at)).over(inside)), F.lit(False)))
    kept = told.withColumn("__own", F.when(F.col("__again"), F.lit(0)).otherwise(F.size("__ids")).cast("bigint"))
    upto = kept.withColumn("__upto", F.sum("__own").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return upto.where(~F.col("__again")).select(*names, "__bucket", (F.col("__base") + F.col("__upto") - F.col("__own")).alias("__at"), "__ids")


def stream(df: DataFrame, order: list[str], bucket: Column, ids: str = "token_ids", keys: list[str] = ()) -> DataFrame:
    """``keys, gpos, token``: the ids of all documents in order as one flat stream per key,
    ``gpos`` counting from 0, for operators on single positions."""
    flat = placed(df, order, bucket, ids, keys).select(*[F.col(f"__k_{k}").alias(k) for k in keys], "__at", F.posexplode("__ids").alias("__p", "token"))
    return flat.select(*keys, (F.col("__at") + F.col("__p")).alias("gpos"), "token")


def pieces(df: DataFrame, order: list[str], bucket: Column, n: int, ids: str = "token_ids", keys: list[str] = ()) -> DataFrame:
    """``__k_<key>.., __bucket, sample, p``: the ids of each document cut where stretches of
    ``n`` positions end; ``p`` is the place of the piece's first id and its ids."""
    names = [f"__k_{k}" for k in keys] or ["__k_"]
    docs = placed(df, order, bucket, ids, keys).where(F.size("__ids") > 0)
    first, last = F.floor(F.col("__at") / n), F.floor((F.col("__at") + F.size("__ids") - 1) / n)
    cut = docs.select(*names, "__bucket", "__at", "__ids", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))).alias("sample"))
    begin = F.greatest(F.col("sample") * n - F.col("__at"), F.lit(0)).cast("int")
    piece = F.slice("__ids", begin + 1, F.least((F.col("sample") + 1) * n - F.col("__at") - begin, F.size("__ids") - begin).cast("int"))
    return cut.select(*names, "__bucket", "sample", F.struct((F.col("__at") + begin).alias("at"), piece.alias("ids")).alias("p"))


def parts(df: DataFrame, order: list[str], bucket: Column, n: int, ids: str = "token_ids", keys: list[str] = ()) -> DataFrame:
    """``keys, part, at, ids``: the pieces of the flat stream for files of ``n`` ids each."""
    return pieces(df, order, bucket, n, ids, keys).select(*[F.col(f"__k_{k}").alias(k) for k in keys], F.col("sample").alias("part"), "p.at", "p.ids")


def windows(df: DataFrame, order: list[str], bucket: Column, context: int = 512, ids: str = "token_ids", keys: list[str] = ()) -> DataFrame:
    """``keys, sample, ids``: windows of ``context + 1`` tokens side by side over the flat
    stream; the incomplete tail is dropped. The pieces of windows that lie within a bucket
    are put together where they are, and only those of windows across buckets move again."""
    n = context + 1
    names = [f"__k_{k}" for k in keys] or ["__k_"]
    joined = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["ids"]))
    near = pieces(df, order, bucket, n, ids, keys).groupBy(*names, "__bucket", "sample").agg(F.min("p.at").alias("at"), joined("p").alias("ids"))
    whole = near.where(F.size("ids") == n).select(*names, "sample", "ids")
    open_ = near.where(F.size("ids") < n).select(*names, "sample", F.struct("at", "ids").alias("p"))
    across = open_.groupBy(*names, "sample").agg(joined("p").alias("ids")).where(F.size("ids") == n)
    return whole.unionByName(across).select(*[F.col(f"__k_{k}").alias(k) for k in keys], "sample", "ids")


def next_token_pairs(samples: DataFrame) -> DataFrame:
    """``x`` and ``y``: a window without its last and without its first token."""
    n = F.size("ids") - 1
    return samples.withColumn("x", F.slice("ids", F.lit(1), n)).withColumn("y", F.slice("ids", F.lit(2), n)).drop("ids")


def recent(flat: DataFrame, size: int, keys: list[str]) -> DataFrame:
    """``recent``: the positions of the last ``size`` tokens up to each one, filled with -1."""
    low = F.greatest(F.col("gpos") - (size - 1), F.lit(0))
    seen = F.sequence(low, F.col("gpos"))
    return flat.withColumn("recent", F.concat(seen, F.array_repeat(F.lit(-1).cast("bigint"), (F.lit(size) - F.size(seen)).cast("int"))))


def completed_blocks(pos: Column, ratio: int) -> Column:
    """Indices of the blocks of ``ratio`` positions that are complete at a position."""
    n = F.floor((pos + 1) / ratio).cast("int")
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def pool_blocks(df: DataFrame, keys: list[str], pos: str, value: str, score: str, ratio: int, overlap: bool = False) -> DataFrame:
    """Blocks of ``ratio`` positions as one value: the softmax-weighted mean of theirs, the
    block's greatest score taken off first, so that no exponent overflows. With ``overlap`` a
    block also sees the ``ratio`` positions before it."""
    block = F.floor(F.col(pos) / ratio).cast("bigint")
    seen = df.select(*keys, (F.explode(F.array(block, block + 1)) if overlap else block).alias("block"), block.alias("__own"), F.col(value).alias("__v"), F.col(score).cast("double").alias("__s"))
    top = seen.groupBy(*keys, "block").agg(F.max("__s").alias("__top"), F.max("__own").alias("__last"), F.collect_list(F.struct("__s", "__v")).alias("__all"))
    weight = lambda x: F.exp(x["__s"] - F.col("__top"))
    total = lambda f: F.aggregate(F.transform("__all", f), F.lit(0.0), lambda a, x: a + x)
    return top.where(F.col("__last") == F.col("block")).select(*keys, "block", (total(lambda x: weight(x) * x["__v"]) / total(weight)).alias("pooled"), F.size("__all").cast("bigint").alias("n"))


def causal(left: Column, right: Column) -> Column:
    """Whether a position may look at another: not at later ones."""
    return right <= left
