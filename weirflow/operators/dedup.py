"""Exact and near duplicates.

``exact_dedup`` keeps the least id of each key. ``near_duplicates`` finds all pairs of texts
whose sets of unordered five-word shingles have a Jaccard similarity of at least the
threshold, by an inverted index over the rarest shingles only: two sets that similar must
share one of their ``n - ceil(t n) + 1`` rarest shingles under any common order, so the
prefix join loses nothing. Exact copies are reduced to one representative before and come
back as members of its class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.functions.text import dedup_key, split_words
from weirflow.session import cut_lineage


def exact_dedup(df: DataFrame, text: str, order: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per ``keys`` and text: that of the least ``order``. The least is found by a
    partial aggregate, so a text that a third of all rows share does not gather."""
    data = df.withColumn("__h", dedup_key(F.col(text)))
    rest = [c for c in df.columns]
    best = data.groupBy(*keys, "__h").agg(F.min_by(F.struct(*rest), F.col(order)).alias("r"))
    return best.select("r.*")


def dedup_stats(df: DataFrame, text: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Total, unique and duplicate rows and the ratio of duplicates (0 for no rows)."""
    per = df.groupBy(*keys, dedup_key(F.col(text)).alias("__h")).agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total"), F.count(F.lit(1)).alias("uniq"))
    return out.withColumn("duplicates", F.col("total") - F.col("uniq")).withColumn("ratio", F.when(F.col("total") > 0, F.col("duplicates") / F.col("total")).otherwise(F.lit(0.0)))


def unseen(df: DataFrame, seen: DataFrame, text: str) -> DataFrame:
    """Rows whose text is not among the texts seen before."""
    return df.withColumn("__h", dedup_key(F.col(text))).join(seen.select(dedup_key(F.col(text)).alias("__h")).distinct(), "__h", "left_anti").drop("__h")


def shingles(c: Column, size: int = 5) -> Column:
    """Hashes of the distinct runs of ``size`` words, the words of a run unordered and
    distinct; none for fewer words."""
    def runs(words: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(words) - (size - 1), F.lit(1)))
        hashed = F.transform(at, lambda i: F.xxhash64(F.array_join(F.array_sort(F.array_distinct(F.slice(words, i, size))), " ")))
        return F.when(F.size(words) >= size, F.array_distinct(hashed)).otherwise(F.array().cast("array<bigint>"))

    # Bound by a lambda, so that the text is split once and not for every run.
    return F.element_at(F.transform(F.array(split_words(c)), runs), 1)


def jaccard(a: Column, b: Column) -> Column:
    """Size of the common part by the size of the union; 0 for two empty sets."""
    both = F.size(F.array_intersect(a, b))
    all_ = F.size(a) + F.size(b) - both
    return F.when(all_ > 0, both / all_).otherwise(F.lit(0.0))


def near_pairs(df: DataFrame, id_col: str, text: str, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """``a, b, similarity`` between representatives of equal texts, ``a < b``."""
    reps = df.where(F.col(text).isNotNull()).groupBy(dedup_key(F.col(text)).alias("h")).agg(F.min(id_col).alias("id"), F.min_by(text, id_col).alias("t"))
    sets = cut_lineage(reps.select("id", shingles(F.lower(F.col("t")), size).alias("s")).where(F.size("s") > 0))
    flat = sets.select("id", F.size("s").alias("n"), F.explode("s").alias("g"))
    # Written, so that the join is one of two plain exchanges, whose hot shingles AQE can split.
    df_of = cut_lineage(flat.groupBy("g").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    # Shingles of one text only come first in the order of rarity: they take up places of the
    # prefix without being joined.
    single = flat.join(df_of, "g", "left").groupBy("id").agg(
        F.first("n").alias("n"), F.count(F.when(F.col("df").isNull(), 1)).alias("alone"), F.array_sort(F.collect_list(F.when(F.col("df").isNotNull(), F.struct("df", "g")))).alias("shared"))
    kept = (F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1 - F.col("alone")).cast("int")
    prefix = single.where(kept > 0).select("id", "n", F.explode(F.transform(F.slice("shared", F.lit(1), F.greatest(kept, F.lit(1))), lambda x: x["g"])).alias("g"))
    left, right = prefix.select(F.col("id").alias("a"), F.col("n").alias("an"), "g"), prefix.select(F.col("id").alias("b"), F.col("n").alias("bn"), "g")
    pairs = left.join(right, "g").where((F.col("a") < F.col("b")) & (F.least("an", "bn") >= threshold * F.greatest("an", "bn"))).select("a", "b").distinct()
    sa, sb = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    return pairs.join(sa, "a").join(sb, "b").select("a", "b", jaccard(F.col("sa"), F.col("sb")).alias("similarity")).where(F.col("similarity") >= threshold)


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """``id, component`` (its least id) over links ``a, b``: the least label of the
    neighbourhood is passed on until nothing changes; each round is written to the shared
    checkpoint folder."""
    both = cut_lineage(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    labels = cut_lineage(both.select(F.col("u").alias("id")).distinct().withColumn("component", F.col("id")))
    for _ in range(rounds):
        seen = both.join(labels, both["v"] == labels["id"]).groupBy("u").agg(F.min("component").alias("m"))
        step = labels.join(seen, labels["id"] == seen["u"], "left").select("id", F.least("component", F.coalesce("m", "component")).alias("component"))
        # a label's own label: long chains shorten by jumps
        jump = step.alias("x").join(step.select(F.col("id").alias("r"), F.col("component").alias("rc")).alias("y"), F.col("x.component") == F.col("y.r"), "left").select("id", F.least("component", F.coalesce("rc", "component")).alias("component"))
        new = cut_lineage(jump)
        changed = new.join(labels.withColumnRenamed("component", "old"), "id").where("component <> old").limit(1).count()
        labels = new
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle within {rounds} rounds")


def near_duplicates(df: DataFrame, id_col: str, text: str, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """One row per document with text: ``id, class_id, links, kept``. ``class_id`` is the
    least id of its class, ``links`` the near-duplicate links of its text, ``kept`` whether
    it stands for the class. Copies of one text share a class."""
    pairs = cut_lineage(near_pairs(df, id_col, text, threshold, size))
    links = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    classes = components(pairs).withColumnRenamed("id", "rep")
    docs = df.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), dedup_key(F.col(text)).alias("h"))
    reps = docs.groupBy("h").agg(F.min("id").alias("rep"))
    return docs.join(reps, "h").join(classes, "rep", "left").join(links, "rep", "left").select(
        "id", F.coalesce("component", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), (F.col("id") == F.coalesce("component", "rep")).alias("kept"))


def near_dedup_first(df: DataFrame, id_col: str, text: str, threshold: float = 0.9, size: int = 5) -> DataFrame:
    """``id, kept``: documents in the order of their ids, each dropped if its similarity to a
    kept one before it is above ``threshold`` (not equal to it). Copies of a text follow its
    first one; texts too short for a run of words are never like another but their copies."""
    pairs = cut_lineage(near_pairs(df, id_col, text, threshold, size).where(F.col("similarity") > threshold).select("a", "b"))
    docs = df.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), dedup_key(F.col(text)).alias("h"))
    reps = docs.groupBy("h").agg(F.min("id").alias("id"))
    kept = greedy_kept(pairs, reps).where("kept").select(F.col("id").alias("__id"))
    return docs.select("id").join(kept, F.col("id") == F.col("__id"), "left").select("id", F.col("__id").isNotNull().alias("kept"))


def greedy_kept(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Order-dependent keeping: an id is dropped if it is linked to a smaller kept id. Settled
    in rounds: an id is decided once all its smaller neighbours are."""
    state = cut_lineage(ids.select("id", F.lit(None).cast("boolean").alias("kept")))
    edges = cut_lineage(pairs.select(F.col("b").alias("id"), F.col("a").alias("smaller")))
    for _ in range(1000):
        known = edges.join(state.select(F.col("id").alias("smaller"), F.col("kept").alias("sk")), "smaller").groupBy("id").agg(F.bool_or(F.coalesce("sk", F.lit(False))).alias("hit"), F.bool_or(F.col("sk").isNull()).alias("open"))
        state = cut_lineage(state.join(known, "id", "left").select("id", F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("hit"), False).when(F.coalesce("open", F.lit(False)), None).otherwise(True).alias("kept")))
        if not state.where("kept is null").limit(1).count():
            return state
    raise RuntimeError("greedy keeping did not settle")
