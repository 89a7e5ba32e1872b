"""Problem 8: records of several sources mixed to target shares of the total size.

Method: multivariate-hypergeometric splitting tree. The documents of a source fall, by a
hash, into blocks of about ``block_tokens``; a source's quota is a number of whole passes
over its blocks plus a prefix of the permuted blocks, the last of them cut within. The
block counts of all sources are split down a tree of the output shards, each node drawing
its left part from the multivariate hypergeometric distribution, so every shard gets exact
quotas without any coordination; each source's permuted block copies are then dealt out to
the shards in disjoint runs, and a shard is shuffled by itself.

The total is the largest one at which every source that has any token can reach its share
within ``max_repeats``; sources without tokens get a share of 0. Each source then misses
its quota by less than half of its smallest unused document of the last block.

What goes to the driver is one row per source of the targets. Blocks are bounded in number
(``max_blocks`` a source), so ordering them is one small window per source; documents are
ordered only inside a block.

Defined results: sizes are tokens of a public tokenizer without special tokens; null and
empty texts have size 0 and are never chosen; documents of a null source are never chosen,
as targets name sources; a source named twice in one mix counts with the sum of its shares;
null or negative shares and repeats below 1 count as 0; empty tables give empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm.arrow import map_batches
from weirflow.llm.vocab import DEFAULT_FOLDER, byte_bpe
from weirflow.operators.order import hash_bucket, position
from weirflow.session import cut_lineage, ship

BLOCK_TOKENS = 1 << 18
MAX_BLOCKS = 1 << 16
SHARD_TOKENS = 1 << 24


def token_sizes(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER) -> DataFrame:
    """``doc_id, source, tokens`` of each document with at least one token."""

    def count(batch: pa.RecordBatch):
        encode = byte_bpe(name, folder).encode_ordinary
        texts = batch.column(2)
        sizes = [len(encode(t)) if (t := texts[i].as_py()) else 0 for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, type=pa.int64())], ["doc_id", "source", "tokens"])

    return map_batches(documents.select("doc_id", "source", "text"), count, "doc_id bigint, source string, tokens bigint").where("tokens > 0")


def plan(available: dict[str, int], targets: list[tuple[int, str, float, int]], total_tokens: int | None = None) -> list[tuple]:
    """``mix_id, source, share, passes, rest`` of each target: whole passes over the source
    and the tokens of the partial pass. ``available``: tokens of each source."""
    mixes: dict[int, dict[str, list]] = {}
    for mix_id, source, share, repeats in targets:
        if mix_id is not None and source is not None:
            entry = mixes.setdefault(mix_id, {}).setdefault(source, [0.0, 0])
            entry[0] += max(0.0, share or 0.0)
            entry[1] = max(entry[1], repeats or 0)
    out = []
    for mix_id, sources in sorted(mixes.items()):
        able = {s: available.get(s, 0) * r for s, (share, r) in sources.items() if share > 0}
        limits = [most / sources[s][0] for s, most in able.items() if most > 0]
        total = min(limits) if limits else 0.0
        if total_tokens is not None:
            total = min(total, total_tokens)
        for s, (share, repeats) in sorted(sources.items()):
            most = able.get(s, 0)
            quota = min(round(total * share), most) if most else 0
            passes, rest = divmod(quota, available[s]) if most else (0, 0)
            out.append((mix_id, s, share, int(passes), int(rest)))
    return out


Node = tuple[int, int, np.ndarray, np.ndarray]


def split_node(node: Node, seed: list[int]) -> tuple[Node, Node]:
    """The two halves of a node of the tree: its shards ``a`` to ``b``, its block counts and
    how many blocks of each source lie before them. The counts are split in proportion to
    the shards on either side by a multivariate hypergeometric draw of the node's own, so a
    node splits in the same way wherever it is split."""
    a, b, counts, before = node
    mid = (a + b) // 2
    take = int(counts.sum()) * (mid - a) // (b - a)
    left = np.random.default_rng([*seed, a, b]).multivariate_hypergeometric(counts, take, method="marginals") if len(counts) else counts
    return (a, mid, left, before), (mid, b, counts - left, before + left)


def leaves(node: Node, seed: list[int]):
    """The shards below a node, in their order."""
    stack = [node]
    while stack:
        node = stack.pop()
        if node[1] - node[0] == 1:
            yield node
        else:
            left, right = split_node(node, seed)
            stack += [right, left]


def top_nodes(units: np.ndarray, shards: int, seed: list[int], most: int = 64) -> list[Node]:
    """At most ``most`` nodes that hold all shards: what is split before executors go on."""
    units = np.asarray(units, dtype=np.int64)
    nodes = [(0, shards, units, np.zeros_like(units))]
    while len(nodes) * 2 <= most and any(b - a > 1 for a, b, *_ in nodes):
        nodes = [x for n in nodes for x in (split_node(n, seed) if n[1] - n[0] > 1 else (n,))]
    return nodes


class Mixture:
    """The parts of a mix, computed once: sizes and blocks are written to the shared
    checkpoint folder."""

    def __init__(self, documents: DataFrame, targets: DataFrame, name: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER, total_tokens: int | None = None,
                 block_tokens: int = BLOCK_TOKENS, max_blocks: int = MAX_BLOCKS, shard_tokens: int = SHARD_TOKENS, seed: int = 42):
        spark = documents.sparkSession
        self.seed, self.shard_tokens = seed, shard_tokens
        rows = [tuple(r) for r in targets.select(F.col("mix_id").cast("int"), "source", F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).collect()]
        names = sorted({r[1] for r in rows if r[1] is not None})
        wanted = spark.createDataFrame([(s,) for s in names], "source string")
        # The names are one row per target; Spark broadcasts them by their size.
        self.sizes = cut_lineage(token_sizes(documents.select("doc_id", "source", "text").join(wanted, "source", "left_semi"), name, folder))
        per_source = {r["source"]: r["tokens"] for r in self.sizes.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
        self.available = per_source
        self.blocks = {s: max(1, min(max_blocks, math.ceil(n / block_tokens))) for s, n in per_source.items()}
        self.plan = plan(per_source, rows, total_tokens)
        table = [(m, s, share, passes, rest, self.blocks.get(s, 1)) for m, s, share, passes, rest in self.plan]
        self.targets = spark.createDataFrame(table, "mix_id int, source string, share double, passes int, rest bigint, blocks int")
        counts = spark.createDataFrame([(s, b) for s, b in self.blocks.items()], "source string, blocks int")
        self.docs = self.sizes.join(counts, "source").select("doc_id", "source", "tokens", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")).cast("int").alias("block"))

    def block_states(self) -> DataFrame:
        """Per mix, source and block: passes, and the tokens the partial pass takes of it."""
        totals = self.docs.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens"))
        order = Window.partitionBy("mix_id", "source").orderBy(F.xxhash64("block", "mix_id", F.lit(self.seed)), "block")
        before = F.coalesce(F.sum("block_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        take = F.least(F.col("block_tokens"), F.greatest(F.lit(0), F.col("rest") - before))
        return totals.join(self.targets.select("mix_id", "source", "passes", "rest"), "source").select("mix_id", "source", "block", "passes", "block_tokens", take.cast("bigint").alias("take"))

    def chosen(self) -> DataFrame:
        """``mix_id, doc_id, source, tokens, repeats`` of every chosen document, with its block."""
        states = self.block_states().where("passes > 0 or take > 0")
        rows = self.docs.join(states, ["source", "block"])
        whole = rows.withColumn("extra", F.when(F.col("take") >= F.col("block_tokens"), 1).otherwise(0)).where("take = 0 or take >= block_tokens")
        # At most one block of each mix and source is cut; only that block is ordered.
        cut = rows.where("take > 0 and take < block_tokens")
        order = Window.partitionBy("mix_id", "source").orderBy(F.xxhash64("doc_id", "mix_id", F.lit(self.seed)), "doc_id")
        group = Window.partitionBy("mix_id", "source")
        inside = cut.withColumn("run", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("taken", F.col("run") <= F.col("take"))
        gap = F.col("take") - F.coalesce(F.max(F.when(F.col("taken"), F.col("run"))).over(group), F.lit(0))
        near = F.when(~F.col("taken"), F.struct(F.abs(F.col("tokens") - F.col("gap")).alias("miss"), F.col("doc_id").alias("doc")))
        fill = inside.withColumn("gap", gap).withColumn("best", F.min(near).over(group))
        filled = (F.col("best.doc") == F.col("doc_id")) & (F.col("best.miss") < F.col("gap"))
        part = fill.withColumn("extra", F.when(F.col("taken") | F.coalesce(filled, F.lit(False)), 1).otherwise(0))
        columns = ["mix_id", "doc_id", "source", "tokens", "block", "passes", "extra"]
        both = whole.select(*columns).unionByName(part.select(*columns))
        return both.withColumn("repeats", F.col("passes") + F.col("extra")).where("repeats > 0")

    def mix(self) -> DataFrame:
        return self.chosen().select("mix_id", "doc_id", "source", "tokens", F.col("repeats").cast("int").alias("repeats"))

    def shares(self) -> DataFrame:
        """Target and actual share of each source of each mix."""
        used = self.chosen().groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).cast("bigint").alias("mixed"), F.count(F.lit(1)).alias("documents"), F.max("repeats").cast("int").alias("most_repeats"))
        total = F.sum("tokens").over(Window.partitionBy("mix_id"))
        return self.targets.join(used, ["mix_id", "source"], "left").select("mix_id", "source", F.col("share").alias("target_share"), F.coalesce("mixed", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats")).withColumn(
            "actual_share", F.when(total > 0, F.col("tokens") / total).otherwise(F.lit(0.0)))

    def shards(self) -> DataFrame:
        """The mixed order: ``mix_id, shard, position, doc_id, copy_no``."""
        spark = self.docs.sparkSession
        copies = self.chosen().select("mix_id", "doc_id", "source", "tokens", "block", F.explode(F.expr("filter(sequence(0, passes), i -> i < passes or extra = 1)")).alias("copy_no"))
        copies = cut_lineage(copies)
        units = copies.groupBy("mix_id", "source", "block", "copy_no").agg(F.sum("tokens").alias("t"))
        # One row per mix and source.
        held = units.groupBy("mix_id", "source").agg(F.count(F.lit(1)).alias("units"), F.sum("t").alias("t")).collect()
        nodes, names = [], {}
        for m in sorted({r["mix_id"] for r in held}):
            own = sorted((r for r in held if r["mix_id"] == m), key=lambda r: r["source"])
            names[m] = [r["source"] for r in own]
            n = max(1, min(math.ceil(sum(r["t"] for r in own) / self.shard_tokens), sum(r["units"] for r in own)))
            nodes += [(m, a, b, counts.tolist(), before.tolist()) for a, b, counts, before in top_nodes(np.array([r["units"] for r in own]), n, [self.seed, m])]
        seed = self.seed

        def split(batches):
            # The lower levels of the tree: which units of each source a shard takes.
            for batch in batches:
                for m, a, b, counts, before in zip(*(c.to_pylist() for c in batch.columns)):
                    for shard, _, n, at in leaves((a, b, np.array(counts, dtype=np.int64), np.array(before, dtype=np.int64)), [seed, m]):
                        has = np.flatnonzero(n).tolist()
                        yield pa.RecordBatch.from_arrays([pa.array([m] * len(has), pa.int32()), pa.array([names[m][i] for i in has], pa.string()), pa.array([shard] * len(has), pa.int32()), pa.array([int(at[i]) + 1 for i in has], pa.int64()), pa.array([int(at[i] + n[i]) for i in has], pa.int64())], ["mix_id", "source", "shard", "first", "last"])

        ship(spark)
        tree = spark.createDataFrame(nodes, "mix_id int, a int, b int, counts array<bigint>, before array<bigint>").repartition(max(1, min(len(nodes), 64)), "mix_id", "a").mapInArrow(split, "mix_id int, source string, shard int, first bigint, last bigint")
        upto = tree.select("mix_id", "source", "shard", F.explode(F.sequence("first", "last")).alias("no"))
        numbered = position(units.withColumn("__o", F.md5(F.concat_ws(":", "block", "copy_no", "mix_id", F.lit(str(self.seed + 1))))), ["mix_id", "source"], ["__o", "block", "copy_no"], hash_bucket(F.col("__o")), "no")
        dealt = numbered.join(upto, ["mix_id", "source", "no"]).select("mix_id", "source", "block", "copy_no", "shard")
        within = Window.partitionBy("mix_id", "shard").orderBy(F.xxhash64("doc_id", "copy_no", F.lit(self.seed + 2)), "doc_id", "copy_no")
        return copies.join(dealt, ["mix_id", "source", "block", "copy_no"]).select("mix_id", "shard", F.row_number().over(within).alias("position"), "doc_id", "copy_no")
