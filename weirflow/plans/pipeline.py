"""The stages from raw records to training windows, each written as Parquet and resumable."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.config import CorpusConfig
from weirflow.functions.quality import counts, keeps_of, not_blank
from weirflow.functions.text import clean_all, estimate_tokens, once
from weirflow.operators.acquire import acquire_chinese, acquire_english
from weirflow.operators.dedup import exact_dedup, near_duplicates
from weirflow.operators.order import hash_bucket, id_bucket
from weirflow.operators.sample import budget_take, exact_split, interleave
from weirflow.operators.tokens import mock_encode, parts, tokenize, windows
from weirflow.sources import tokenbin
from weirflow.sources.manifest import Manifest


def clean(docs: DataFrame, config: CorpusConfig) -> DataFrame:
    """Cleaned documents that are not blank; with ``quality_filter`` only good ones."""
    out = once(docs, "text", clean_all(F.col("text"), config.min_text_length, config.max_text_length)).where(not_blank(F.col("text"))).withColumn("source", F.coalesce("source", F.lit("unknown")))
    if config.quality_filter:
        k = F.col("__k")
        out = once(out, "__k", counts(F.col("text"))).where(F.when(F.col("lang") == "chinese", keeps_of(k, "chinese")).otherwise(keeps_of(k, "english"))).drop("__k")
    return out


class Pipeline:
    """Runs stages 0 to 6 over raw tables; a complete stage is passed over on resuming.
    ``encoder(text, vocab=, eos=)`` gives the ids of stage 4."""

    def __init__(self, spark: SparkSession, raw_zh: DataFrame, raw_en: DataFrame, config: CorpusConfig, encoder: Callable[..., Column] = mock_encode):
        self.spark, self.raw_zh, self.raw_en, self.config = spark, raw_zh, raw_en, config
        self.encoder = encoder
        self.manifest = Manifest(config.base_dir)

    def read(self, stage: int) -> DataFrame:
        return self.spark.read.parquet(self.config.stage_dir(stage))

    def plan(self, stage: int) -> DataFrame:
        """The DataFrame of a stage over the written stage before it."""
        c = self.config
        if stage == 0:
            both = acquire_chinese(self.raw_zh).unionByName(acquire_english(self.raw_en)).dropDuplicates(["lang", "row_no"])
            return budget_take(both, c.budgets, estimate_tokens(F.col("text")), order="row_no").drop("tokens", "run")
        before = self.read(stage - 1)
        if stage == 1:
            return clean(before, c)
        if stage == 2:
            kept = exact_dedup(before, "text", "row_no", ("lang",))
            if c.near_threshold is not None:
                keyed = kept.withColumn("uid", F.xxhash64("lang", "row_no"))
                near = near_duplicates(keyed, "uid", "text", c.near_threshold).where("kept").select(F.col("id").alias("uid"))
                kept = keyed.join(near, "uid", "left_semi").drop("uid")
            return kept
        if stage == 3:
            return exact_split(before, ["lang"], "row_no", c.split_ratio, c.random_seed, c.boundary)
        if stage == 4:
            return tokenize(before, encoder=self.encoder, vocab=c.vocab_size, eos=c.eos_token_id)
        if stage == 5:
            data = before.withColumn("uid", F.concat_ws("-", "lang", F.col("row_no").cast("string")))
            return interleave(data, F.col("lang") == "chinese", "uid", ["split"], (c.chinese_ratio, c.english_ratio), c.random_seed).select("split", "round", "shuffle", "uid", F.col("token_ids").alias("input_ids"))
        return windows(before, ["round", "shuffle", "uid"], id_bucket(before, "round"), c.context_size, "input_ids", ["split"])

    def binarize(self) -> dict[str, int]:
        """Writes the flat stream of each split as token files with a sidecar beside stage 6;
        the tokens of each split."""
        c, before = self.config, self.read(5)
        folder = f"{c.stage_dir(6)}_tokens"
        streams = parts(before, ["round", "shuffle", "uid"], id_bucket(before, "round"), tokenbin.PART_TOKENS, "input_ids", ["split"])
        written = tokenbin.write_tokens(streams, folder, c.token_width, key="split").groupBy("split").agg(F.sum("tokens").alias("tokens")).collect()
        for r in written:
            tokenbin.write_sidecar(f"{folder}/{r['split']}/meta.json", vocab_size=c.vocab_size, eos_token_id=c.eos_token_id, tokens=r["tokens"], width=c.token_width)
        return {r["split"]: r["tokens"] for r in written}

    def run(self, first: int = 0, last: int = 6, resume: bool = True) -> dict:
        for stage in range(first, last + 1):
            if resume and self.manifest.done(stage):
                continue
            began = time.time()
            self.plan(stage).write.mode("overwrite").parquet(self.config.stage_dir(stage))
            facts = {"rows": self.read(stage).count()}
            if stage == 6:
                facts["tokens"] = self.binarize()
            self.manifest.record(stage, facts, began)
        return self.manifest.state
