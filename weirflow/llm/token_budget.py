"""Problem 2: how many tokens each record holds, and totals by source, language and domain.

``record_tokens`` establishes the count of each tokenized record, each record once: its own
ids are counted where it has any; else its ``length`` is taken where it is usable; else the
record's text (if texts are given) is measured with a public tokenizer by ``text_tokens``.

``text_tokens`` / ``piece_totals`` follow the method named: the tokenizer's pre-splitting is
applied, each distinct piece is tokenized once, and the lengths are joined with the
frequencies of the pieces, which gives exact totals. Frequencies are summed within a batch
before they are shuffled, so a piece that makes up a third of all text arrives as a few rows.

Defined results: a null or empty text has 0 tokens; null sources, languages and domains
form their own group (null); a record delivered several times counts once; a negative
length is not usable; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.arrow import map_batches
from weirflow.llm.vocab import DEFAULT_FOLDER, byte_bpe, splitter


def _piece_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Frequencies of the pieces of ``text`` per combination of ``keys``."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`{k}` {fields[k]}" for k in keys) + ", piece string, n bigint"

    def count(batch: pa.RecordBatch):
        find = splitter().findall
        n = batch.num_rows
        groups: dict[tuple, Counter] = {}
        key_lists = [batch.column(i).to_pylist() for i in range(len(keys))]
        for row in range(n):
            text = batch.column(len(keys))[row].as_py()
            if text:
                groups.setdefault(tuple(k[row] for k in key_lists), Counter()).update(find(text))
        for key, pieces in groups.items():
            size = len(pieces)
            columns = [pa.array([v] * size, type=batch.column(i).type) for i, v in enumerate(key)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(pieces)), pa.array(list(pieces.values()), type=pa.int64())], [*keys, "piece", "n"])

    return map_batches(df.select(*keys, "text"), count, schema)


def piece_totals(df: DataFrame, keys: list[str], name: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER) -> DataFrame:
    """``keys, tokens``: exact totals of ``text`` per combination of ``keys``.

    One exchange, by piece, serves the summing, the distinct pieces and the join.
    """
    counts = _piece_counts(df, keys).repartition("piece")

    def measure(batch: pa.RecordBatch):
        core = byte_bpe(name, folder)._core_bpe
        pieces = batch.column(0)
        yield pa.RecordBatch.from_arrays([pieces, pa.array([len(core.encode_single_piece(p.encode())) for p in pieces.to_pylist()], type=pa.int64())], ["piece", "piece_tokens"])

    lengths = map_batches(counts.select("piece").distinct(), measure, "piece string, piece_tokens bigint")
    return counts.join(lengths, "piece").groupBy(*keys).agg(F.sum(F.col("n") * F.col("piece_tokens")).cast("bigint").alias("tokens"))


def record_tokens(tokenized: DataFrame, texts: DataFrame | None = None, name: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER) -> DataFrame:
    """One row per ``rec_id``: ``source, lang, tokens, measured_by, length_usable``.

    ``texts`` (``rec_id, text``) serves the records that have neither ids nor a usable
    length; without it those have null tokens.
    """
    n_ids = F.size("token_ids")
    usable = F.col("length").isNotNull() & (F.col("token_ids").isNull() | (F.col("length") == n_ids))
    slim = tokenized.select(
        "rec_id", "source", "lang",
        F.when(F.col("token_ids").isNotNull(), n_ids).when(F.col("length") >= 0, F.col("length")).cast("bigint").alias("tokens"),
        F.when(F.col("token_ids").isNotNull(), F.lit("ids")).when(F.col("length") >= 0, F.lit("length")).alias("measured_by"),
        usable.alias("length_usable"),
    )
    # Deliveries agree in all but loaded_at: any of them stands for the record.
    records = slim.dropDuplicates(["rec_id"])
    if texts is None:
        return records
    missing = records.where("tokens is null")
    measured = piece_totals(missing.select("rec_id").join(texts.select("rec_id", "text"), "rec_id").where("text is not null"), ["rec_id"], name, folder)
    found = missing.drop("tokens", "measured_by").join(measured, "rec_id", "left").select("rec_id", "source", "lang", "tokens", F.when(F.col("tokens").isNotNull(), F.lit("text")).alias("measured_by"), "length_usable")
    return records.where("tokens is not null").unionByName(found)


def unusable_lengths(tokenized: DataFrame) -> DataFrame:
    """``rec_id`` of the records whose ``length`` cannot be used."""
    return record_tokens(tokenized).where(~F.col("length_usable")).select("rec_id")


def budget(records: DataFrame, catalog: DataFrame) -> DataFrame:
    """Totals of ``record_tokens`` by source, language and domain, with their roll-ups.

    Sources without an entry in the catalog have a null domain. ``level`` names the set:
    ``all``, ``source``, ``lang``, ``domain`` or ``slice`` (all three).
    """
    slices = records.groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("records"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("tokens"),
        F.count(F.when(F.col("tokens").isNull(), 1)).alias("unmeasured"), F.count(F.when(~F.col("length_usable"), 1)).alias("unusable_lengths"))
    named = slices.join(catalog.select("source", "domain").dropDuplicates(["source"]), "source", "left").select("source", "lang", "domain", "records", "tokens", "unmeasured", "unusable_lengths")
    sums = [F.sum(c).cast("bigint").alias(c) for c in ("records", "tokens", "unmeasured", "unusable_lengths")]
    null = F.lit(None).cast("string")
    levels = {"slice": ["source", "lang", "domain"], "source": ["source"], "lang": ["lang"], "domain": ["domain"], "all": []}
    parts = [named.groupBy(*keys).agg(*sums).select(F.lit(level).alias("level"), *[(F.col(c) if c in keys else null).alias(c) for c in ("source", "lang", "domain")], "records", "tokens", "unmeasured", "unusable_lengths") for level, keys in levels.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
