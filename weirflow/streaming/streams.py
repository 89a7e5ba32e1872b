"""The operators over streams: cleaning, deduplication, budgets, event counts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.functions.quality import not_blank
from weirflow.functions.text import clean_all, dedup_key, once


def read_stream(spark: SparkSession, folder: str, schema: str, kind: str = "json", files_a_batch: int = 100) -> DataFrame:
    """A folder of files as a stream; a batch takes at most ``files_a_batch`` new files, so a
    backlog is worked off in steps of bounded size."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).format(kind).load(folder)


def write_stream(docs: DataFrame, folder: str, checkpoint: str, kind: str = "json", keys: tuple[str, ...] = ()):
    """Writes a stream to files (a subfolder for each of ``keys``) until all that is there is
    worked off; what a checkpoint has is not written again."""
    out = docs.writeStream.format(kind).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (out.partitionBy(*keys) if keys else out).start(folder)


def clean_stream(docs: DataFrame, least: int = 10, most: int = 100_000) -> DataFrame:
    """The cleaning chain, row by row: no state."""
    return once(docs, "text", clean_all(F.col("text"), least, most)).where(not_blank(F.col("text")))


def dedup_stream(docs: DataFrame, text: str = "text", time: str | None = None, delay: str = "1 day") -> DataFrame:
    """First row of each text. With an event time the state is bounded by the delay; without
    one every key is kept for good."""
    keyed = docs.withColumn("dedup_key", dedup_key(F.col(text)))
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["dedup_key"]) if time else keyed.dropDuplicates(["dedup_key"])


def budget_stream(docs: DataFrame, tokens: Column, budget: int, order: list[str], key: str = "lang") -> DataFrame:
    """Rows per key while their running token count stays within the budget: batches as they
    arrive, rows of a batch by ``order``. The first that does not fit ends the key for good."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    data = docs.withColumn("tokens", tokens.cast("bigint"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in data.schema.fields)

    def take(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used, open_ = state.get if state.exists else (0, True)
        # Frames come in no promised order.
        rows = pd.concat(list(frames))
        if not open_:
            yield rows.iloc[:0]
            return
        rows = rows.sort_values(order, na_position="first", kind="stable")
        upto = used + rows["tokens"].fillna(0).to_numpy(dtype="int64").cumsum()
        fits = int((upto <= budget).cumprod().sum())
        state.update((int(upto[fits - 1]) if fits else used, fits == len(rows)))
        yield rows.iloc[:fits]

    return data.groupBy(key).applyInPandasWithState(take, schema, "used bigint, open boolean", "append", GroupStateTimeout.NoTimeout)


def event_counts(events: DataFrame, time: str, keys: list[str], window: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts per (sliding) window and keys; rows later than the delay are not counted."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    out = events.withWatermark(time, delay).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def session_counts(events: DataFrame, time: str, key: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Counts per session: events of a key no further apart than the gap."""
    out = events.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
