"""Problem 4: records packed into containers of their split's capacity.

Method: first-fit decreasing with a tournament tree of bin capacities, run independently in
randomised groups of records. Only ``rec_id``, split and number of ids are shuffled, never
the ids. Groups are drawn by a hash of the record, so no source or run of lengths gathers in
one of them, and their number follows the number of records of the split: a group holds
about ``group_records`` records at every size, and the space lost by packing groups apart is
about half a container each.

Defined results: each record counts once, however often it was delivered. Null or empty
``token_ids`` take no space: such a record has one piece of 0 tokens, in the first container
of its group. A record longer than the capacity is divided: pieces of exactly the capacity
fill containers of their own, the remainder is packed like any other item. Ties in length
are ordered by ``rec_id``. A record whose split has no capacity (or one below 1) has a null
container. Empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.session import ship

GROUP_RECORDS = 8_192
ASSIGNMENT = "rec_id bigint, split string, piece_no int, start int, n_tokens int, pieces int, grp bigint, container int"


def first_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item, items in the order given, each into the first bin with room.

    A tournament tree over the bins holds in each node the most room below it; the first
    bin that fits is found, and its path updated, in log2(bins) steps.
    """
    n = len(sizes)
    leaves = 1
    while leaves < max(1, n):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    out = np.empty(n, dtype=np.int32)
    for i, size in enumerate(sizes.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        out[i] = node - leaves
        room[node] -= size
        node //= 2
        while node:
            best = room[2 * node] if room[2 * node] >= room[2 * node + 1] else room[2 * node + 1]
            if room[node] == best:
                break
            room[node] = best
            node //= 2
    return out


def pack_group(rec_ids: np.ndarray, sizes: np.ndarray, capacity: int) -> dict[str, np.ndarray]:
    """The pieces of one group's records and their containers, numbered from 0."""
    whole = np.where(sizes > capacity, sizes // capacity, 0)
    rest = np.where(sizes > capacity, sizes % capacity, sizes)
    item = np.flatnonzero((rest > 0) | (sizes <= capacity))
    order = item[np.lexsort((rec_ids[item], -rest[item]))]
    bins = first_fit(rest[order], capacity)
    used = int(bins.max()) + 1 if len(bins) else 0
    full = np.repeat(np.arange(len(sizes)), whole)
    number = np.arange(len(full)) - np.repeat(np.cumsum(whole) - whole, whole)
    row = np.concatenate([full, order])
    piece = np.concatenate([number, whole[order]])
    pieces = whole + ((rest > 0) | (sizes <= capacity))
    return {
        "rec_id": rec_ids[row], "piece_no": piece, "start": piece * capacity, "n_tokens": np.concatenate([np.full(len(full), capacity), rest[order]]),
        "pieces": pieces[row], "container": np.concatenate([used + np.arange(len(full)), bins]),
    }


def pack(tokenized: DataFrame, capacities: DataFrame, group_records: int = GROUP_RECORDS, seed: int = 42) -> DataFrame:
    """The assignment, one row per piece of a record: ``rec_id, split, piece_no, start,
    n_tokens, pieces, grp, container``. A container is named by split, grp and container."""
    records = tokenized.select("rec_id", "split", F.coalesce(F.size("token_ids"), F.lit(0)).alias("n")).withColumn("n", F.greatest("n", F.lit(0))).dropDuplicates(["rec_id"])
    # One row per split: bounded by the table of capacities.
    limits = capacities.where("capacity >= 1").groupBy("split").agg(F.max("capacity").alias("capacity"))
    counts = tokenized.groupBy("split").agg(F.count(F.lit(1)).alias("rows")).join(limits, "split").select("split", "capacity", F.greatest(F.lit(1), F.ceil(F.col("rows") / group_records)).cast("bigint").alias("groups"))
    placed = records.join(counts, "split", "left").withColumn("grp", F.pmod(F.xxhash64("rec_id", F.lit(seed)), F.col("groups")))

    ship(tokenized.sparkSession)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        capacity, split, grp = table.column("capacity")[0].as_py(), key[0].as_py(), key[1].as_py()
        out = pack_group(table.column("rec_id").to_numpy(), table.column("n").to_numpy().astype(np.int64), capacity)
        n = len(out["rec_id"])
        return pa.table({
            "rec_id": out["rec_id"], "split": pa.array([split] * n, pa.string()), "piece_no": out["piece_no"].astype(np.int32), "start": out["start"].astype(np.int32),
            "n_tokens": out["n_tokens"].astype(np.int32), "pieces": out["pieces"].astype(np.int32), "grp": np.full(n, grp), "container": out["container"].astype(np.int32)})

    packed = placed.where("capacity is not null").select("rec_id", "split", "n", "capacity", "grp").groupBy("split", "grp").applyInArrow(run, ASSIGNMENT)
    none = F.lit(None)
    left = placed.where("capacity is null").select("rec_id", "split", F.lit(0).alias("piece_no"), F.lit(0).alias("start"), F.col("n").cast("int").alias("n_tokens"), F.lit(1).alias("pieces"), none.cast("bigint").alias("grp"), none.cast("int").alias("container"))
    return packed.unionByName(left)


def divided(assignment: DataFrame) -> DataFrame:
    """``rec_id`` of the records that had to be divided."""
    return assignment.where("pieces > 1 and piece_no = 0").select("rec_id")


def fill_report(assignment: DataFrame, capacities: DataFrame) -> DataFrame:
    """Containers, tokens and the share of space used, per split."""
    used = assignment.where("container is not null").groupBy("split", "grp", "container").agg(F.sum("n_tokens").alias("t")).groupBy("split").agg(F.count(F.lit(1)).alias("containers"), F.sum("t").cast("bigint").alias("tokens"))
    return used.join(capacities.select("split", "capacity"), "split").select("split", "capacity", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("fill"))
