"""Problem 7: every text as the list of its token ids, without special tokens.

Method: overlapping chunk encoding. A text is cut into chunks that overlap; each chunk is
pre-split on its own; within an overlap the pre-token boundaries of the two neighbours
fall together again (the scan of the pattern depends on the position only), and the first
common boundary is where the neighbours are stitched. The pieces between two stitches are
then encoded. Decoding concatenates the raw bytes of the ids.

Texts of at most ``giant_chars`` code points are handled within their row, chunk by chunk.
Longer ones are cut into chunk rows that are spread over the cluster and put together
again per document, so that one huge text does not occupy one task.

Defined results: null and empty texts give the empty list; blank text is encoded as it is;
the strings of special tokens are ordinary text; repeated rows come out as often as they
went in; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm.arrow import int_lists, map_batches
from weirflow.llm.vocab import DEFAULT_FOLDER, byte_bpe, splitter

CHUNK_CHARS = 16_384
OVERLAP_CHARS = 512
GIANT_CHARS = 1 << 20


def boundaries(text: str, start: int = 0, end: int | None = None) -> list[int]:
    """Starts of the pre-tokens of ``text[start:end]`` scanned from ``start``."""
    return [m.start() for m in splitter().finditer(text, start, len(text) if end is None else end)]


def resync(text: str, start: int, at: int, overlap: int) -> int | None:
    """First boundary at or after ``at`` common to the scans from ``start`` and from ``at``.

    Only boundaries that lie at least two characters before the end of the overlap are
    trusted, as a look-ahead may still change later ones. The character before the stitch
    is never white space, so each side can be pre-split alone. None: no such boundary.
    """
    end = min(len(text), at + overlap)
    trusted = end - 2 if end < len(text) else end
    own = set(boundaries(text, start, end))
    for p in boundaries(text, at, end):
        if p > trusted:
            break
        if p > at and p in own and not text[p - 1].isspace():
            return p
    return None


def cut_points(text: str, chunk: int, overlap: int) -> list[int]:
    """0, the stitches of the overlapping chunks, and the length of the text."""
    points, start, at = [0], 0, chunk
    while at < len(text):
        p = resync(text, start, at, overlap)
        if p is not None:
            points.append(p)
            start = p
        at += chunk
    points.append(len(text))
    return points


def encode_text(text: str | None, name: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    """The ids of one text."""
    if not text:
        return []
    encode = byte_bpe(name, folder).encode_ordinary
    if len(text) <= chunk:
        return encode(text)
    points = cut_points(text, chunk, overlap)
    ids: list[int] = []
    for a, b in zip(points, points[1:]):
        ids.extend(encode(text[a:b]))
    return ids


def decode_ids(ids, name: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER) -> str:
    """The text of a list of ids: raw bytes put together, then read as UTF-8."""
    encoding = byte_bpe(name, folder)
    return b"".join(encoding.decode_single_token_bytes(int(i)) for i in ids).decode("utf-8", errors="replace")


def _encode_rows(df: DataFrame, name: str, folder: str, chunk: int, overlap: int) -> DataFrame:
    def encode(batch: pa.RecordBatch):
        keys, texts = batch.column(0), batch.column(1)
        for at in range(0, batch.num_rows, 512):
            offsets, flat = [0], []
            for text in texts.slice(at, 512).to_pylist():
                ids = encode_text(text, name, folder, chunk, overlap)
                flat.append(np.array(ids, dtype=np.int32))
                offsets.append(offsets[-1] + len(ids))
            yield pa.RecordBatch.from_arrays([keys.slice(at, 512), int_lists(np.concatenate(flat), offsets)], ["doc_id", "ids"])

    return map_batches(df, encode, "doc_id bigint, ids array<int>")


def _encode_giants(df: DataFrame, name: str, folder: str, chunk: int, overlap: int) -> DataFrame:
    """Rows cut into overlapping chunk rows, spread, encoded and stitched."""
    uid = F.xxhash64("doc_id", "text")
    rows = df.withColumn("__copy", uid).groupBy("doc_id", "__copy").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("__times"))
    pieces = rows.select(
        "doc_id", "__copy", "__times",
        F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / chunk).cast("int")), lambda i: F.substring(F.col("text"), i * chunk + 1, F.lit(chunk + 2 * overlap)))).alias("no", "part"),
        F.length("text").alias("n"),
    ).repartition("doc_id", "__copy", "no")

    def encode(batch: pa.RecordBatch):
        out = {k: [] for k in ("doc_id", "copy", "times", "no", "stitch", "head", "counts", "ids")}
        bpe = byte_bpe(name, folder)
        for r in batch.to_pylist():
            part, last = r["part"], (r["no"] + 1) * chunk >= r["n"]
            stop = len(part) if last else resync(part, 0, chunk, overlap)
            head, counts, ids = [], [], []
            if stop is not None:
                limit, at = min(stop, overlap), 0
                for m in splitter().finditer(part, 0, stop):
                    if m.start() >= limit:
                        break
                    own = bpe._core_bpe.encode_single_piece(m.group().encode())
                    head.append(m.start())
                    counts.append(len(own))
                    ids.extend(own)
                    at = m.end()
                ids.extend(encode_text(part[at:stop], name, folder, chunk, overlap))
            for k, v in (("doc_id", r["doc_id"]), ("copy", r["__copy"]), ("times", r["__times"]), ("no", r["no"]), ("stitch", None if stop is None else stop - chunk), ("head", head), ("counts", counts), ("ids", ids)):
                out[k].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("times", pa.int64()), ("no", pa.int32()), ("stitch", pa.int32()), ("head", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("ids", pa.list_(pa.int32()))]))

    encoded = map_batches(pieces, encode, "doc_id bigint, copy bigint, times bigint, no int, stitch int, head array<int>, counts array<int>, ids array<int>")

    def stitch(table: pa.Table) -> pa.Table:
        parts = sorted(table.to_pylist(), key=lambda r: r["no"])
        ids, begin, whole = [], 0, True
        for r in parts:
            if r["stitch"] is None:
                whole = False
                break
            drop = sum(c for h, c in zip(r["head"], r["counts"]) if h < begin)
            ids.extend(r["ids"][drop:])
            begin = r["stitch"]
        first = parts[0]
        times = first["times"]
        return pa.table({"doc_id": [first["doc_id"]] * times, "copy": [first["copy"]] * times, "ids": [ids if whole else None] * times}, schema=pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    done = encoded.groupBy("doc_id", "copy").applyInArrow(stitch, "doc_id bigint, copy bigint, ids array<int>")
    # A run without any boundary in an overlap: such a text is encoded whole in its row.
    rest = df.withColumn("copy", uid).join(done.where("ids is null").select("doc_id", "copy").distinct(), ["doc_id", "copy"], "left_semi").select("doc_id", "text")
    return done.where("ids is not null").select("doc_id", "ids").unionByName(_encode_rows(rest, name, folder, chunk, overlap))


def encode_corpus(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None, name: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER,
    chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, giant_chars: int = GIANT_CHARS,
) -> DataFrame:
    """``doc_id, ids`` of every row. ``length``: a column with the code points of the text, if
    there is one; then the scan for giant texts prunes row groups instead of reading them."""
    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), (length if length is not None else F.length(text_col)).alias("n"))
    giant = F.col("n") > giant_chars
    small = rows.where(F.col("n").isNull() | ~giant).select("doc_id", "text")
    large = rows.where(giant & F.col("text").isNotNull() & (F.length("text") > 0)).select("doc_id", "text")
    odd = rows.where(giant & (F.col("text").isNull() | (F.length("text") == 0))).select("doc_id", F.lit(None).cast("string").alias("text"))
    return _encode_rows(small.unionByName(odd), name, folder, chunk, overlap).unionByName(_encode_giants(large, name, folder, chunk, overlap))
