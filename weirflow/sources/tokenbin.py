"""Headerless token files, sample files with a header, and their sidecars.

A token file is the flat stream of a split as unsigned little-endian integers. It is written
in parts named by their first position, each by one task over a bounded range of positions,
so no task or driver holds a whole stream; ``join_parts`` puts parts into one file. Paths may
be local or addresses of a shared store (``session.store_of``); on a cluster they have to be
the latter. Reading goes by byte ranges, so one large file is read by many tasks.
"""

from __future__ import annotations

import json
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weirflow.session import put_shared, ship, store_of

PART_TOKENS = 1 << 22


def _files(path: str, pattern: str) -> list[tuple[str, int]]:
    """Path and bytes of the files of a folder whose names match, or of the one file."""
    from pyarrow import fs

    store, inner = store_of(path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(inner, info.size)]
    return sorted((f.path, f.size) for f in store.get_file_info(fs.FileSelector(inner, allow_not_found=True)) if re.fullmatch(pattern, f.base_name))


def _kind(width: int) -> str:
    return "<u2" if width == 2 else "<u4"


def write_tokens(parts: DataFrame, folder: str, width: int = 2, part_tokens: int = PART_TOKENS, key: str | None = None) -> DataFrame:
    """Writes ``part, at, ids`` (``operators.tokens.parts`` of ``part_tokens``) as part files,
    with ``key`` in a subfolder for each of its values; ``key, part, tokens`` of what was
    written. Each part is written once, by one task."""
    ship(parts.sparkSession)

    def write(table: pa.Table) -> pa.Table:
        import numpy as np

        table = table.sort_by("at")
        part, name = table.column("part")[0].as_py(), table.column("name")[0].as_py()
        values = table.column("ids").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(_kind(width))
        put_shared("/".join(x for x in (folder.rstrip("/"), name, f"part-{part * part_tokens:015d}.bin") if x), np.ascontiguousarray(values).tobytes())
        return pa.table({"name": pa.array([name], pa.string()), "part": pa.array([part], pa.int64()), "tokens": pa.array([len(values)], pa.int64())})

    named = parts.select((F.coalesce(F.col(key).cast("string"), F.lit("none")) if key else F.lit("")).alias("name"), "part", "at", "ids")
    out = named.groupBy("name", "part").applyInArrow(write, "name string, part bigint, tokens bigint")
    return out.withColumnRenamed("name", key) if key else out.drop("name")


def join_parts(folder: str, target: str, pattern: str = r"part-\d+\.bin", head: bytes = b"") -> int:
    """Files put together in their order behind ``head``, copied in blocks; the bytes written.
    No parts give an empty file."""
    store, inner = store_of(target)
    total = 0
    with store.open_output_stream(inner) as out:
        out.write(head)
        for path, _ in _files(folder, pattern):
            with store_of(folder)[0].open_input_stream(path) as f:
                while chunk := f.read(1 << 22):
                    out.write(chunk)
                    total += len(chunk)
    return total + len(head)


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, first: int):
        self.path, self.start, self.end, self.first = path, start, end, first


class _TokenReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.width, self.step = options["path"], int(options.get("width", 2)), int(options.get("rangetokens", PART_TOKENS))

    def partitions(self):
        out = []
        for path, size in _files(self.path, r"part-\d+\.bin"):
            m = re.search(r"part-(\d+)\.bin$", path)
            n = size // self.width
            out += [_Range(path, a, min(n, a + self.step), int(m.group(1)) if m else 0) for a in range(0, n, self.step)]
        return out or [_Range("", 0, 0, 0)]

    def read(self, partition):
        import numpy as np

        if not partition.end:
            return
        with store_of(self.path)[0].open_input_file(partition.path) as f:
            f.seek(partition.start * self.width)
            at = partition.start
            while at < partition.end:
                take = min(65_536, partition.end - at)
                values = np.frombuffer(f.read(take * self.width), dtype=_kind(self.width))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(values)) + partition.first), pa.array(values.astype(np.int64))], ["gpos", "token"])
                at += take


class TokenSource(DataSource):
    """``spark.read.format("tokenbin").option("path", ...).option("width", 2)``: gpos, token."""

    @classmethod
    def name(cls) -> str:
        return "tokenbin"

    def schema(self) -> str:
        return "gpos bigint, token bigint"

    def reader(self, schema):
        return _TokenReader(self.options)


def read_tokens(spark: SparkSession, path: str, width: int = 2, range_tokens: int = PART_TOKENS) -> DataFrame:
    ship(spark)
    spark.dataSource.register(TokenSource)
    return spark.read.format("tokenbin").option("path", path).option("width", width).option("rangeTokens", range_tokens).load()


def write_samples(pairs: DataFrame, path: str, width: int = 2, part_rows: int = 1 << 14) -> int:
    """Samples ``sample, x, y`` (numbered from 0) with the file's header: a 64-bit count, all
    x, then all y. Tasks write parts beside the file, which are joined by copying blocks. The
    number of samples; no file for none."""
    ship(pairs.sparkSession)
    folder = f"{path}.parts"

    def write(table: pa.Table) -> pa.Table:
        import numpy as np

        table = table.sort_by("sample")
        part = table.column("part")[0].as_py()
        for name in ("x", "y"):
            put_shared(f"{folder}/{name}-{part:09d}.bin", np.ascontiguousarray(table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(_kind(width))).tobytes())
        return pa.table({"n": pa.array([table.num_rows], pa.int64())})

    n = pairs.select(F.floor(F.col("sample") / part_rows).cast("bigint").alias("part"), "sample", "x", "y").groupBy("part").applyInArrow(write, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if n:
        join_parts(folder, path, r"[xy]-\d+\.bin", struct.pack("<q", n))
        store, inner = store_of(folder)
        store.delete_dir(inner)
    return n


def read_samples(spark: SparkSession, path: str, context: int, width: int = 2) -> DataFrame:
    """``sample, x, y`` of a sample file; a missing file gives no rows. ``context``: the
    length of a sample."""
    if not _files(path, "(?!)"):
        return spark.createDataFrame([], "sample bigint, x array<bigint>, y array<bigint>")
    store, inner = store_of(path)
    with store.open_input_file(inner) as f:
        n = struct.unpack("<q", f.read(8))[0]
    ship(spark)

    def read(batches):
        import numpy as np

        for batch in batches:
            ids = batch.column(0).to_pylist()
            with store_of(path)[0].open_input_file(inner) as f:
                def take(at: int) -> list[int]:
                    f.seek(8 + at * context * width)
                    return np.frombuffer(f.read(context * width), dtype=_kind(width)).astype(np.int64).tolist()

                block = [[take(half * n + i) for i in ids] for half in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(b, pa.list_(pa.int64())) for b in block]], ["sample", "x", "y"])

    return spark.range(n).withColumnRenamed("id", "sample").mapInArrow(read, "sample bigint, x array<bigint>, y array<bigint>")


def write_sidecar(path: str, **facts) -> None:
    put_shared(path, json.dumps(facts).encode())


def read_sidecar(path: str) -> dict:
    """The facts about a token file; defaults where there is no readable sidecar. The number
    of samples always follows from the data, never from here."""
    known = {"vocab_size": 6400, "eos_token_id": 2, "pad_token_id": 0}
    store, inner = store_of(path)
    try:
        with store.open_input_stream(inner) as f:
            return known | json.loads(f.read())
    except (OSError, ValueError):
        return known
