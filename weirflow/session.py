"""Session helpers: the shared folder, lineage cuts, and the package on the workers."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's reliable checkpoint folder.

    ``spark.checkpoint.dir`` wins when the cluster names one. A temporary folder is
    used only where it is unset and the master is local, as in tests; on a cluster an
    unset folder is an error, since executors could not share it.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if named:
        if current.isEmpty():
            sc.setCheckpointDir(named)
        return named
    if current.isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset on a cluster")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="weirflow-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, once per application.

    The package is zipped by the driver and handed out by Spark's own file server, so
    executors that come later get it too.
    """
    sc = spark.sparkContext
    if getattr(sc, "_weirflow_shipped", False):
        return
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="weirflow-code-")) / "weirflow.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*")):
            if p.is_file() and "__pycache__" not in p.parts:
                z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(out))
    sc._weirflow_shipped = True


def keep_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder and read from there: a
    lineage cut whose columns can be read one by one."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared checkpoint folder, until ``clear_folders``."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _FOLDERS.append(path)
    return path


_FOLDERS: list[str] = []


def clear_folders() -> None:
    """Deletes what this process has written to the shared folder, once no result that
    reads it is needed any more."""
    from pyarrow import fs

    while _FOLDERS:
        store, inner = store_of(_FOLDERS.pop())
        if store.get_file_info(inner).type != fs.FileType.NotFound:
            store.delete_dir(inner)


def put_shared(path: str, data: bytes) -> None:
    """Writes a file as a whole, from a task or the driver; a task that runs again replaces
    what it wrote."""
    store, inner = store_of(path)
    store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(inner) as f:
        f.write(data)


def get_shared(path: str) -> bytes:
    store, inner = store_of(path)
    with store.open_input_stream(inner) as f:
        return f.read()


def store_of(path: str):
    """The file system of a path or address (local, HDFS, object store) and the path in it,
    for tasks and the driver alike."""
    from pyarrow import fs

    if not re.match(r"[a-z][a-z0-9+.-]*:", path):
        path = f"file://{Path(path).absolute()}"
    return fs.FileSystem.from_uri(re.sub("^file:/*", "file:///", path))
