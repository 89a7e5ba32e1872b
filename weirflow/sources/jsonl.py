"""JSON lines, prompts and text results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from weirflow import schema
from weirflow.functions.text import strip

REJECTED = "_rejected"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_jsonl(spark: SparkSession, path: str, schema: StructType, recursive: bool = False, keep_rejected: bool = False) -> DataFrame:
    """Rows of JSON lines. Blank lines are passed over; malformed ones are dropped, or kept
    with their text in ``_rejected`` (null for good rows). A missing path gives no rows."""
    if not _exists(spark, path):
        return spark.createDataFrame([], StructType([*schema.fields, *([StructField(REJECTED, StringType())] if keep_rejected else [])]))
    reader = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.jsonl*" if recursive else "*")
    if not keep_rejected:
        return reader.schema(schema).option("mode", "DROPMALFORMED").json(path)
    full = StructType([*schema.fields, StructField(REJECTED, StringType())])
    return reader.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", REJECTED).json(path)


def read_raw(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """Raw records of ``chinese`` or ``english`` as they enter the pipeline, with ``row_no``
    from the record itself, so that a run on the same records gives the same numbers."""
    rows = read_jsonl(spark, path, schema.RAW_ZH if lang == "chinese" else schema.RAW_EN, recursive=True)
    return rows.withColumn("row_no", F.shiftrightunsigned(F.xxhash64(F.struct(*rows.columns)), 1))


def list_jsonl(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the folder's JSON-lines files, in order."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(folder).select("path", "length").orderBy("path")


def write_jsonl(df: DataFrame, path: str, append: bool = False, partition_by: list[str] = ()) -> int:
    """Writes rows as JSON lines, unescaped; the number of rows written, counted in passing."""
    from pyspark.sql import Observation

    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append" if append else "overwrite").option("ignoreNullFields", False)
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)
    return seen.get["n"]


def write_splits(df: DataFrame, path: str, keys: tuple[str, ...] = ("lang", "split")) -> None:
    """One folder per language and split; a second run replaces only what it writes."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """``prompt`` of each line that is not blank, stripped."""
    return spark.read.text(path).select(strip(F.col("value")).alias("prompt")).where("prompt <> ''")


def write_results(df: DataFrame, path: str, prompt: str = "prompt", answer: str = "answer") -> None:
    """Prompt and answer as text blocks."""
    df.select(F.concat(F.lit("Prompt: "), F.coalesce(prompt, F.lit("")), F.lit("\nAnswer: "), F.coalesce(answer, F.lit("")), F.lit("\n"))).write.mode("overwrite").text(path)
