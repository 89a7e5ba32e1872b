"""Raw records to documents: field precedence, source, language gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.functions.quality import not_blank


def json_field(c: Column, name: str) -> Column:
    """A string field of a JSON text; '' where the text is no JSON or lacks the field."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(c), f"$.{name}", "string"), F.lit(""))


def pick_text(*columns: Column) -> Column:
    """The first column that is present, even if empty; else ''."""
    return F.coalesce(*columns, F.lit(""))


def acquire_chinese(raw: DataFrame) -> DataFrame:
    """``row_no, text, source, lang`` of Chinese records with text; a null source is ``chinese``."""
    return raw.select("row_no", pick_text(F.col("text")).alias("text"), F.coalesce("source", F.lit("chinese")).alias("source"), F.lit("chinese").alias("lang")).where(not_blank(F.col("text")))


def acquire_english(raw: DataFrame) -> DataFrame:
    """``row_no, text, source, lang`` of English records with text whose meta says ``en``;
    the source is the meta's url. Records without readable meta are passed over."""
    return raw.where(json_field(F.col("meta"), "language") == "en").select(
        "row_no", pick_text(F.col("raw_content")).alias("text"), json_field(F.col("meta"), "url").alias("source"), F.lit("english").alias("lang")).where(not_blank(F.col("text")))


def gate_counts(raw: DataFrame) -> DataFrame:
    """How many English records pass the language gate, and how many have text."""
    ok = json_field(F.col("meta"), "language") == "en"
    return raw.agg(F.count(F.lit(1)).alias("records"), F.count_if(ok).alias("english"), F.count_if(ok & not_blank(F.col("raw_content"))).alias("kept"), F.count_if(~ok).alias("skipped"))
