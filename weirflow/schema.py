"""Schemas of the stages."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT, LONG = T.StringType(), T.LongType()
RAW_ZH = T.StructType([T.StructField("text", TEXT), T.StructField("source", TEXT), T.StructField("source_from_meta", TEXT)])
RAW_EN = T.StructType([T.StructField("raw_content", TEXT), T.StructField("doc_id", TEXT), T.StructField("meta", TEXT), T.StructField("quality_signals", TEXT)])
DOCUMENT = T.StructType([T.StructField("text", TEXT), T.StructField("source", TEXT), T.StructField("lang", TEXT)])
TOKENIZED = T.StructType([T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("length", T.IntegerType()), T.StructField("source", TEXT), T.StructField("lang", TEXT)])
MERGED = T.StructType([T.StructField("input_ids", T.ArrayType(T.IntegerType()))])
