"""Schemas of the stored tables."""

from pyspark.sql import types as T

LEDGER = T.StructType([
    T.StructField("source_path", T.StringType()),
    T.StructField("content_hash", T.StringType()),
    T.StructField("source_dir", T.StringType()),
    T.StructField("digested_at", T.TimestampType()),
    T.StructField("wiki_page", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("attempts", T.IntegerType()),
    T.StructField("last_error", T.StringType()),
    T.StructField("run_origin", T.StringType()),
    T.StructField("llm_model", T.StringType()),
])

PAGES = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("content", T.StringType()),
    T.StructField("content_hash", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("mtime", T.TimestampType()),
    T.StructField("indexed_at", T.TimestampType()),
])

EMBEDDINGS = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("content_hash", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("vector", T.ArrayType(T.FloatType())),
    T.StructField("dims", T.IntegerType()),
    T.StructField("updated_at", T.TimestampType()),
])

# landed observations of source files, append-only: one row per seen version
SOURCES = T.StructType([
    T.StructField("source_dir", T.StringType()),
    T.StructField("source_path", T.StringType()),
    T.StructField("content", T.BinaryType()),
    T.StructField("size", T.LongType()),
    T.StructField("mtime", T.TimestampType()),
])
